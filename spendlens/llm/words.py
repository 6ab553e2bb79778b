"""Cutting text into stretches that byte-level tokenizers treat independently.

A text is cut before every space that follows a character other than white
space.  No token of the public patterns crosses such a place: a space inside a
token stands at its beginning, or in a run of white space.  The stretches
repeat across texts, so workers remember their tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator
from itertools import filterfalse

import numpy as np

#: Stretches of a generation of a worker's memory, and characters for each.
REMEMBERED, REMEMBERED_CHARS = 350_000, 24


def is_open(part: str) -> bool:
    """Whether the space behind this part belongs to a run of white space."""
    return not part or part[-1].isspace()


class Memory(dict):
    """Stretch -> its tokens.  Of older stretches only those met in the last two
    generations stay, so the size is bounded and frequent ones are computed once."""

    def __init__(self, limit: int = REMEMBERED):
        super().__init__()
        self.limit, self.chars, self.older = limit, 0, {}

    def learn(self, parts: Iterable[Iterable[str]], compute: Callable[[list[str]], Iterable]) -> None:
        """Make every part of these texts known."""
        wanted = set().union(*parts)
        missing = set(filterfalse(self.__contains__, wanted))  # difference() would walk through the whole memory
        if len(self) + len(missing) > self.limit or self.chars > self.limit * REMEMBERED_CHARS:
            self.older = dict(self)
            self.clear()
            self.chars, missing = 0, wanted
        self.chars += sum(map(len, missing))
        again = missing.intersection(self.older)
        self.update((p, self.older[p]) for p in again)
        new = list(missing - again)
        self.update(zip(new, compute(new)))


def by_bytes(values: Iterable, most: int, size: Callable = len) -> Iterator[list]:
    """Consecutive groups of at most ``most`` bytes, or of one larger value."""
    group, held = [], 0
    for value in values:
        n = size(value)
        if group and held + n > most:
            yield group
            group, held = [], 0
        group.append(value)
        held += n
    if group:
        yield group


_held: dict[Hashable, object] = {}


def owned(owner: Hashable, make: Callable[[], object]):
    """What this worker remembers for ``owner``.  A worker serves one at a time: what it held for another goes,
    so that it does not keep the memory of stages that have ended."""
    if owner not in _held:
        _held.clear()
        _held[owner] = make()
    return _held[owner]


def memory_of(model: str) -> Memory:
    """This worker's memory of what a model gives for each stretch."""
    return owned(model, lambda: Memory(60_000))


class Numbers(dict):
    """Stretch -> its number.  Looking up a new one gives it the next number and notes it."""

    def __init__(self, known: Iterable[str] = ()):
        super().__init__(zip(known, range(1 << 62)))
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self)
        self.new.append(part)
        return number


class IdTable:
    """A worker's table of the ids of stretches: a number for each, the ids of all one after the other.

    Ids of many stretches are picked out of it by numpy, with one look-up each.
    When the table is full, the stretches met most often stay.
    """

    def __init__(self, compute: Callable[[list[str]], list[bytes | None]], limit: int):
        self.compute, self.limit = compute, limit
        self.numbers, self.used = Numbers(), 0
        self.ids, self.ends = np.zeros(1 << 12, "<u4"), np.zeros(1, np.int64)
        self.open, self.times = np.zeros(0, bool), np.zeros(0, np.int32)

    def learn(self, new: list[str]) -> None:
        found = self.compute(new)
        data = b"".join(f or b"" for f in found)
        used = int(self.ends[-1])
        if used + len(data) // 4 > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(len(data) // 4 + used, "<u4")])
        self.ids[used : used + len(data) // 4] = np.frombuffer(data, "<u4")
        sizes = np.fromiter((len(f or b"") // 4 for f in found), np.int64, len(found))
        self.ends = np.concatenate([self.ends, used + np.cumsum(sizes)])
        self.open = np.concatenate([self.open, np.fromiter((f is None for f in found), bool, len(found))])
        self.times = np.concatenate([self.times, np.zeros(len(found), np.int32)])

    def forget(self) -> None:
        """Keep the third of the table that was met most often."""
        best = np.sort(np.argsort(-self.times, kind="stable")[: self.limit // 3])
        known = np.array(list(self.numbers), object)[best]
        sizes = np.diff(self.ends)[best]
        self.ids = self.ids[picked(self.ends[best], sizes)]
        self.numbers = Numbers(known)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.open, self.times = self.open[best], self.times[best] // 2

    def lookup(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all parts one after the other, how many each has, and which have none of their own."""
        if len(self.numbers) > self.limit:
            self.forget()
        at = np.fromiter(map(self.numbers.__getitem__, parts), np.int64, len(parts))
        if self.numbers.new:
            self.learn(self.numbers.new)
            self.numbers.new = []
        self.times += np.bincount(at, minlength=len(self.times)).astype(np.int32)
        begins = self.ends[at]
        sizes = self.ends[at + 1] - begins
        return self.ids[picked(begins, sizes)], sizes, self.open[at]

    def encode(self, texts: list[str], whole: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of each text: its first part by ``whole``, those behind a space from the table."""
        parts = [t.split(" ") for t in texts]
        heads = [p.pop(0) for p in parts]
        ids, sizes, gone = self.lookup([x for p in parts for x in p])
        words = np.cumsum([0, *map(len, parts)])
        ends = np.concatenate([[0], np.cumsum(sizes)])[words].tolist()
        gone = np.concatenate([[0], np.cumsum(gone)])[words].tolist()
        out = []
        for i, own in enumerate(whole(heads)):
            if parts[i] and (is_open(heads[i]) or gone[i] < gone[i + 1]):  # a run of white space with a space in it
                out += whole([texts[i]])
            else:
                out.append(own + ids[ends[i] : ends[i + 1]].tobytes())
        return out


def picked(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin here and have these sizes."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(total)
