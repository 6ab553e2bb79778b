"""Benchmark decontamination: scan documents for windows of benchmark words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import require, with_columns

#: Bytes of benchmark text whose windows are broadcast together; more items are scanned in several blocks.
BLOCK_BYTES = 8_000_000
#: A-Z lower-cased, and a space for every byte outside words; bytes of characters beyond ASCII belong to words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def roll(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` numbers."""
    n = len(ids) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(width if n > 0 else 0):
        out = (out + ids[i : i + n]) * MIX
        out ^= out >> np.uint64(29)
    return out


class Windows:
    """The windows of a set of benchmark texts: the word numbers of all texts one
    after the other and, for each width, window hashes in order with the place
    where each begins.  About 20 bytes a word, and a dictionary of the different words."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        numbers, sizes = [np.zeros(0, np.uint32)], []
        for _, text in items:
            found = words(text)
            numbers.append(np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found), np.uint32, len(found)))
            sizes.append(len(found))
        self.ids = np.concatenate(numbers)
        sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(sizes)
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        spans = np.minimum(sizes, width)
        for size in np.unique(spans[spans > 0]).tolist():
            own = np.flatnonzero(spans == size)
            n = sizes[own] - size + 1
            begins = np.repeat(self.ends[own] - sizes[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            hashes = roll(self.ids.astype(np.uint64), size)[begins]
            order = np.argsort(hashes, kind="stable")
            self.by_width[size] = hashes[order], begins[order].astype(np.uint32)

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word spans covered by windows (begin, end), and the names of the items they belong to."""
        ids = np.fromiter(map(self.vocabulary.get, found, [0] * len(found)), np.uint64, len(found))
        edges, owners = np.zeros(len(found) + 1, np.int64), set()
        for size, (known, begins) in self.by_width.items():
            hashes = roll(ids, size)
            at = np.searchsorted(known, hashes)
            at[at == len(known)] = 0
            places = np.flatnonzero(known[at] == hashes)
            for value in np.unique(hashes[places]):
                own = places[hashes[places] == value]
                low, high = np.searchsorted(known, value), np.searchsorted(known, value, "right")
                texts = ids[own[:, None] + np.arange(size)]
                for window in np.unique(texts, axis=0):
                    starts = begins[low:high]
                    starts = starts[np.all(self.ids[starts[:, None] + np.arange(size, dtype=np.uint32)] == window, axis=1)]  # the words, not the hash
                    if len(starts):
                        real = own[np.all(texts == window, axis=1)]
                        np.add.at(edges, real, 1)
                        np.add.at(edges, real + size, -1)
                        owners.update(np.searchsorted(self.ends, starts, "right").tolist())
        covered = np.diff(np.concatenate([[0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0]]))
        spans = list(zip(np.flatnonzero(covered == 1).tolist(), np.flatnonzero(covered == -1).tolist()))
        return spans, {self.names[i] for i in owners} - {None}


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, in order, none touching the next."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item: str = "item_id",
               item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add what each document shares with the benchmark.

    Words are runs of ASCII letters, digits and characters beyond ASCII, with
    A-Z lower-cased.  An item's windows are its runs of ``width`` words, or all
    its words if it has fewer.  Adds n_words, n_hit (words inside an occurrence
    of a window), spans (the word ranges hit, ends excluded), items (text of
    the item keys with an occurring window, sorted, each once) and contaminated
    (n_hit > 0).  Other columns stay; one named like an added column is replaced.

    Null and empty texts have no words; an item without words has no windows;
    the windows of an item without key count, but nothing names it.  An empty
    benchmark hits nothing.  Long texts are scanned whole; rows that repeat get
    the same result each.

    The windows of at most ``block_bytes`` of item texts are broadcast at a
    time; a larger benchmark takes further passes over the words found so far.
    """
    require(docs, text)
    require(benchmark, item, item_text)
    items = benchmark.select(F.col(item).cast("string").alias("name"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = docs
    for number in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == number)
        out = _scan(out, part, width, text, first=number == 0)
    return out


def _scan(docs: DataFrame, items: DataFrame, width: int, text: str, first: bool) -> DataFrame:
    rows = [(r["name"], r["text"].encode() if r["text"] else b"") for r in items.collect()]  # at most about BLOCK_BYTES
    windows = docs.sparkSession.sparkContext.broadcast(Windows(rows, width))
    added = [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", SPANS),
        T.StructField("items", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType()),
    ]

    def step(batches):
        scan = windows.value.scan
        for values, batch in batches:
            totals, hits, spans, owners = [], [], [], []
            for i, value in enumerate(values[0]):
                found = words(value)
                own, names = scan(found)
                if not first:
                    own = merge([*own, *((s["begin"], s["end"]) for s in values[1][i])])
                    names |= {n.decode() if isinstance(n, bytes) else n for n in values[2][i]}
                totals.append(len(found))
                hits.append(sum(end - begin for begin, end in own))
                spans.append([{"begin": begin, "end": end} for begin, end in own])
                owners.append(sorted(names))
            yield [totals, hits, spans, owners, [n > 0 for n in hits]], batch

    return with_columns(docs, [text] if first else [text, "spans", "items"], added, step)


def remove_leaks(found: DataFrame, text: str = "text", whole: bool = False) -> DataFrame:
    """Cut the spans that ``find_leaks`` marked out of the texts, or drop contaminated documents ``whole``.

    A cut goes from the first to the last word of a span and leaves the
    characters around it; the columns of ``find_leaks`` go too.  Clean texts stay as they are, null included.
    """
    marks = ["n_words", "n_hit", "items", "contaminated"]
    if whole:
        return found.filter(~F.col("contaminated")).drop("spans", *marks)

    def step(batches):
        for (texts, spans), batch in batches:
            yield [[t if not s else cut(t, [(x["begin"], x["end"]) for x in s]) for t, s in zip(texts, spans)]], batch

    return with_columns(found, [text, "spans"], [T.StructField(text, T.StringType())], step).drop("spans", *marks)


def cut(text: bytes, spans: list[tuple[int, int]]) -> str:
    flat = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    edges = np.diff(np.concatenate([[0], flat.astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out, at = [], 0
    for begin, end in spans:
        out.append(text[at : begins[begin]])
        at = ends[end - 1]
    return b"".join([*out, text[at:]]).decode()
