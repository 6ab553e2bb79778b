"""Byte-level BPE with a rank queue under a hierarchical bitmap.

The parts of a pre-token form a linked list.  Each adjacent pair that has a
merge rank waits in that rank's bucket.  A bitmap of three levels marks the
buckets in use: finding its first set bit gives the lowest rank in a few steps,
however long the pre-token is.  Entries whose pair has changed are skipped.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spendlens.llm.common import require, with_columns
from spendlens.llm.words import REMEMBERED, Memory, by_bytes, is_open, owned

#: Bytes of pre-tokens that share a run of the queue; a longer pre-token has its own.
GROUP_BYTES = 100_000


class RankQueue:
    """Buckets of positions by rank, and a bitmap of the buckets in use."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)
        self.high = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
        else:
            self.fill(rank, [position])

    def fill(self, rank: int, positions: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = positions
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.middle[word >> 6] |= 1 << (word & 63)
        self.high |= 1 << (word >> 6)

    def first(self) -> int:
        """The lowest rank with a bucket: the first set bit, level by level."""
        block = (self.high & -self.high).bit_length() - 1
        bits = self.middle[block]
        word = (block << 6) | ((bits & -bits).bit_length() - 1)
        bits = self.low[word]
        return (word << 6) | ((bits & -bits).bit_length() - 1)

    def drop(self, rank: int) -> None:
        """Remove an empty bucket."""
        del self.buckets[rank]
        word = rank >> 6
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.middle[word >> 6] &= ~(1 << (word & 63))
            if not self.middle[word >> 6]:
                self.high &= ~(1 << (word >> 6))


class Bpe:
    """Encoding by merge ranks: ``ranks`` maps the bytes of a token to its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        import regex

        self.ranks = ranks
        self.tokens = {number: token for token, number in ranks.items()}
        self.pretokens = regex.compile(pattern).findall
        self.of_two = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)  # empty again after each call
        self.known, self.heads, self.tails = Memory(remembered), Memory(remembered // 4), Memory(remembered)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token; many share one run of the queue."""
        ranks, queue, buckets = self.ranks, self.queue, self.queue.buckets
        out = [[ranks[p]] if p in ranks else [] for p in pieces]
        open_pieces = [p for p, ids in zip(pieces, out) if p and not ids]
        if not open_pieces:
            return out
        data = b"".join(open_pieces)
        n = len(data)
        starts = np.cumsum([0, *map(len, open_pieces)])
        edge = np.zeros(n + 1, bool)  # where a pre-token begins
        edge[starts] = True
        byte = np.frombuffer(data, np.uint8).astype(np.int64)
        two = np.full(n, -1)
        two[:-1] = self.of_two[byte[:-1] * 256 + byte[1:]]
        two[edge[1:]] = -1
        order = np.argsort(two, kind="stable")
        order = order[np.searchsorted(two[order], 0) :]
        if len(order):
            for positions in np.split(order, np.flatnonzero(np.diff(two[order])) + 1):
                queue.fill(int(two[positions[0]]), positions.tolist())
        edge, pair = edge.tolist(), two.tolist()  # pair: rank of the part that begins here and the next one together
        after = list(range(1, n + 1))  # where the part that begins here ends
        before = list(range(-1, n))  # where the part before it begins
        while queue.high:
            rank = queue.first()
            bucket = buckets[rank]
            bucket.sort(reverse=True)
            while bucket:
                i = bucket.pop()
                if pair[i] != rank:  # a part of this pair has grown or gone since
                    continue
                gone = after[i]
                end = after[i] = after[gone]
                pair[gone] = pair[i] = -1
                lower = False
                if not edge[end]:
                    before[end] = i
                    found = ranks.get(data[i : after[end]])
                    if found is not None:
                        pair[i] = found
                        queue.push(found, i)
                        lower = found < rank
                if not edge[i]:
                    left = before[i]
                    found = ranks.get(data[left:end])
                    if found is None:
                        pair[left] = -1
                    else:
                        pair[left] = found
                        queue.push(found, left)
                        lower |= found < rank
                if lower:  # it goes first
                    break
            if not bucket:
                queue.drop(rank)
        ends = iter(starts[1:].tolist())
        i = 0
        for ids in out:
            if not ids:
                stop = next(ends, i)
                while i < stop:
                    ids.append(ranks[data[i : after[i]]])
                    i = after[i]
        return out

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        found = []
        for group in by_bytes(map(str.encode, pieces), GROUP_BYTES):
            found += map(raw, self.encode_pieces(group))
        return found

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, its pre-tokens one by one, as 32-bit numbers."""
        pieces = [self.pretokens(t) for t in texts]
        self.known.learn(pieces, self.ids_of)
        return [b"".join(map(self.known.__getitem__, p)) for p in pieces]

    def after_space(self, parts: list[str]) -> list[bytes | None]:
        """Ids of each part behind a space; None where the next space joins in.

        The parts are cut into pre-tokens together: only a part's first one has the space.
        """
        closed = [p for p in parts if not is_open(p)]
        pieces = []
        for group in by_bytes(closed, GROUP_BYTES):
            pieces += self.pretokens(" " + " ".join(group))
        self.known.learn([pieces], self.ids_of)
        ids = list(map(self.known.__getitem__, pieces))
        begins = [i for i, p in enumerate(pieces) if p[0] == " "]
        found = [b"".join(ids[a:b]) for a, b in zip(begins, [*begins[1:], len(ids)])]
        by_part = dict(zip(closed, found, strict=True))
        return [by_part.get(p) for p in parts]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The same, remembering the ids of what stands between spaces."""
        parts = [t.split(" ") for t in texts]
        self.heads.learn(([p[0]] for p in parts), self.encode_all)
        self.tails.learn((p[1:] for p in parts), self.after_space)
        out = []
        for text, (head, *rest) in zip(texts, parts):
            ids = [self.heads[head], *map(self.tails.__getitem__, rest)]
            if rest and (is_open(head) or None in ids):  # a run of white space with a space in it
                ids = self.encode_all([text])
            out.append(b"".join(ids))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def raw(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def from_file(path: str, pattern: str, remembered: int = REMEMBERED) -> Bpe:
    """This worker's encoder of a rank file."""

    def read() -> Bpe:
        with open(path, "rb") as lines:
            return Bpe({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern, remembered)

    return owned(("bpe", path, pattern, remembered), read)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of each text by the rank file ``path``, each match of
    ``pattern`` encoded by itself, without special tokens.

    A null or empty text has no ids.  Other columns stay; one named ``ids`` is replaced.
    """
    require(docs, text)

    def step(rows):
        bpe = from_file(path, pattern)
        for (texts,), batch in rows:
            found = bpe.encode_texts([(t or b"").decode() for t in texts])
            yield [[np.frombuffer(i, "<u4").astype(np.int32) for i in found]], batch

    return with_columns(docs, [text], [T.StructField(ids, T.ArrayType(T.IntegerType()))], step)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the text of each list of ids; a null list gives a null text.

    The bytes must be UTF-8, as those of any encoded text are.  Fails on an id
    that the file does not have.
    """
    require(encoded, ids)

    def step(rows):
        bpe = from_file(path, pattern)
        for (lists,), batch in rows:
            yield [[None if i is None else bpe.decode(i).decode() for i in lists]], batch

    return with_columns(encoded, [ids], [T.StructField(text, T.StringType())], step)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode, and keep digests alone: ``key``, n_tokens, ids_sha256
    (of the decimal ids joined by a space), decoded_sha256 (of the decoded bytes).

    A null or empty text has no ids: 0, and twice the digest of nothing.  Long
    texts are encoded whole, rows that repeat alike; no other column is read.
    """
    require(docs, key, text)
    added = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]

    def step(rows):
        bpe = from_file(path, pattern)
        decimal = {number: str(number) for number in bpe.tokens}.__getitem__
        for (texts,), batch in rows:
            counts, written, read = [], [], []
            for found in bpe.encode_texts([(t or b"").decode() for t in texts]):
                ids = np.frombuffer(found, "<u4").tolist()
                counts.append(len(ids))
                written.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                read.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield [counts, written, read], batch

    return with_columns(docs, [text], added, step, carry=[key])


def encode_checked(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text",
                   remembered: int = REMEMBERED) -> DataFrame:
    """``key``, ids, n_tokens, and round_trip: whether decoding the ids gives the text, a null one counting as empty.

    Workers remember the ids of about ``remembered`` stretches of text: fewer take less memory and more time.
    """
    require(docs, key, text)
    added = [
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
        T.StructField("round_trip", T.BooleanType()),
    ]

    def step(rows):
        bpe = from_file(path, pattern, remembered)
        for (texts,), batch in rows:
            found = [np.frombuffer(i, "<u4").astype(np.int32) for i in bpe.encode_texts([(t or b"").decode() for t in texts])]
            same = [bpe.decode(ids.tolist()) == (t or b"") for ids, t in zip(found, texts)]
            yield [found, list(map(len, found)), same], batch

    return with_columns(docs, [text], added, step, carry=[key])
