"""Substring dedup by relative Lempel-Ziv parsing.

A window is a run of ``width`` words.  The windows of a document that have the
same seed, the least hash of their ``SEED``-word runs, make a phrase: a run of
words that every other document with one of its windows cuts out around the
same seed.  The phrases of all documents are the reference blocks, each
indexed by its seed and a digest of its words; the block belongs to the
smallest document that has it.

Every document is parsed against all blocks, longest factors first: a phrase
that an earlier document has is one factor.  Blocks with a common seed and
different words are indexed by window, and the rest of a phrase is parsed
against those windows.  Neighbouring phrases overlap by a window less one word,
so no window that crosses the end of a factor is missed.  In the document,
factors of the same origin that meet become one; what they cover goes.

Only rows of a few numbers for each phrase are shuffled, and windows of blocks
that share a seed with others; the text travels once, to meet its factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import kept, map_slices, plain, require, with_columns
from spendlens.llm.lines import BITS_PER_HASH, HASHES_PER_SEGMENT, MOST_BITS, insert, power_of_two, suspected
from spendlens.operators.skew import heavy_keys, salted_left_join

#: Words of a seed.  Shorter ones make fewer, longer phrases, and more blocks share one by chance.
SEED = 12
#: Bytes of text hashed at a time.
PIECE = 1 << 19
NO_KEY = -(1 << 63)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Odd bases of the hashes: of a word's bytes, of seeds, of windows.
BYTE_BASE, SEED_BASE, WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F

FACTORS = T.ArrayType(T.StructType([
    T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("origin", T.LongType()),
]))


# --- hashes -----------------------------------------------------------------------


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def up_to(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1); tables of the usual lengths are kept."""
    return powers(base, PIECE + 1)[:n] if n <= PIECE + 1 else powers.__wrapped__(base, n)


def mixed(values: np.ndarray) -> np.ndarray:
    out = (values ^ (values >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)
    return out ^ (out >> np.uint64(29))


class Runs:
    """Hashes of any runs of a sequence of numbers, from its prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up_to(base, n), dtype=np.uint64, out=self.sums[1:])
        self.back = up_to(pow(base, -1, 1 << 64), n)

    def of(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[begins]) * self.back[begins])


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text."""
    out, begin = [], 0
    while begin < len(text):
        end = begin + PIECE
        while end < len(text) and not SPACES[text[end]]:  # a piece ends at white space
            end += 1
        data = np.frombuffer(text, np.uint8, min(end, len(text)) - begin, begin)
        edges = np.diff(np.concatenate([[True], SPACES[data], [True]]).astype(np.int8))
        begins, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        if len(begins):
            out.append(Runs(data.astype(np.uint64) + np.uint64(1), BYTE_BASE).of(begins, ends))
        begin = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


class Phrases:
    """The phrases of some texts: arrays of their text's number, first window, windows, seed and digest."""

    def __init__(self, texts: list[bytes | None], width: int):
        # as one text: a line feed lies between, and no window crosses it
        joined = b"\n".join(t or b"" for t in texts)
        sizes = np.array([len((t or b"").split()) for t in texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])  # of the words of each text
        words = word_hashes(joined)
        seed = min(SEED, width)
        self.width, n = width, max(0, len(words) - width + 1)
        self.windows = Runs(words, WINDOW_BASE)
        owner = np.repeat(np.arange(len(texts)), sizes)
        inside = np.flatnonzero(owner[:n] == owner[width - 1 : width - 1 + n])
        at = np.arange(max(0, len(words) - seed + 1))
        least = least_in(Runs(words, SEED_BASE).of(at, at + seed), width - seed + 1)[inside] if n else np.zeros(0, np.uint64)
        new = np.ones(len(inside), bool)
        new[1:] = (np.diff(inside) != 1) | (np.diff(owner[inside]) != 0) | (least[1:] != least[:-1])
        heads = np.flatnonzero(new)
        begins = inside[heads]
        self.n = np.diff(np.concatenate([heads, [len(inside)]]))
        self.text = owner[begins]
        self.at = begins - self.first[self.text]
        self.seed = least[heads].view(np.int64)
        self.digest = self.windows.of(begins, begins + self.n + width - 1).view(np.int64)
        self.begins = begins

    def windows_of(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window of the chosen phrases: the phrase, its place in the text, its hash."""
        n = self.n[chosen]
        phrase = np.repeat(np.flatnonzero(chosen), n)
        step = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
        begins = self.begins[phrase] + step
        return phrase, self.at[phrase] + step, self.windows.of(begins, begins + self.width).view(np.int64)


def holder(seed: np.ndarray, digest: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A hash of a phrase and the document that has it."""
    parts = [np.asarray(x, np.int64).view(np.uint64) for x in (seed, digest, doc)]
    return mixed(mixed(mixed(parts[0]) + parts[1]) + parts[2])


# --- the index ----------------------------------------------------------------------


def parts_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc (the key, a null one before all others), tid (a hash of the text) and the text."""
    return docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("doc"), F.xxhash64(text).alias("tid"), F.col(text).alias("text")
    )


def phrases_of(parts: DataFrame, width: int) -> DataFrame:
    """doc, tid, at (first window), n (windows), seed, digest of each phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map_slices(batches, PIECE):
            found = Phrases(plain(batch.column(2)), width)
            yield pa.RecordBatch.from_pydict({
                "doc": batch.column(0).to_numpy()[found.text], "tid": batch.column(1).to_numpy()[found.text],
                "at": pa.array(found.at, pa.int32()), "n": pa.array(found.n, pa.int32()), "seed": found.seed, "digest": found.digest,
            })

    return parts.mapInArrow(run, "doc long, tid long, at int, n int, seed long, digest long")


def holders_filter(blocks: DataFrame) -> tuple[np.ndarray, int, int]:
    """A Bloom filter of blocks (seed, digest, doc): bitmap by segment, bits of a segment, segments.

    It ends at ``MOST_BITS``; a false positive costs some rows, never a wrong result.
    """
    n = blocks.count()
    segments = 1 << max(3, int(np.ceil(np.log2(max(1, n / HASHES_PER_SEGMENT)))))
    bits = max(1 << 10, min(power_of_two(BITS_PER_HASH * n / segments), MOST_BITS // segments))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = holder(*(batch.column(i).to_numpy() for i in range(3)))
            segment = (own >> np.uint64(32)) & np.uint64(segments - 1)
            yield pa.RecordBatch.from_pydict({"segment": segment.astype(np.int32), "own": own.view(np.int64)})

    def build(group: pa.Table) -> pa.Table:
        bitmap = np.zeros(bits // 8, np.uint8)
        insert(bitmap, group["own"].to_numpy().view(np.uint64), bits)
        return pa.table({"segment": group["segment"][:1], "bitmap": pa.array([bitmap.tobytes()], pa.binary())})

    dealt = blocks.select("seed", "digest", "doc").mapInArrow(hashed, "segment int, own long")
    bitmap = np.zeros((segments, bits // 8), np.uint8)
    for segment, data in dealt.groupBy("segment").applyInArrow(build, "segment int, bitmap binary").collect():  # MOST_BITS at most
        bitmap[segment] = np.frombuffer(data, np.uint8)
    return bitmap, bits, segments


def windows_in(parts: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    """doc, tid, at, n = 1, seed, digest of each window of these blocks, from the documents they belong to."""
    filters = parts.sparkSession.sparkContext.broadcast(holders_filter(blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map_slices(batches, PIECE):
            found = Phrases(plain(batch.column(2)), width)
            doc, tid = batch.column(0).to_numpy()[found.text], batch.column(1).to_numpy()[found.text]
            phrase, at, digest = found.windows_of(suspected(*filters.value, holder(found.seed, found.digest, doc)))
            yield pa.RecordBatch.from_pydict({
                "doc": doc[phrase], "tid": tid[phrase], "at": pa.array(at, pa.int32()),
                "n": pa.array(np.ones(len(at)), pa.int32()), "seed": found.seed[phrase], "digest": digest,
            })

    return parts.mapInArrow(run, "doc long, tid long, at int, n int, seed long, digest long")


def indexed(rows: DataFrame) -> DataFrame:
    """The blocks: seed, digest, doc (the smallest that has it), again (whether a larger one has it too)."""
    found = rows.groupBy("seed", "digest").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"))
    return found.select("seed", "digest", "doc", (F.col("last") > F.col("doc")).alias("again"))


def factors(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc, tid, at, n, origin of the rows whose block belongs to a smaller document."""
    again = blocks.filter("again").select("seed", "digest", F.col("doc").alias("origin"))
    on = ["seed", "digest"]
    met = salted_left_join(rows, again, on, *heavy_keys(rows, on))  # a passage may be in a third of all documents
    return met.filter(F.col("origin") < F.col("doc")).select("doc", "tid", "at", "n", "origin")


# --- the operator ---------------------------------------------------------------------


def chained(found: list[tuple[int, int, int]], width: int) -> list[tuple[int, int, int]]:
    """Greedy parse: begin, end, origin of the factors in order, none overlapping, from (at, n, origin)."""
    out: list[tuple[int, int, int]] = []
    for at, n, origin in sorted(found):
        end = at + n + width - 1
        begin, last, before = out[-1] if out else (0, 0, None)
        if origin == before and at <= last:
            out[-1] = begin, max(last, end), origin
        elif end > last:
            out.append((max(at, last), end, origin))
    return out


def drop_repeated_passages(docs: DataFrame, width: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove the words of every window of ``width`` words that also starts in a document with a smaller key.

    Words are runs of characters other than space, tab, line feed, vertical
    tab, form feed and carriage return, unchanged.  Windows are judged on the
    input.  Adds n_words (before), n_removed and factors (begin, end, origin:
    the word ranges removed, ends excluded, and a smaller document that has
    them), and replaces the text by the words left, joined by one space.  Other
    columns stay, whatever their names; one named like an added one is replaced.

    Null and empty texts have no words and become empty texts, texts of fewer
    words than ``width`` lose none.  A null key comes before all others (origin
    null).  Rows with equal keys do not remove from each other; rows that
    repeat get the same result each.  Long texts are worked on whole.
    """
    require(docs, key, text)
    if width < 1:
        raise ValueError("width must be at least 1")
    parts = parts_of(docs, key, text)
    phrases = kept(phrases_of(parts, width), "phrases")
    blocks = kept(indexed(phrases), "blocks")
    # blocks that share a seed are parsed window by window
    shared = blocks.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b"))
    mixed_blocks = kept(blocks.join(shared.filter("n > 1 AND a < b").select("seed"), "seed", "left_semi"), "mixed-blocks")
    windows = kept(windows_in(parts, mixed_blocks, width), "windows")
    spans = factors(phrases, blocks).union(factors(windows, kept(indexed(windows), "window-blocks")))
    # windows that follow each other and have one origin travel as one
    step = F.struct("at", "n", "origin")
    found = spans.groupBy(F.col("doc").alias("_doc"), F.col("tid").alias("_tid")).agg(F.collect_list(step).alias("_found"))
    return _removed(docs, kept(found, "factors"), width, key, text)


def _removed(docs: DataFrame, found: DataFrame, width: int, key: str, text: str) -> DataFrame:
    # under names of our own, so that no column of the input can clash
    own = [f"_c{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*own)
    at_key, at_text = own[docs.columns.index(key)], own[docs.columns.index(text)]
    doc, tid = F.coalesce(F.col(at_key).cast("long"), F.lit(NO_KEY)), F.xxhash64(at_text)
    joined = named.join(found, (doc == F.col("_doc")) & (tid == F.col("_tid")), "left")

    def step(batches):
        for (texts, lists), batch in batches:
            totals, gone, spans, left = [], [], [], []
            for value, own_spans in zip(texts, lists):
                words = (value or b"").split()
                parsed = chained([(s["at"], s["n"], s["origin"]) for s in own_spans or ()], width)
                stay, last = [], 0
                for begin, end, _ in parsed:
                    stay += words[last:begin]
                    last = end
                stay += words[last:]
                totals.append(len(words))
                gone.append(len(words) - len(stay))
                spans.append([{"begin": b, "end": e, "origin": None if o == NO_KEY else o} for b, e, o in parsed])
                left.append(b" ".join(stay).decode())
            yield [totals, gone, spans, left], batch

    added = [
        T.StructField("_words", T.LongType()), T.StructField("_removed", T.LongType()),
        T.StructField("_factors", FACTORS), T.StructField("_left", T.StringType()),
    ]
    done = with_columns(joined, [at_text, "_found"], added, step, carry=[c for c in own if c != at_text])
    new = {"n_words": "_words", "n_removed": "_removed", "factors": "_factors", text: "_left"}
    columns = [F.col(new.pop(name, c)).alias(name) for name, c in zip(docs.columns, own)]
    return done.select(*columns, *[F.col(c).alias(name) for name, c in new.items()])
