"""Line dedup with two Bloom filters: hashes seen once, hashes seen twice.

Line hashes go to segments by their leading bits.  Each segment streams its
hashes through a filter of those seen once; a hash found there enters the
filter of those seen twice.  Only lines in the second filter can repeat: they
alone are shuffled with a 128-bit digest, counted exactly, and given a first
occurrence.  A false positive costs a shuffled row, never a wrong result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import kept, map_slices, plain, require, with_columns

SPACE = b" \t\n\x0b\x0c\r"
#: Bits for each hash in the first filter, hashes for each segment, and hash functions.
BITS_PER_HASH, HASHES_PER_SEGMENT, PROBES = 12, 1 << 21, 4
#: Most bits of the second filter, which is broadcast.
MOST_BITS = 1 << 29
#: Hashes a task gathers before it hands them on.
GATHERED = 1 << 18
#: Most repeated lines that are broadcast (40 bytes each); more are joined.
MOST_BROADCAST = 1 << 20
NO_DOCUMENT = -(1 << 63)


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def digests(text: bytes | None) -> list[bytes | None]:
    """A digest of the key of each line; None for an empty key."""
    from xxhash import xxh3_128_digest

    keys = map(line_key, (text or b"").split(b"\n"))
    return [xxh3_128_digest(k) if k else None for k in keys]


def head(found: list[bytes]) -> np.ndarray:
    """The leading 64 bits of each digest."""
    return np.frombuffer(b"".join(found), ">u8")[::2].astype(np.uint64)


# --- filters ------------------------------------------------------------------


def places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Bit positions of each hash, one array for each hash function; bits is a power of two."""
    step = (hashes * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for probe in range(PROBES):
        yield (hashes + np.uint64(probe) * step) & np.uint64(bits - 1)


def contains(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at in places(hashes, bits):
        found &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def insert(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    for at in places(hashes, bits):
        np.bitwise_or.at(bitmap, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def power_of_two(n: float) -> int:
    return 1 << max(10, int(np.ceil(np.log2(max(n, 1)))))


def gathered(docs: DataFrame, text: str) -> DataFrame:
    """Line hashes of all documents, each document's once, in rows of many:
    ``single`` (met in one document of the row) and ``double`` (in several)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def row():
            hashes, times = np.unique(np.concatenate(held), return_counts=True)
            single, double = hashes[times == 1], hashes[times > 1]
            return pa.RecordBatch.from_pydict({"single": [single.tobytes()], "double": [double.tobytes()]})

        for batch in map_slices(batches):
            for value in plain(batch.column(0)):
                found = {d for d in digests(value) if d is not None}
                if found:
                    held.append(head(list(found)))
                    n += len(found)
                if n >= GATHERED:
                    yield row()
                    held, n = [], 0
        if held:
            yield row()

    return docs.select(text).mapInArrow(run, "single binary, double binary")


def seen_twice(hashes: DataFrame, n_hashes: int) -> tuple[np.ndarray, int, int]:
    """The second filter: its bitmap by segment, bits of a segment, segments."""
    segments = 1 << max(3, int(np.ceil(np.log2(max(1, n_hashes / HASHES_PER_SEGMENT)))))
    first_bits = power_of_two(BITS_PER_HASH * n_hashes / segments)
    second_bits = max(1 << 10, min(first_bits, MOST_BITS // segments))

    def split(batches):
        for batch in batches:
            for single, double in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = {}
                for name, data in (("single", single), ("double", double)):
                    values = np.frombuffer(data, np.uint64)
                    owner = (values >> np.uint64(32)) & np.uint64(segments - 1)
                    order = np.argsort(owner, kind="stable")
                    cuts = np.searchsorted(owner[order], np.arange(1, segments))
                    parts[name] = [p.tobytes() for p in np.split(values[order], cuts)]
                yield pa.RecordBatch.from_pydict({"segment": pa.array(range(segments), pa.int32()), **parts})

    def build(group: pa.Table) -> pa.Table:
        once, twice = np.zeros(first_bits // 8, np.uint8), np.zeros(second_bits // 8, np.uint8)
        for single, double in zip(group["single"].to_pylist(), group["double"].to_pylist()):
            single, double = np.frombuffer(single, np.uint64), np.frombuffer(double, np.uint64)
            insert(twice, double, second_bits)
            insert(twice, single[contains(once, single, first_bits)], second_bits)
            insert(once, np.concatenate([single, double]), first_bits)
        return pa.table({"segment": group["segment"][:1], "bitmap": pa.array([twice.tobytes()], pa.binary())})

    dealt = hashes.mapInArrow(split, "segment int, single binary, double binary")
    built = dealt.groupBy("segment").applyInArrow(build, "segment int, bitmap binary")
    bitmap = np.zeros((segments, second_bits // 8), np.uint8)
    for segment, data in built.collect():  # at most MOST_BITS together
        bitmap[segment] = np.frombuffer(data, np.uint8)
    return bitmap, second_bits, segments


def suspected(bitmap: np.ndarray, bits: int, segments: int, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the second filter has."""
    owner = (hashes >> np.uint64(32)) & np.uint64(segments - 1)
    found = np.ones(len(hashes), bool)
    for at in places(hashes, bits):
        found &= (bitmap[owner, at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


# --- the operator -----------------------------------------------------------------


def repeated_lines(docs: DataFrame, min_docs: int, key: str = "doc_id", text: str = "text",
                   long_words: int | None = None) -> DataFrame:
    """digest, n_docs, first_doc, first_line of each line key found in at least ``min_docs`` (2 or more)
    documents, or in two if it has more than ``long_words`` words."""
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    require(docs, key, text)
    context = docs.sparkSession.sparkContext
    hashes = kept(gathered(docs, text), "line-hashes")
    n_hashes = hashes.agg(F.sum(F.octet_length("single") + F.octet_length("double"))).first()[0] or 0
    filters = context.broadcast(seen_twice(hashes, n_hashes // 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, first, passages = Counter(), {}, set()

        def rows():
            found = list(count)
            return pa.RecordBatch.from_pydict({
                "digest": pa.array(found, pa.binary()),
                "n_docs": pa.array([count[d] for d in found], pa.int64()),
                "first_doc": pa.array([first[d][0] for d in found], pa.int64()),
                "first_line": pa.array([first[d][1] for d in found], pa.int64()),
                "passage": pa.array([d in passages for d in found], pa.bool_()),
            })

        for batch in map_slices(batches):
            numbers, own = plain(batch.column(0)), []
            for number, value in zip(numbers, plain(batch.column(1))):
                at = {}
                for line, digest in enumerate(digests(value)):
                    if digest is not None:
                        at.setdefault(digest, line)
                parts = [] if long_words is None else value.split(b"\n") if value else []
                own.append((NO_DOCUMENT if number is None else number, at, parts))
            every = [d for _, at, _ in own for d in at]
            if every:
                keep = iter(suspected(*filters.value, head(every)).tolist())
                for number, at, parts in own:
                    for digest, line in at.items():
                        if next(keep):
                            if parts and digest not in count and len(parts[line].split()) > long_words:
                                passages.add(digest)
                            count[digest] += 1
                            first[digest] = min(first.get(digest, (number, line)), (number, line))
            if len(count) >= GATHERED:
                yield rows()
                count, first, passages = Counter(), {}, set()
        if count:
            yield rows()

    schema = "digest binary, n_docs long, first_doc long, first_line long, passage boolean"
    counted = docs.select(F.col(key).cast("long"), text).mapInArrow(run, schema)
    place = F.min(F.struct("first_doc", "first_line"))
    exact = counted.groupBy("digest").agg(F.sum("n_docs").alias("n_docs"), place.alias("place"), F.max("passage").alias("passage"))
    return exact.filter(F.col("n_docs") >= F.when(F.col("passage"), 2).otherwise(min_docs)).select("digest", "n_docs", "place.*")


def drop_repeated_lines(docs: DataFrame, min_docs: int = 2, keep_first: bool = True, key: str = "doc_id",
                        text: str = "text", most_broadcast: int = MOST_BROADCAST, long_words: int | None = None) -> DataFrame:
    """Remove lines whose key is found in at least ``min_docs`` documents, or in
    two if ``long_words`` is given and the line has more words than that.

    Lines end at a line feed; a line's key is the line without white space at
    its ends and with A-Z lower-cased.  Empty keys never repeat.  With
    ``keep_first`` the occurrence in the smallest document key, and there the
    first one, stays; the others go, also those in the same document.  Without
    it every occurrence goes.  The other lines stay as they are, joined by line feeds.

    Adds n_lines (before) and n_dropped, and replaces the text; other columns
    stay, those named like an added one are replaced.  A null or empty text is
    one empty line and becomes an empty text.  A row is a document: rows that
    repeat count each, and rows with equal keys both keep a first occurrence
    that they share.  A null key comes before all others.  Long texts are
    worked on whole; an empty table stays empty.
    """
    repeated = kept(repeated_lines(docs, min_docs, key, text, long_words), "repeated-lines")
    if repeated.count() > most_broadcast:
        return _drop_by_join(docs, repeated, keep_first, key, text)
    rows = sorted(map(tuple, repeated.select("digest", "first_doc", "first_line").collect()))
    table = {bytes(digest): (doc, line) for digest, doc, line in rows}
    known = docs.sparkSession.sparkContext.broadcast(table)

    def step(batches):
        first = known.value
        for (numbers, texts), batch in batches:
            totals, dropped, left = [], [], []
            for number, value in zip(numbers, texts):
                number = NO_DOCUMENT if number is None else number
                lines, stay = (value or b"").split(b"\n"), []
                for at, (line, digest) in enumerate(zip(lines, digests(value))):
                    place = first.get(digest)
                    if place is None or keep_first and place == (number, at):
                        stay.append(line)
                totals.append(len(lines))
                dropped.append(len(lines) - len(stay))
                left.append(b"\n".join(stay).decode())
            yield [totals, dropped, left], batch

    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField(text, T.StringType())]
    return with_columns(docs, [key, text], added, step)


def _drop_by_join(docs: DataFrame, repeated: DataFrame, keep_first: bool, key: str, text: str) -> DataFrame:
    """The same, with the repeated lines' places joined back to the documents."""
    own = [f"_c{i}" for i in range(len(docs.columns))]  # no name of the input can clash with those below
    named = docs.toDF(*own)
    at_key, at_text = own[docs.columns.index(key)], own[docs.columns.index(text)]
    marked = with_columns(
        named, [at_text], [T.StructField("_digests", T.ArrayType(T.BinaryType()))],
        lambda rows: (([[digests(t) for t in texts]], batch) for (texts,), batch in rows),
        carry=[at_key, at_text],
    )
    number = F.coalesce(F.col(at_key).cast("long"), F.lit(NO_DOCUMENT))
    digest = F.sha2(F.coalesce(at_text, F.lit("")), 256)
    row = marked.select(number.alias("_doc"), digest.alias("_text"), F.posexplode("_digests").alias("_line", "digest"))
    hits = row.distinct().join(repeated, "digest")
    if keep_first:
        hits = hits.filter((F.col("_doc") != F.col("first_doc")) | (F.col("_line") != F.col("first_line")))
    drops = hits.groupBy("_doc", "_text").agg(F.collect_set(F.col("_line").cast("long")).alias("_drop"))
    lines = F.split(F.coalesce(at_text, F.lit("")), "\n", -1)
    joined = named.withColumns({"_doc": number, "_text": digest, "_lines": lines}).join(drops, ["_doc", "_text"], "left")
    gone = F.coalesce("_drop", F.array().cast("array<bigint>"))
    # the positions that stay, told apart without a search through the list for each line
    left = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("_lines").cast("long") - 1), gone)
    stay = F.transform(left, lambda i: F.element_at("_lines", (i + 1).cast("int")))
    added = {"n_lines": F.size("_lines").cast("long"), "n_dropped": F.size(gone).cast("long"), text: F.array_join(stay, "\n")}
    others = {name: c for c, name in zip(own, docs.columns) if name not in added}
    return joined.select(*others.values(), *added.values()).toDF(*others, *added)
