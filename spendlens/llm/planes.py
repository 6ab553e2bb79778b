"""Token ids on disk: fixed-size blocks of ids, transposed into byte or bit planes.

A data set is a folder of two Parquet tables without further compression.
``chunks`` has a row for each run of whole documents of one shard, in document
order: ``doc_ids`` and ``lengths`` of the documents, ``first`` (ids of the
shard before the run), and ``payload``: the run's ids in blocks of ``block``
ids, each block transposed into planes, each plane compressed by itself with
zstandard.  ``index`` of a row lists where each plane begins and ends in the
payload, so a reader can take one block alone.  ``shards`` has the number of
ids before each shard.  Spark commits the files, so a task that is lost and
run again leaves no trace.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import arrow_type, map_slices, plain, require
from spendlens.llm.counts import BATCH_CHARS, tokenizer
from spendlens.llm.words import IdTable, by_bytes, owned

#: Ids in a block, and the ids after which a run of documents is closed.
BLOCK, CHUNK = 1 << 16, 1 << 20
#: Parts of texts that are encoded as one text, and parts whose ids a worker remembers.
TOGETHER, REMEMBERED = 200, 600_000
CHUNKS = T.StructType([
    T.StructField("shard", T.LongType()),
    T.StructField("first", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("n_ids", T.LongType()),
    T.StructField("block", T.IntegerType()),
    T.StructField("bits", T.BooleanType()),
    T.StructField("index", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("payload", T.BinaryType()),
])


# --- ids <-> planes -----------------------------------------------------------


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of one block, lowest first, without the empty ones above the largest id."""
    plain_bytes = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length()
    if not bits:
        return [plain_bytes[:, i].tobytes() for i in range((top + 7) // 8)]
    spread = np.unpackbits(plain_bytes, axis=1, bitorder="little")
    return [np.packbits(spread[:, i], bitorder="little").tobytes() for i in range(top)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        out = np.zeros((n, 4), np.uint8)
        for i, plane in enumerate(planes):
            out[:, i] = np.frombuffer(plane, np.uint8)
        return out.view("<u4").ravel()
    spread = np.zeros((n, 32), np.uint8)
    for i, plane in enumerate(planes):
        spread[:, i] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
    return np.packbits(spread, axis=1, bitorder="little").view("<u4").ravel()


def pack(ids: np.ndarray, block: int, bits: bool) -> tuple[list[list[int]], bytes]:
    """Payload of a run of ids, and for each block the places of its planes in it."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    index, parts, at = [], [], 0
    for begin in range(0, len(ids), block):
        places = [at]
        for plane in to_planes(ids[begin : begin + block], bits):
            parts.append(squeeze(plane))
            at += len(parts[-1])
            places.append(at)
        index.append(places)
    return index, b"".join(parts)


def unpack(index: list[list[int]], payload: bytes, n_ids: int, block: int, bits: bool) -> np.ndarray:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    blocks = []
    for number, places in enumerate(index):
        planes = [expand(payload[a:b]) for a, b in zip(places, places[1:])]
        blocks.append(from_planes(planes, min(block, n_ids - number * block), bits))
    return np.concatenate(blocks) if blocks else np.zeros(0, "<u4")


# --- text -> ids ----------------------------------------------------------------


@cache
def begins_with_space(path: str) -> np.ndarray:
    found = tokenizer(path)
    marks = np.zeros(found.get_vocab_size(with_added_tokens=True), bool)
    for token, number in found.get_vocab().items():
        marks[number] = token.startswith("Ġ")  # how byte-level vocabularies write a space
    return marks


def raw(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def after_space(path: str, parts: list[str]) -> list[bytes | None]:
    """Ids of each part behind a space; None where the next space joins in.

    The parts are encoded together: only a part's first token has the space.
    """
    closed = [p for p in parts if p and not p[-1].isspace()]
    joined = [" " + " ".join(closed[i : i + TOGETHER]) for i in range(0, len(closed), TOGETHER)]
    found = []
    for batch in by_bytes(joined, BATCH_CHARS):
        for encoding in tokenizer(path).encode_batch_fast(batch, add_special_tokens=False):
            ids = np.array(encoding.ids, "<u4")
            begins = (np.flatnonzero(begins_with_space(path)[ids]) * 4).tolist()
            data = ids.tobytes()
            found += [data[a:b] for a, b in zip(begins, [*begins[1:], len(data)])]
    if len(closed) == len(parts):
        return found
    known = dict(zip(closed, found, strict=True))
    return [known.get(p) for p in parts]


def whole(path: str, texts: list[str]) -> list[bytes]:
    encode = tokenizer(path).encode_batch_fast
    batches = by_bytes(texts, BATCH_CHARS)
    return list(chain.from_iterable((raw(e.ids) for e in encode(b, add_special_tokens=False)) for b in batches))


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """Ids of each text as little-endian 32-bit numbers, as the library gives them."""
    table = owned(("planes", path), lambda: IdTable(partial(after_space, path), REMEMBERED))
    return table.encode(texts, partial(whole, path))


# --- data sets --------------------------------------------------------------------


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int, bits: bool = False,
              block: int = BLOCK, chunk: int = CHUNK, key: str = "doc_id", text: str = "text") -> None:
    """Encode the texts with a byte-level tokenizers file, append ``end_id`` to
    each, and write a data set to ``folder`` in ascending order of ``key``.

    A null text counts as empty and has ``end_id`` alone.  Null keys come
    first; rows with equal keys stand together, ordered by their text, each a document of its own.
    Other columns are not read.  An empty table makes a data set without rows.
    """
    require(docs, key, text)
    spark = docs.sparkSession
    names, kinds = CHUNKS.names, [arrow_type(f.dataType) for f in CHUNKS.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, held = TaskContext.get().partitionId(), 0, []

        def row(documents):
            ids = np.frombuffer(b"".join(d for _, d in documents), "<u4")
            index, payload = pack(ids, block, bits)
            values = (shard, first, [k for k, _ in documents], [len(d) // 4 for _, d in documents], len(ids), block,
                      bits, index, payload)
            return len(ids), pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

        end, size = raw([end_id]), 0
        for batch in map_slices(batches):
            texts = [(t or b"").decode() for t in plain(batch.column(1))]
            for number, ids in zip(plain(batch.column(0)), encode_texts(path, texts)):
                held.append((number, ids + end))
                size += len(ids) // 4 + 1
                if size >= chunk:
                    n, out = row(held)
                    yield out
                    first, held, size = first + n, [], 0
        if held:
            yield row(held)[1]

    order = docs.select(F.col(key).cast("long"), F.col(text))
    tie = F.xxhash64(text)
    ordered = order.repartitionByRange(F.col(key), tie).sortWithinPartitions(F.col(key), tie)
    ordered.mapInArrow(run, CHUNKS).write.option("compression", "none").parquet(f"{folder}/chunks")
    sizes = read_chunks(spark, folder).groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()  # one row per write task
    before, rows = 0, []
    for shard, n in sorted(sizes):
        rows.append((shard, before))
        before += n
    spark.createDataFrame(rows, "shard long, ids_before long").coalesce(1).write.parquet(f"{folder}/shards")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(f"{folder}/chunks")


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and ``ids``;
    with ``digest``, ``ids_crc32`` of the ids as little-endian 32-bit numbers in their place."""
    shards = spark.read.schema("shard long, ids_before long").parquet(f"{folder}/shards")
    last = ("ids_crc32", T.LongType()) if digest else ("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField(*last),
    ])
    kinds = [arrow_type(f.dataType) for f in schema.fields]

    def documents(row: dict) -> Iterable[tuple]:
        ids = unpack(row["index"], row["payload"], row["n_ids"], row["block"], row["bits"])
        data, at = ids.tobytes(), 0
        for number, n in zip(row["doc_ids"], row["lengths"]):
            found = zlib.crc32(data[4 * at : 4 * (at + n)]) if digest else ids[at : at + n].astype(np.int32)
            yield number, row["ids_before"] + row["first"] + at, n, found
            at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map_slices(batches):
            for row in batch.to_pylist():
                columns = zip(*documents(row))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=schema.names)

    # a row for each write task of the data set
    return read_chunks(spark, folder).join(F.broadcast(shards), "shard").mapInArrow(run, schema)
