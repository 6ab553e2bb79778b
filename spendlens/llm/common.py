"""What the operators share: input tables, kept results, row-wise Arrow steps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.operators.lineage import shared_folder

#: Bytes of rows that a Python step handles at a time.
SLICE_BYTES = 2_000_000
#: Bytes of rows that Spark hands to a Python step at a time.
BATCH_BYTES = 8_000_000
#: Most rows of a few short columns that are broadcast.
MOST_BROADCAST = 1 << 21
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, with this package importable in the Python workers."""
    workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_import(spark: SparkSession) -> None:
    """Put the repository on the path of Python workers started from another folder, and keep what they hold at a
    time small: rows are handed over in batches of ``BATCH_BYTES``, and Arrow gives memory back that it has used."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        environment["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
    environment.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    environment.setdefault("MALLOC_ARENA_MAX", "2")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_folder(spark)}/llm-{kind}-{uuid.uuid4().hex}"


def kept(df: DataFrame, kind: str, compression: str = "zstd") -> DataFrame:
    """The table written to the shared folder and read back: computed once, and
    safe from lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, kind)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Marked for broadcast if it has at most ``most`` rows, else left to be shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def require(df: DataFrame, *columns: str) -> None:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"columns {lacking} are missing")


def with_columns(
    df: DataFrame,
    inputs: Sequence[str],
    added: Sequence[T.StructField],
    step: Callable[[Iterator[tuple[list, pa.RecordBatch]]], Iterator[tuple[Sequence, pa.RecordBatch]]],
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Append columns that a generator computes from Arrow batches.

    ``step`` gets (values of each input column, batch) and yields (values of
    each added column, the same batch).  ``carry`` names the columns to hand
    on, by default all; one with the name of an added column is replaced.
    Strings arrive as UTF-8 bytes.
    """
    names = {f.name for f in added}
    handed = [f for f in df.schema.fields if (carry is None or f.name in carry) and f.name not in names]
    needed = list(dict.fromkeys([*(f.name for f in handed), *inputs]))
    schema = T.StructType([*handed, *added])
    places = [needed.index(n) for n in inputs]
    kept_places = [needed.index(f.name) for f in handed]
    kinds = [arrow_type(f.dataType) for f in added]
    labels = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened():
            for batch in map_slices(batches):
                yield [plain(batch.column(i)) for i in places], batch

        for values, batch in step(opened()):
            columns = [batch.column(i) for i in kept_places]
            columns += [pa.array(v, kind) for v, kind in zip(values, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=labels)

    return df.select(*needed).mapInArrow(run, schema)


def map_slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about ``most`` bytes, so that what a step makes of them stays small."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def plain(column: pa.Array) -> list:
    """Python values of a column; strings as UTF-8 bytes."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
