"""Left join whose frequent keys are spread over many tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACKED_KEYS = 10_000  # size of the frequent-items sketch
MERGE_GROUPS = 512  # partial merges of the tasks' sketches


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _map(copies: dict[int, int]) -> Column:
    return F.map_from_arrays(
        F.array(*map(F.lit, copies)).cast("array<bigint>"), F.array(*map(F.lit, copies.values())).cast("array<int>")
    )


def heavy_keys(df: DataFrame, *key_lists: Sequence[str]) -> list[Column]:
    """For each key list, the keys that hold more rows than one task's even
    share: a map from their hash to the number of shares their rows are dealt in.

    One pass over the key columns with a sketch of fixed size per task; the
    sketches are merged in groups, then together.  There are fewer such keys
    than shuffle partitions; they become literals of the plan, so both sides
    of a join see the same ones.  Even data yields none, whatever the number of
    keys.  The map only steers how work is shared out.
    """
    tasks = _tasks(df)
    names = [f"h{i}" for i in range(len(key_lists))]
    hashed = df.select(
        F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("merge_group"),
        *[F.xxhash64(*keys).alias(n) for n, keys in zip(names, key_lists)],
    )
    grouped = hashed.groupBy("merge_group").agg(
        F.count(F.lit(1)).alias("rows"), *[F.expr(f"approx_top_k_accumulate({n}, {TRACKED_KEYS})").alias(n) for n in names]
    )
    # a grouping key, since the sketch cannot be merged over an empty partition
    row = grouped.groupBy(F.lit("all")).agg(F.sum("rows").alias("rows"), *[
        F.expr(f"approx_top_k_estimate(approx_top_k_combine({n}, {TRACKED_KEYS}), {min(tasks, TRACKED_KEYS)})").alias(n)
        for n in names
    ]).first()
    if row is None:
        return [_map({}) for _ in names]
    share = row["rows"] / tasks
    return [_map({i["item"]: math.ceil(i["count"] / share) for i in row[n] if i["count"] > share}) for n in names]


def known_keys(df: DataFrame, *keys: Sequence[str]) -> Column:
    """The same kind of map for keys known beforehand, each dealt in as many shares as there are tasks."""
    hashes = [F.xxhash64(*[F.lit(part) for part in key]) for key in keys]
    return F.map_from_arrays(F.array(*hashes), F.array(*[F.lit(_tasks(df)) for _ in keys]))


def salted_left_join(left: DataFrame, right: DataFrame, on: Sequence[str], heavy: Column,
                     heavy_on: Sequence[str] | None = None) -> DataFrame:
    """``left`` LEFT JOIN ``right`` with every row of ``left`` kept.

    ``heavy`` maps hashes over ``heavy_on`` (by default the join keys) to
    shares.  Rows of a frequent key are dealt out by their input partition and
    their values, and only the right rows of those keys are repeated once per
    share.  Neither depends on row order, so a task that is run again deals its
    rows the same way.
    """
    on = list(on)
    shares = F.coalesce(F.try_element_at(heavy, F.xxhash64(*(heavy_on or on))), F.lit(1))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(F.spark_partition_id(), *left.columns), shares).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), shares - 1)))
    return dealt.join(repeated, [*on, "_salt"], "left").drop("_salt")
