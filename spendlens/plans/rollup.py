"""Pages from states that are kept load by load.

A load adds the sums and counts of its rows alone, by day, campaign and
placement and by SKU.  Pages merge the states of all loads: a sum of sums, or a
sum of sums by a sum of counts for means.  What a page reads then grows with
days, campaigns and SKUs, not with report rows.  Numbers of different campaigns
do not add up, so each day keeps a sketch of its campaigns; sketches of any days merge.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.checks import check_metric
from spendlens.functions.values import sum_or_zero
from spendlens.operators.filters import Day, between_dates, drop_missing
from spendlens.schema import METRICS
from spendlens.sources import snapshots

DAY_KEYS = ("date", "campaign_id", "placement_type")
SKU_KEYS = ("promoted_sku",)
#: Accuracy of the sketches: 2^12 registers, a standard error of 1.6 % (1.04 divided by the root of the registers).
SKETCH_BITS = 12


def partial_states(campaign: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum and number of values of each metric by key; a missing key is a key of its own."""
    sums = [part for m in METRICS for part in (F.sum(m).alias(f"{m}_sum"), F.count(m).alias(f"{m}_count"))]
    return campaign.groupBy(*keys).agg(*sums)


def id_states(campaign: DataFrame) -> DataFrame:
    """(date, campaigns): a HyperLogLog sketch of each day's campaigns; rows without a date have one together."""
    return campaign.groupBy("date").agg(F.hll_sketch_agg("campaign_id", SKETCH_BITS).alias("campaigns"))


def add_load(spark: SparkSession, name: str, campaign: DataFrame, fresh: bool = False) -> None:
    """Add the states of one load's rows under a name; ``fresh`` starts anew.  All of them count, or none."""
    states = {"days": partial_states(campaign, DAY_KEYS), "skus": partial_states(campaign, SKU_KEYS), "ids": id_states(campaign)}
    snapshots.add(spark, name, states, fresh)


def _added(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    return states.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in states.columns if c not in keys])


def compact(spark: SparkSession, name: str) -> None:
    """Merge the states of all loads into one; readers of the older version keep it.

    A load has one row for each key, so the states of a day that no other load
    has are merged already: they are copied as they are.  Only those of days
    that several loads share, among them rows without a date, are shuffled."""
    days, ids = day_states(spark, name), campaign_states(spark, name)
    # one sketch per load and day; no more rows than the calendar has days
    loads = ids.groupBy(F.col("date").alias("day")).agg(F.count(F.lit(1)).alias("loads"))
    shared = F.broadcast(loads.filter("loads > 1").select("day"))
    same_day = F.col("date").eqNullSafe(F.col("day"))
    merged = {
        "days": days.join(shared, same_day, "left_anti").unionByName(_added(days.join(shared, same_day, "left_semi"), DAY_KEYS)),
        "skus": _added(sku_states(spark, name), SKU_KEYS),
        "ids": ids.groupBy("date").agg(F.hll_union_agg("campaigns").alias("campaigns")),
    }
    snapshots.add(spark, name, merged, fresh=True)


def day_states(spark: SparkSession, name: str) -> DataFrame:
    """States by date, campaign and placement: of the trend, comparison, overview and placement pages."""
    return snapshots.read(spark, name, "days")


def sku_states(spark: SparkSession, name: str) -> DataFrame:
    """States by SKU."""
    return snapshots.read(spark, name, "skus")


def campaign_states(spark: SparkSession, name: str) -> DataFrame:
    """Sketches of campaigns by date: of the basic facts."""
    return snapshots.read(spark, name, "ids")


def merged_facts(states: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    """Basic facts of any days from their sketches, one row: the first and last
    date exactly, the number of campaigns within about 1.6 % (``SKETCH_BITS``;
    exact for small numbers).  Without a bound rows without a date count too, as in
    ``basic_facts``, which stays the exact way; no days give 0 campaigns."""
    if start is not None or end is not None:
        states = between_dates(states, start, end)
    estimate = F.hll_sketch_estimate(F.hll_union_agg("campaigns"))
    return states.agg(
        F.coalesce(estimate, F.lit(0).cast("long")).alias("n_campaigns"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
    )


def _merged(metric: str) -> Column:
    if METRICS[check_metric(metric)].kind == "mean":
        return F.try_divide(F.sum(f"{metric}_sum").cast("double"), F.sum(f"{metric}_count").cast("double"))
    return sum_or_zero(f"{metric}_sum")


def merged_metrics(states: DataFrame, keys: Sequence[str], metrics: Iterable[str] = METRICS) -> DataFrame:
    """One row per key combination with the metrics by class, as ``grouped_metrics`` gives from report rows."""
    return drop_missing(states, keys).groupBy(*keys).agg(*[_merged(m).alias(m) for m in metrics])


def merged_sums(states: DataFrame, keys: Sequence[str], metrics: Iterable[str]) -> DataFrame:
    """One row per key combination; every metric is added up, whatever its class, as ``grouped_sums`` does."""
    return drop_missing(states, keys).groupBy(*keys).agg(*[sum_or_zero(f"{check_metric(m)}_sum").alias(m) for m in metrics])
