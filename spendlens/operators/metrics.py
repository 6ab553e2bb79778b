"""Aggregations of report rows by key.

Every grouping drops rows whose key is missing, counts a sum without values
as 0 and leaves a mean without values missing.  All of them are partial
aggregates before the shuffle, so a key with very many rows sends one row per
map task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.checks import check_metric
from spendlens.functions.values import agg_for, class_of, sum_or_zero
from spendlens.operators.filters import drop_missing, for_key
from spendlens.schema import METRICS


def metric_aggs(metrics: Iterable[str] = METRICS) -> list[Column]:
    """One aggregate per metric, by class, named after the metric."""
    return [agg_for(check_metric(m)).alias(m) for m in metrics]


def grouped_metrics(df: DataFrame, keys: Sequence[str], metrics: Iterable[str] = METRICS) -> DataFrame:
    """One row per key combination with the metrics by class."""
    return drop_missing(df, keys).groupBy(*keys).agg(*metric_aggs(metrics))


def grouped_sums(df: DataFrame, keys: Sequence[str], metrics: Iterable[str]) -> DataFrame:
    """One row per key combination; every metric is added up, whatever its class."""
    sums = [sum_or_zero(check_metric(m)).alias(m) for m in metrics]
    return drop_missing(df, keys).groupBy(*keys).agg(*sums)


def metric_totals(df: DataFrame, key: str, metric: str) -> DataFrame:
    """(key, value): one metric by campaign or SKU."""
    return drop_missing(df, [key]).groupBy(key).agg(agg_for(check_metric(metric)).alias("value"))


def long_metrics(df: DataFrame, keys: Sequence[str], metrics: Iterable[str] = METRICS) -> DataFrame:
    """(keys…, metric, value) from one wide row per key."""
    metrics = list(metrics)
    wide = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(list(keys), metrics, "metric", "value")


def metric_values(df: DataFrame, key: str, metrics: Iterable[str] = METRICS) -> DataFrame:
    """(key, metric, value) from raw rows.

    The long form makes every later reader (top list, totals, ranks) use the
    same columns of the grouped table, so Spark runs its shuffle once.
    """
    metrics = list(metrics)
    return long_metrics(grouped_metrics(df, [key], metrics), [key], metrics)


def basic_facts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of campaigns, first and last date, one row."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(
        count("campaign_id").alias("n_campaigns"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
    )


def metric_profile(df: DataFrame, metrics: Iterable[str] = METRICS) -> DataFrame:
    """(metric, max, min, mean) over all rows, from a single pass."""
    metrics = list(metrics)
    facts = []
    for m in metrics:
        mean = F.try_divide(F.sum(m).cast("double"), F.count(m).cast("double"))
        facts += [F.max(m).alias(f"{m}_max"), F.min(m).alias(f"{m}_min"), mean.alias(f"{m}_mean")]
    rows = [
        F.struct(
            F.lit(m).alias("metric"),
            *[F.col(f"{m}_{part}").cast("double").alias(f"{part}_value") for part in ("max", "min", "mean")],
        )
        for m in metrics
    ]
    return df.agg(*facts).select(F.inline(F.array(*rows)))


def metric_classes(df: DataFrame, metrics: Iterable[str] = METRICS) -> DataFrame:
    """(metric, class, value): how each metric combines, and what it comes to
    over the whole table."""
    metrics = list(metrics)
    return long_metrics(df.agg(*metric_aggs(metrics)), [], metrics).select(
        "metric", class_of("metric").alias("class"), "value"
    )


def campaign_overview(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Eight metrics by campaign, rounded half to even."""
    grouped = drop_missing(df, ["campaign_id"]).groupBy("campaign_id")
    if digits is None:
        return grouped.agg(*metric_aggs())
    return grouped.agg(*[F.bround(agg_for(m), digits).alias(m) for m in METRICS])


def trend_series(df: DataFrame, metric: str) -> DataFrame:
    """(date, campaign, placement, value): daily sums, for mean metrics too."""
    return grouped_sums(df, ["date", "campaign_id", "placement_type"], [metric]).withColumnRenamed(metric, "value")


def comparison_series(df: DataFrame, campaign: str, metrics: Sequence[str]) -> DataFrame:
    """(date, metric columns): daily sums of one campaign, for mean metrics too."""
    return grouped_sums(for_key(df, "campaign_id", campaign), ["date"], metrics)


def placement_totals(df: DataFrame) -> DataFrame:
    return grouped_metrics(df, ["placement_type"])


def placement_daily(df: DataFrame) -> DataFrame:
    return grouped_metrics(df, ["date", "placement_type"])


def column_totals(df: DataFrame, metrics: Iterable[str] = METRICS) -> DataFrame:
    """Total of each column of an already grouped table, one row."""
    return df.agg(*[sum_or_zero(F.col(m).cast("double")).alias(m) for m in metrics])


def score_inputs(df: DataFrame, axis: str) -> DataFrame:
    """Sales, spend and mean return by campaign or SKU."""
    return grouped_metrics(df, [axis], ["total_sales", "spend", "roas"])
