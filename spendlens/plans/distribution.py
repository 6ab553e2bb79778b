"""Shares of the largest groups."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.checks import check_choice, check_metric
from spendlens.operators.bounds import split_by_bounds
from spendlens.operators.filters import Day, between_dates
from spendlens.operators.metrics import long_metrics, metric_values
from spendlens.operators.ranking import top_n
from spendlens.operators.scaling import column_share
from spendlens.schema import BROADCAST_ROWS, MEAN_METRICS, METRICS, OTHERS_LABEL, SUM_METRICS, TOP_DEFAULT

KEYS = ("campaign_id", "promoted_sku")


class Distribution(NamedTuple):
    shares: DataFrame
    means: DataFrame


def distribution(df: DataFrame, key: str = "campaign_id", metric: str = "total_sales", n: int = TOP_DEFAULT,
                 combine_others: bool = True, start: Day = None, end: Day = None, by_bounds: bool = False) -> Distribution:
    """Shares of the n largest groups in the six sum metrics, and their means
    of the two mean metrics.  The groups are chosen once, by ``metric``; all
    other groups count as one, named others, when they are combined.

    ``by_bounds`` is for very many groups of which few are large: only rows of
    groups that can be among the n largest are grouped, for two more passes
    over the report.  The result is the same.  A mean, or a longer list than is
    broadcast, is always found by grouping all."""
    check_choice(key, KEYS, "key")
    check_metric(metric)
    rows, rest = between_dates(df, start, end), None
    if by_bounds and metric in SUM_METRICS and n <= BROADCAST_ROWS:
        rows, rest = split_by_bounds(rows, key, metric, n)
    values = sums = metric_values(rows, key, METRICS)
    if rest is not None:  # a group without a name, so that it is one of the others
        unnamed = rest.withColumn(key, F.lit(None).cast(df.schema[key].dataType))
        sums = values.unionByName(long_metrics(unnamed, [key], SUM_METRICS))
    chosen = top_groups(values, key, metric, n)
    return Distribution(
        group_shares(sums, chosen, key, combine_others),
        group_means(values, chosen, key),
    )


def top_groups(values: DataFrame, key: str, metric: str, n: int) -> DataFrame:
    """Keys of the n largest groups of one metric, marked ``is_top``."""
    chosen = top_n(values.filter(F.col("metric") == metric), key, n).select(key, F.lit(True).alias("is_top"))
    return F.broadcast(chosen) if n <= BROADCAST_ROWS else chosen


def fold_others(values: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """(group, is_others, metric, value): chosen groups as they are and one sum
    over all the others, which is there even when no group is left."""
    marked = values.join(chosen, key, "left").withColumn("is_others", F.col("is_top").isNull())
    # A zero for others beside every group keeps that line when nothing is left.
    parts = F.array(
        F.struct(F.when(F.col("is_others"), OTHERS_LABEL).otherwise(F.col(key)).alias("group"),
                 F.col("is_others").alias("folded"), F.col("value").alias("amount")),
        F.struct(F.lit(OTHERS_LABEL).alias("group"), F.lit(True).alias("folded"), F.lit(0.0).alias("amount")),
    )
    lines = marked.select("metric", F.inline(parts))
    return lines.groupBy("group", F.col("folded").alias("is_others"), "metric").agg(F.sum("amount").alias("value"))


def group_shares(values: DataFrame, chosen: DataFrame, key: str, combine_others: bool = True) -> DataFrame:
    """(group, is_others, metric, value, pct) for the sum metrics."""
    sums = values.filter(F.col("metric").isin(SUM_METRICS))
    if combine_others:
        return column_share(fold_others(sums, chosen, key), ["group", "is_others"])
    kept = sums.join(chosen.drop("is_top"), key).withColumnRenamed(key, "group")
    return column_share(kept.withColumn("is_others", F.lit(False)), ["group", "is_others"])


def group_means(values: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """(key, metric, value) for the mean metrics of the chosen groups."""
    means = values.filter(F.col("metric").isin(MEAN_METRICS))
    return means.join(chosen.drop("is_top"), key)
