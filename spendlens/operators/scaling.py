"""Values set against the whole of a grouped table.

The one-row statistics are scalar subqueries over the same grouped table; its
shuffle is run once and read by both.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.values import percent_of, scaled, sum_or_zero
from spendlens.schema import METRICS


def min_max(df: DataFrame, columns: Iterable[str], suffix: str = "_norm") -> DataFrame:
    """Add each column scaled to 0..1 over the table; NULL for a flat column."""
    columns = list(columns)
    bounds = [x for c in columns for x in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"))]
    stats = df.agg(F.struct(*bounds)).scalar()
    return df.withColumns({f"{c}{suffix}": scaled(F.col(c), stats[f"{c}_lo"], stats[f"{c}_hi"]) for c in columns})


def heat_scale(overview: DataFrame, metrics: Iterable[str] = METRICS) -> DataFrame:
    """Intensity 0..1 of every overview cell, column by column."""
    metrics = list(metrics)
    keys = [c for c in overview.columns if c not in metrics]
    return min_max(overview, metrics, "_heat").select(*keys, *[f"{m}_heat" for m in metrics])


def column_share(long: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Add ``pct``: value as percent of its metric's total over all rows of a
    (keys…, metric, value) table."""
    totals = long.groupBy("metric").agg(sum_or_zero("value").alias("metric_total"))
    # one row per metric of the catalog
    shared = long.join(F.broadcast(totals), "metric")
    return shared.select(*keys, "metric", "value", percent_of("value", "metric_total").alias("pct"))
