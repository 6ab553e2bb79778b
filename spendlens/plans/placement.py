"""Split of the metrics over placement types."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from spendlens.operators.filters import Day, between_dates
from spendlens.operators.metrics import long_metrics, placement_daily, placement_totals
from spendlens.operators.scaling import column_share


class Placement(NamedTuple):
    share: DataFrame
    daily: DataFrame


def placement(df: DataFrame, start: Day = None, end: Day = None) -> Placement:
    """(placement, metric, value, pct) over the window, and metrics by day."""
    rows = between_dates(df, start, end)
    values = long_metrics(placement_totals(rows), ["placement_type"])
    return Placement(column_share(values, ["placement_type"]), placement_daily(rows))
