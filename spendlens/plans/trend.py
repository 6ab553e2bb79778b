"""Ranked trends, comparison of two metrics and SKU detail."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.checks import check_metric, check_metric_pair, check_slice
from spendlens.functions.ids import numeric_id_text
from spendlens.functions.values import metric_text, rank_text, sum_or_zero, unit_of
from spendlens.operators.filters import Day, between_dates, distinct_values, drop_missing, for_key
from spendlens.operators.metrics import comparison_series, grouped_metrics, metric_totals, trend_series
from spendlens.operators.ranking import key_card, rank_slice
from spendlens.schema import BROADCAST_ROWS, TOP_DEFAULT


class Trend(NamedTuple):
    series: DataFrame
    totals: DataFrame


def trend(df: DataFrame, metric: str, low_rank: int = 1, high_rank: int = TOP_DEFAULT,
          start: Day = None, end: Day = None, mode: str = "both_or_full") -> Trend:
    """(date, campaign, placement, value, rank) of the campaigns at the ranks
    low..high, and the totals they are ranked by.  Ranking goes by the metric's
    class; the series always adds up.  By default a window counts only if both
    bounds are given; with ``mode="complete"`` one alone does too."""
    check_metric(metric)
    check_slice(low_rank, high_rank)
    rows = between_dates(df, start, end, mode)
    totals = metric_totals(rows, "campaign_id", metric)
    chosen = rank_slice(totals, "campaign_id", low_rank, high_rank).select(
        "campaign_id", F.col("position").alias("rank")
    )
    if high_rank - low_rank < BROADCAST_ROWS:
        # few campaigns: their rows are picked out at the scan
        kept = drop_missing(rows, ["placement_type"]).join(F.broadcast(chosen), "campaign_id")
        series = kept.groupBy("date", "campaign_id", "placement_type", "rank").agg(sum_or_zero(metric).alias("value"))
    else:
        series = trend_series(rows, metric).join(chosen, "campaign_id")
    return Trend(series.select("date", "campaign_id", "placement_type", "value", "rank"), totals)


class Comparison(NamedTuple):
    series: DataFrame
    cards: DataFrame


def compare(df: DataFrame, campaign: str, metrics: Sequence[str] = ("total_sales", "spend"),
            start: Day = None, end: Day = None, mode: str = "both_or_full") -> Comparison:
    """Daily sums of two metrics for one campaign, and its total, rank and
    texts per metric.  ``mode`` as in ``trend``."""
    metrics = check_metric_pair(metrics)
    rows = between_dates(df, start, end, mode)
    cards = key_card(rows, "campaign_id", campaign, metrics).withColumns({
        "unit": unit_of("metric"),
        "value_text": metric_text("value", unit_of("metric")),
        "legend": rank_text("metric", "rank"),
    })
    return Comparison(comparison_series(rows, campaign, metrics), cards)


class CampaignSkus(NamedTuple):
    products: DataFrame
    daily: DataFrame


def campaign_skus(df: DataFrame, campaign: str, start: Day = None, end: Day = None) -> CampaignSkus:
    """Products of one campaign, and its metrics by day and SKU; a missing id
    reads as 0."""
    rows = for_key(between_dates(df, start, end), "campaign_id", campaign).withColumns({
        "promoted_product_id": numeric_id_text("promoted_product_id"),
        "promoted_sku": numeric_id_text("promoted_sku"),
    })
    return CampaignSkus(
        distinct_values(rows, ["promoted_sku", "promoted_product_id", "promoted_product"]),
        grouped_metrics(rows, ["date", "promoted_sku"]),
    )
