"""Weighted scores of campaigns or SKUs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.checks import check_choice, check_weights
from spendlens.functions.values import sum_or_zero, weighted_score
from spendlens.operators.filters import Day, between_dates, drop_missing
from spendlens.operators.metrics import score_inputs
from spendlens.operators.scaling import min_max

AXES = ("campaign_id", "promoted_sku")
CUMULATIVE = ("total_sales", "clicks", "spend")


def score(df: DataFrame, axis: str = "campaign_id", w_sales: int = 33, w_roas: int = 33, w_spend: int = 34,
          start: Day = None, end: Day = None) -> DataFrame:
    """(axis, total_sales, spend, roas, score): scaled sales and return add to
    the score, scaled spend counts against it.  Weights are whole percents."""
    check_choice(axis, AXES, "axis")
    check_weights(w_sales, w_roas, w_spend)
    scaled = min_max(score_inputs(between_dates(df, start, end), axis), ["total_sales", "roas", "spend"])
    weights = {"total_sales_norm": w_sales / 100, "roas_norm": w_roas / 100, "spend_norm": -w_spend / 100}
    return scaled.select(axis, "total_sales", "spend", "roas", weighted_score(weights).alias("score"))


def cumulative_score(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(campaign, total_score), best first: sales and spend are added up,
    clicks averaged, each scaled and weighted."""
    for name in weights:
        check_choice(name, CUMULATIVE, "weighted metric")
    grouped = drop_missing(df, ["campaign_id"]).groupBy("campaign_id").agg(
        sum_or_zero("total_sales").alias("total_sales"),
        F.avg("clicks").alias("clicks"),
        sum_or_zero("spend").alias("spend"),
    )
    total = weighted_score({f"{name}_norm": w for name, w in weights.items()})
    scored = min_max(grouped, list(weights)).select("campaign_id", total.alias("total_score"))
    return scored.orderBy(F.desc_nulls_last("total_score"), "campaign_id")
