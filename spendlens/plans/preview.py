"""First look at a campaign table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from spendlens.operators.filters import sample_rows
from spendlens.operators.metrics import basic_facts, campaign_overview, metric_profile
from spendlens.operators.scaling import heat_scale


class Preview(NamedTuple):
    sample: DataFrame
    facts: DataFrame
    profile: DataFrame
    overview: DataFrame
    heat: DataFrame


def preview(df: DataFrame, rows: int = 5) -> Preview:
    overview = campaign_overview(df)
    return Preview(sample_rows(df, rows), basic_facts(df), metric_profile(df), overview, heat_scale(overview))
