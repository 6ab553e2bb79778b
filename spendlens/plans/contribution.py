"""Promoted and other sales of each campaign."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import DataFrame

from spendlens.operators import attribution as A
from spendlens.operators.filters import Day, between_dates, for_key
from spendlens.operators.ranking import sorted_ids


class Contribution(NamedTuple):
    contribution: DataFrame
    hierarchy: DataFrame
    campaigns: DataFrame


@dataclass(frozen=True)
class CampaignSales:
    """Sales of one campaign; each table is made when it is first asked for."""

    sales: DataFrame
    campaign: DataFrame
    chosen: str
    on_unmatched: str

    @cached_property
    def daily(self) -> DataFrame:
        return A.promoted_daily(self.sales, self.campaign, self.chosen)

    @cached_property
    def detail(self) -> DataFrame:
        return A.flag_promoted(self.sales, self.campaign, self.on_unmatched)


def promoted_contribution(sales: DataFrame, campaign: DataFrame, start: Day = None, end: Day = None,
                          on_unmatched: str = "flag") -> Contribution:
    """Contribution of promoted sales by campaign, the same as a hierarchy,
    and the campaigns to choose from.  The date window applies to sales only;
    ``on_unmatched="error"`` refuses sales without a report of their day."""
    rows = between_dates(sales, start, end)
    by_flag = A.promoted_sales(rows, campaign, on_unmatched)
    return Contribution(A.sales_contribution(by_flag), A.sales_hierarchy(by_flag), sorted_ids(rows, "campaign_id"))


def campaign_sales(sales: DataFrame, campaign: DataFrame, chosen: str, start: Day = None, end: Day = None,
                   on_unmatched: str = "flag") -> CampaignSales:
    """Promoted and other sales of one campaign by day, and its flagged rows."""
    rows = for_key(between_dates(sales, start, end), "campaign_id", chosen)
    own = for_key(campaign, "campaign_id", chosen)
    return CampaignSales(rows, own, chosen, on_unmatched)
