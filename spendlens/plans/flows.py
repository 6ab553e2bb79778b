"""Flow between one campaign (or SKU) and what it shares with others."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from spendlens.functions.checks import check_metric
from spendlens.operators import flow as L
from spendlens.operators.filters import Day, between_dates
from spendlens.operators.lineage import cut
from spendlens.schema import PALETTE_SIZE


@dataclass(frozen=True)
class Flow:
    """Tables of one flow view; each is made when it is first asked for."""

    rows: DataFrame
    own: DataFrame  # those of the chosen value
    primary: str
    chosen: str
    metric: str
    namespaced: bool
    palette: int

    @cached_property
    def forward(self) -> DataFrame:
        """The forward leg, kept, as the reverse leg asks for its size first."""
        return cut(self._forward)

    @cached_property
    def _forward(self) -> DataFrame:
        return L.flow_forward(self.own, self.primary, self.chosen, self.metric)

    @cached_property
    def legs(self) -> DataFrame:
        """Both legs.  Numbering reads them many times, so they are kept."""
        reverse = cut(L.flow_reverse(self.rows, self.forward, self.primary, self.metric))
        forward = L.mirrored(reverse, self.primary, self.chosen)
        return L.name_nodes(L.union_legs(forward, reverse, self.primary, self.metric), self.primary, self.namespaced)

    @cached_property
    def nodes(self) -> DataFrame:
        return L.flow_nodes(self.legs)

    @cached_property
    def slots(self) -> DataFrame:
        return L.flow_pair_slots(self.legs, self.palette)

    @cached_property
    def links(self) -> DataFrame:
        return L.number_links(self.legs, self.nodes, self.slots)

    @cached_property
    def detail(self) -> DataFrame:
        """Forward links, with product names where the report has them."""
        if "promoted_product" not in self.rows.columns:
            return self.forward
        return L.with_product(self.forward, self.own, self.chosen if self.primary == "promoted_sku" else None)


def flow(df: DataFrame, primary: str, chosen: str, metric: str = "total_sales", start: Day = None, end: Day = None,
         namespaced: bool = False, palette: int = PALETTE_SIZE) -> Flow:
    """Links chosen → its secondaries → all their primaries, the numbered
    nodes and pairs, and the forward links with product names.  ``primary`` is
    ``campaign_id`` or ``promoted_sku``."""
    check_metric(metric)
    L.other_side(primary)
    dated = between_dates(df, start, end)
    return Flow(L.flow_rows(dated), L.chosen_rows(dated, primary, chosen), primary, chosen, metric, namespaced, palette)
