"""Column names, types and the metric catalog of the two reports."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T


class Metric(NamedTuple):
    label: str  # heading in the report file
    kind: str  # "sum" or "mean": how rows of one group combine
    unit: str


# The eight metrics of a campaign report, in report order.
METRICS: dict[str, Metric] = {
    "total_sales": Metric("TOTAL SALES", "sum", "USD"),
    "impressions": Metric("IMPRESSIONS", "sum", "Count"),
    "clicks": Metric("CLICKS", "sum", "Count"),
    "spend": Metric("SPEND", "sum", "USD"),
    "cpc": Metric("CPC", "sum", "USD"),
    "cpm": Metric("CPM", "sum", "USD"),
    "ctr": Metric("CTR", "mean", "Percentage (%)"),
    "roas": Metric("ROAS", "mean", "Percentage (%)"),
}
SUM_METRICS = [name for name, m in METRICS.items() if m.kind == "sum"]
MEAN_METRICS = [name for name, m in METRICS.items() if m.kind == "mean"]

MONEY = T.DecimalType(18, 4)

CAMPAIGN_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("campaign_id", T.StringType()),
        T.StructField("placement_type", T.StringType()),
        T.StructField("promoted_sku", T.StringType()),
        T.StructField("promoted_product_id", T.StringType()),
        T.StructField("promoted_product", T.StringType()),
        T.StructField("total_sales", MONEY),
        T.StructField("impressions", T.LongType()),
        T.StructField("clicks", T.LongType()),
        T.StructField("spend", MONEY),
        T.StructField("cpc", T.DoubleType()),
        T.StructField("cpm", T.DoubleType()),
        T.StructField("ctr", T.DoubleType()),
        T.StructField("roas", T.DoubleType()),
    ]
)

SALES_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("order_date", T.TimestampType()),
        T.StructField("campaign_id", T.StringType()),
        T.StructField("purchased_sku", T.StringType()),
        T.StructField("total_sales", MONEY),
    ]
)

# Report headings of the columns that are not metrics.
CAMPAIGN_LABELS: dict[str, str] = {
    "date": "DATE",
    "campaign_id": "CAMPAIGN ID",
    "placement_type": "PLACEMENT TYPE",
    "promoted_sku": "PROMOTED SKU",
    "promoted_product_id": "PROMOTED PRODUCT / CREATIVE ID",
    "promoted_product": "PROMOTED PRODUCT / CREATIVE",
} | {name: m.label for name, m in METRICS.items()}
SALES_LABELS: dict[str, str] = {
    "order_date": "ORDER DATE",
    "campaign_id": "CAMPAIGN ID",
    "purchased_sku": "PURCHASED SKU",
    "total_sales": "TOTAL SALES",
}

PROMOTED_LABEL = "Promoted SKU"
NON_PROMOTED_LABEL = "Non-Promoted SKU"
OTHERS_LABEL = "others"
EPSILON = 1e-6  # stands for 0 on a flow link
PALETTE_SIZE = 12  # colour slots of the flow view
PAGE_SIZE = 10
TOP_DEFAULT = 5

# Rows a side may hold and still be broadcast. Everything marked for
# broadcast in this package is bounded by this number or by the metric catalog.
BROADCAST_ROWS = 10_000
