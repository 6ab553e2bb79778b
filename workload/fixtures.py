"""The two report tables as views over the test tables.

One text of the expressions serves Spark (``selectExpr``) and the SQL oracle
(a common table expression), but for money and months, where Spark has a
cheaper way to the same values.  ``FIXTURES.md`` describes the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MONEY = {
    "total_sales": "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))",
    "spend": "CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))",
}
# The same amounts from whole cents and percents; casting a double to a decimal
# goes through text in Spark.
CENTS = "CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)"
SPARK_MONEY = {
    "total_sales": f"CAST({CENTS} * (100 - CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) AS DECIMAL(18,0)) * 0.0001",
    "spend": f"CAST({CENTS} * CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS DECIMAL(18,0)) * 0.0001",
}
SPARK_MONTH = "trunc(CAST(l_shipdate AS DATE), 'MM')"
BASE = {
    "date": "CAST(l_shipdate AS DATE)",
    "campaign_id": "CAST(l_suppkey AS STRING)",
    "placement_type": "CASE WHEN l_linestatus = 'F' THEN 'PLA' ELSE 'Banner' END",
    "promoted_sku": "CAST(CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_partkey END AS STRING)",
    "promoted_product_id": "CAST(l_partkey AS STRING)",
    "total_sales": MONEY["total_sales"],
    "spend": MONEY["spend"],
    "clicks": "CAST(l_quantity AS BIGINT)",
    "impressions": "CAST(l_quantity AS BIGINT) * 100 + l_partkey % 97",
}
RATIOS = {
    "cpc": "CAST(spend AS DOUBLE) / NULLIF(clicks, 0)",
    "cpm": "1000 * CAST(spend AS DOUBLE) / NULLIF(impressions, 0)",
    "ctr": "100 * CAST(clicks AS DOUBLE) / NULLIF(impressions, 0)",
    "roas": "CAST(total_sales AS DOUBLE) / NULLIF(CAST(spend AS DOUBLE), 0)",
}
SALES = {
    "order_date": "CAST(date_trunc('month', l_shipdate) AS DATE)",
    "campaign_id": BASE["campaign_id"],
    "purchased_sku": "CAST(l_partkey AS STRING)",
    "total_sales": MONEY["total_sales"],
}
# The monthly promotions: every line, some for another SKU, some campaigns half a year late.
PROMOTION = {
    "date": "CAST(date_trunc('month', l_shipdate) + INTERVAL 6 MONTH * CAST(l_suppkey % 10 = 3 AS INT) AS DATE)",
    "promoted_sku": "CAST(CASE WHEN l_partkey % 50 = 0 THEN NULL WHEN l_orderkey % 3 = 0 THEN l_partkey + 1 "
    "ELSE l_partkey END AS STRING)",
}
SPARK_PROMOTION_MONTH = "add_months(trunc(CAST(l_shipdate AS DATE), 'MM'), 6 * CAST(l_suppkey % 10 = 3 AS INT))"


def _items(columns: dict[str, str]) -> list[str]:
    return [f"{text} AS {name}" for name, text in columns.items()]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def campaign_summary(spark: SparkSession, sf_dir: str, product: bool = False) -> DataFrame:
    """Campaign report rows; ``product`` adds the product name, the one column
    that needs a join."""
    lines = read(spark, sf_dir, "lineitem")
    extra = []
    if product:
        parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
        lines = lines.join(parts, lines.l_partkey == parts.p_partkey)
        extra = ["p_name AS promoted_product"]
    return lines.selectExpr(*_items(BASE | SPARK_MONEY), *extra).selectExpr("*", *_items(RATIOS))


def sales_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, by month."""
    columns = SALES | {"order_date": SPARK_MONTH, "total_sales": SPARK_MONEY["total_sales"]}
    return read(spark, sf_dir, "lineitem").selectExpr(*_items(columns)).selectExpr("*", "order_date AS date")


def monthly_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign report rows by month, made from every order line."""
    columns = BASE | SPARK_MONEY | PROMOTION | {"date": SPARK_PROMOTION_MONTH}
    return read(spark, sf_dir, "lineitem").selectExpr(*_items(columns)).selectExpr("*", *_items(RATIOS))


def _cte(name: str, columns: dict[str, str], source: str, ratios: bool = True) -> str:
    inner = f"SELECT {', '.join(_items(columns))} FROM {source}"
    if not ratios:
        return f"{name} AS ({inner})"
    return f"{name} AS (SELECT *, {', '.join(_items(RATIOS))} FROM ({inner}))"


CAMPAIGN_CTE = _cte(
    "campaign", BASE | {"promoted_product": "p_name"}, "lineitem JOIN part ON l_partkey = p_partkey"
)
SALES_CTE = _cte("sales", SALES | {"date": SALES["order_date"]}, "lineitem", ratios=False)
PROMO_CTE = _cte(
    "promo", BASE | PROMOTION, "lineitem"
)
