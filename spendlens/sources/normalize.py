"""Typed tables from report columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions.ids import clean_number, parse_report_date, parse_report_time, report_id
from spendlens.schema import CAMPAIGN_SCHEMA, SALES_SCHEMA


IDS = ("campaign_id", "promoted_sku", "promoted_product_id", "purchased_sku")
NO_NUMBER = ("", "nan")  # cells without a value, as text


def _id_text(name: str, null_label: str | None) -> Column:
    text = report_id(name)
    return F.coalesce(text, F.lit(null_label)) if null_label is not None else text


def _typed(df: DataFrame, field: T.StructField) -> Column:
    if field.name not in df.columns:
        return F.lit(None).cast(field.dataType)
    if field.name in IDS:
        return report_id(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.DecimalType, T.LongType)) and dict(df.dtypes)[field.name] == "string":
        number = F.when(~F.lower(F.trim(field.name)).isin(*NO_NUMBER), F.col(field.name))
        if isinstance(field.dataType, T.LongType):
            number = number.cast("decimal(38,10)")
        return number.cast(field.dataType)
    if isinstance(field.dataType, T.DoubleType):
        return clean_number(F.col(field.name).cast("double"))
    if isinstance(field.dataType, T.DecimalType) and dict(df.dtypes)[field.name] in ("double", "float"):
        return clean_number(field.name).cast(field.dataType)
    return F.col(field.name).cast(field.dataType)


def _select(df: DataFrame, schema: T.StructType, special: dict[str, Column]) -> DataFrame:
    columns = [special[f.name] if f.name in special else _typed(df, f) for f in schema]
    return df.select(*[c.alias(f.name) for c, f in zip(columns, schema)])


def normalize_campaign(df: DataFrame, null_label: str | None = None) -> DataFrame:
    """Campaign report with its schema's types; ids stay whole, but for the decimals of whole numbers.
    Dates that cannot be read fail; ``null_label`` makes rows without a campaign a group of that name."""
    special = {
        "date": parse_report_date("date") if dict(df.dtypes)["date"] == "string" else F.col("date").cast("date"),
        "campaign_id": _id_text("campaign_id", null_label),
    }
    return _select(df, CAMPAIGN_SCHEMA, special)


def normalize_sales(df: DataFrame, null_label: str | None = None) -> DataFrame:
    """Sales report: ``date`` is the day of ``order_date``, which is kept."""
    if dict(df.dtypes)["order_date"] == "string":
        day, moment = parse_report_date("order_date"), parse_report_time("order_date")
    else:
        day, moment = F.col("order_date").cast("date"), F.col("order_date").cast("timestamp")
    special = {"date": day, "order_date": moment, "campaign_id": _id_text("campaign_id", null_label)}
    return _select(df, SALES_SCHEMA, special)
