"""From report files to the two tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from spendlens.sources.normalize import normalize_campaign, normalize_sales
from spendlens.sources.reports import read_report
from spendlens.sources.tables import register, table


class Loaded(NamedTuple):
    campaign: DataFrame
    sales: DataFrame
    rejected: DataFrame


Paths = str | Sequence[str] | None


def load_reports(spark: SparkSession, campaign_paths: Paths = None, sales_paths: Paths = None, fmt: str = "xlsx",
                 durable: bool = True, null_label: str | None = None) -> Loaded:
    """Read one report or both, type them and register them as
    ``campaign_summary`` and ``sales_report``.

    The table of a report without paths is the one registered before, or empty.
    Tables are written once as Parquet, so analyses do not read the files
    again, unless ``durable`` is off.  ``null_label`` names the group of rows
    without a campaign, which otherwise fall out of every grouping.
    """
    if campaign_paths is None and sales_paths is None:
        raise ValueError("name the paths of a report")
    rejected, tables = [], []
    for paths, kind, name, normalize in (
        (campaign_paths, "campaign", "campaign_summary", normalize_campaign),
        (sales_paths, "sales", "sales_report", normalize_sales),
    ):
        if paths is None:
            tables.append(table(spark, name))
            continue
        report = read_report(spark, paths, kind, fmt)
        tables.append(register(normalize(report.table, null_label), name, durable))
        rejected.append(report.rejected)
    return Loaded(*tables, reduce(DataFrame.unionByName, rejected))
