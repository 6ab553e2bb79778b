"""Named tables and written results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendlens.functions.checks import check_choice
from spendlens.operators.filters import date_bounds
from spendlens.schema import CAMPAIGN_LABELS, CAMPAIGN_SCHEMA, SALES_LABELS, SALES_SCHEMA
from spendlens.sources import snapshots

# The two tables and their schemas.
TABLES = {"campaign_summary": CAMPAIGN_SCHEMA, "sales_report": SALES_SCHEMA}


def register(df: DataFrame, name: str, durable: bool = False) -> DataFrame:
    """Make a table known under a name, replacing the previous one.

    A durable table is written as a new snapshot; the name then points to it.
    If the write fails the name keeps its table, and tables read before go on
    reading their snapshot."""
    if not durable:
        df.createOrReplaceTempView(name)
        return df
    session = df.sparkSession
    folder = snapshots.add(session, name, {"rows": df}, fresh=True)
    _point(session, name, f"{folder}/rows")
    return session.table(name)


def _point(session: SparkSession, name: str, folder: str) -> None:
    if session.catalog.tableExists(name) and not session.catalog.getTable(name).isTemporary:
        session.sql(f"ALTER TABLE `{name}` SET LOCATION '{folder}'")
        session.catalog.refreshTable(name)
    else:
        session.catalog.createTable(name, path=folder, source="parquet")


def restore(session: SparkSession, name: str, version: int | None = None) -> DataFrame:
    """Point a name to one of its snapshots, by default the last, as a new session does to find an earlier one's tables."""
    found = snapshots.folders(session, name, version)
    if not found:
        raise ValueError(f"no snapshot of {name!r}")
    _point(session, name, f"{found[-1]}/rows")
    return session.table(name)


def table(spark: SparkSession, name: str) -> DataFrame:
    """The registered table; an empty one of its schema before any load."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    if name not in TABLES:
        raise ValueError(f"no table {name!r}")
    return spark.createDataFrame([], TABLES[name])


def stored_bounds(session: SparkSession, name: str, column: str = "date") -> DataFrame:
    """First and last date of a durable table, one row, out of the footers of its files: no data page is read.

    Spark answers such an aggregate from footers in its second file source
    alone, so the row belongs to a session of its own and is to be collected.
    """
    place = session.sql(f"DESCRIBE TABLE EXTENDED `{name}`").filter("col_name = 'Location'").first()
    if place is None:
        raise ValueError(f"{name!r} is not a durable table")
    own = session.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return date_bounds(own.read.parquet(place["data_type"]), column)


def with_headings(df: DataFrame) -> DataFrame:
    """Columns under their report headings; others keep their names."""
    return df.withColumnsRenamed(CAMPAIGN_LABELS | SALES_LABELS)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: str | None = None) -> None:
    """Write a result table as Parquet or CSV with headings."""
    check_choice(fmt, ("parquet", "csv"), "fmt")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
