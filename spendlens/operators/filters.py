"""Row selection and projection."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.checks import check_choice
from spendlens.schema import BROADCAST_ROWS

Day = dt.date | str | None


def between_dates(df: DataFrame, start: Day = None, end: Day = None,
                  mode: str = "complete", column: str = "date") -> DataFrame:
    """Rows with start <= date <= end; rows without a date never qualify.

    A missing bound means the first or last date of the table, which no dated
    row can fall outside of, so it needs no lookup: only given bounds become
    predicates, and those reach the file scan.  ``mode="both_or_full"`` uses
    the window only when both bounds are given.
    """
    check_choice(mode, ("complete", "both_or_full"), "mode")
    if mode == "both_or_full" and (start is None or end is None):
        start = end = None
    kept = df.filter(F.col(column).isNotNull())
    if start is not None:
        kept = kept.filter(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        kept = kept.filter(F.col(column) <= F.lit(end).cast("date"))
    return kept


def date_bounds(df: DataFrame, column: str = "date") -> DataFrame:
    """First and last date of the table, one row."""
    return df.agg(F.min(column).alias("min_date"), F.max(column).alias("max_date"))


def for_key(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for column in columns:
        df = df.filter(F.col(column).isNotNull())
    return df


def project(df: DataFrame, columns: Sequence[str], names: dict[str, str] | None = None) -> DataFrame:
    """Keep some columns, renaming those in ``names``."""
    return df.select(*columns).withColumnsRenamed(names or {})


def _small(keys: DataFrame, rows: int | None) -> DataFrame:
    return F.broadcast(keys) if rows is not None and rows <= BROADCAST_ROWS else keys


def keep_members(df: DataFrame, keys: DataFrame, on: str | list[str], rows: int | None = None) -> DataFrame:
    """Rows whose key is among ``keys``.  ``rows`` is a known bound on the size
    of ``keys``; without a small one Spark chooses the join by its own sizes."""
    return df.join(_small(keys, rows), on, "left_semi")


def exclude_members(df: DataFrame, keys: DataFrame, on: str | list[str], rows: int | None = None) -> DataFrame:
    """Rows whose key is not among ``keys``."""
    return df.join(_small(keys, rows), on, "left_anti")


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def sample_rows(df: DataFrame, n: int = 5, order: Sequence[str] = ()) -> DataFrame:
    """First rows in the given order; any rows when there is none."""
    return df.orderBy(*order).limit(n) if order else df.limit(n)


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct combinations, a missing value counting as a value."""
    return df.select(*columns).distinct()
