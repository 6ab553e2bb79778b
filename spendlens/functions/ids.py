"""Expressions that clean ids, dates and pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_id(c: Column | str) -> Column:
    """Id text up to the first dot, as the flow shows it: ``123.0`` and ``123`` are one id, and so are ``a.b`` and ``a.c``."""
    return F.substring_index(_col(c).cast("string"), ".", 1)


def report_id(c: Column | str) -> Column:
    """Id text of a report cell, whole; only a number that a spreadsheet wrote as
    a decimal (``123.0``) loses its tail, so that it meets ``123``."""
    return F.regexp_replace(_col(c).cast("string"), r"^([0-9]+)\.0*$", "$1")


def numeric_id_text(c: Column | str, fill: int = 0) -> Column:
    """Numeric id as integer text; a missing id reads as ``fill``, text that is
    no number as NULL."""
    text = F.coalesce(_col(c).cast("string"), F.lit(str(fill)))
    return text.try_cast("decimal(38,10)").try_cast("bigint").cast("string")


def parse_date_lenient(c: Column | str) -> Column:
    """Day of a date text; NULL where it cannot be read."""
    return _col(c).try_cast("date")


LAST_SERIAL = 2_958_465  # spreadsheet day number of 9999-12-31


def parse_report_date(c: Column | str) -> Column:
    """Day of a report cell: date text, eight digits ``yyyyMMdd``, or a
    spreadsheet day number counted from 1899-12-30.  Anything else, and a day
    number after the year 9999, fails the job."""
    return parse_report_time(c).cast("date")


def parse_report_time(c: Column | str) -> Column:
    """Moment of a report cell, read like ``parse_report_date``; the fraction
    of a day number is its time of day."""
    text = F.trim(_col(c).cast("string"))
    number = text.try_cast("double")
    day = F.floor(number).cast("int")
    seconds = F.round((number - F.floor(number)) * 86_400).cast("int")
    serial = F.date_add(F.lit("1899-12-30").cast("date"), day).cast("timestamp") + F.make_dt_interval(secs=seconds)
    wrong = F.raise_error(F.concat(F.lit("no date: "), text)).cast("timestamp")
    digits = F.when(text.rlike(r"^[0-9]{8}$"), F.to_timestamp(text, "yyyyMMdd")).when(
        (number >= 1) & (number < LAST_SERIAL + 1), serial
    ).otherwise(wrong)
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), digits).otherwise(
        F.coalesce(text.try_cast("timestamp"), F.substring_index(text, " ", 1).cast("timestamp"))
    )


def pair_key(a: Column | str, b: Column | str) -> Column:
    """Key that is the same for (a, b) and (b, a)."""
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def clean_number(c: Column | str) -> Column:
    """Floating NaN as NULL, so that sums and means skip it."""
    return F.when(~F.isnan(_col(c)), _col(c))
