"""Reading report files as Spark jobs.

A report has a few lead rows, then its headings, then data.  Text files are
split like any Spark text source: the headings of each file come from its
first block and every line is read against the headings of its own file.  A
spreadsheet cannot be split, but its format ends a sheet at 1,048,576 rows, so
one file is one bounded piece of work.  Reports are meant to be loaded once
and kept as Parquet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.checks import check_choice
from spendlens.operators.lineage import cut, stored
from spendlens.operators.skew import heavy_keys, salted_left_join
from spendlens.schema import BROADCAST_ROWS, CAMPAIGN_LABELS, METRICS, SALES_LABELS

LEAD_ROWS = 3
BATCH_ROWS = 20_000

NO_HEADINGS = "no heading row"
BROKEN = "lines with an open quote or another number of cells than headings: "


class Report(NamedTuple):
    table: DataFrame  # text columns under their schema names
    rejected: DataFrame  # (path, error) of files that gave no rows


def _kind(kind: str) -> tuple[dict[str, str], list[str]]:
    """Headings by column name, and those a report must have."""
    check_choice(kind, ("campaign", "sales"), "kind")
    if kind == "campaign":
        return CAMPAIGN_LABELS, [CAMPAIGN_LABELS[c] for c in ("date", "campaign_id", *METRICS)]
    return SALES_LABELS, [SALES_LABELS[c] for c in ("order_date", "campaign_id")]


def require_columns(df: DataFrame, columns: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """The table itself, or an error that lists what it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_report(spark: SparkSession, paths: str | Sequence[str], kind: str, fmt: str = "xlsx",
                lead_rows: int = LEAD_ROWS) -> Report:
    """Read report files of ``kind`` ``campaign`` or ``sales``.  A heading the
    files may lack gives a column without values; a file without a required
    heading, or one that cannot be read, is rejected whole."""
    check_choice(fmt, ("csv", "xlsx"), "fmt")
    labels, required = _kind(kind)
    paths = [paths] if isinstance(paths, str) else list(paths)
    read = _read_csv if fmt == "csv" else _read_xlsx
    rows, rejected = read(spark, paths, lead_rows, list(labels.values()), required)
    cells = [F.get("fields", F.lit(i)) for i in range(len(labels))]
    columns = [F.when(F.trim(c) != "", c).alias(name) for c, name in zip(cells, labels)]
    return Report(rows.select(*columns), rejected)


def quarantine(spark: SparkSession, paths: str | Sequence[str], kind: str, fmt: str = "xlsx",
               lead_rows: int = LEAD_ROWS) -> DataFrame:
    """(path, error) of the files that give no table."""
    return read_report(spark, paths, kind, fmt, lead_rows).rejected


def _cells(line: str) -> Column:
    """Cells of a line of comma-separated text.  (``from_csv`` wants one number
    of columns for all files, and is slow on lines with another.)"""
    outside_quotes = r',(?=(?:[^"]*+"[^"]*+")*+[^"]*+$)'
    quoted = F.transform(
        F.split(line, outside_quotes), lambda c: F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))
    )
    return F.when(F.contains(F.col(line), F.lit('"')), quoted).otherwise(F.split(line, ","))


def _read_csv(spark: SparkSession, paths: list[str], lead_rows: int, labels: list[str],
              required: list[str]) -> tuple[DataFrame, DataFrame]:
    text = spark.read.text(paths)
    # the files are read once: headings, checks and rows all come from the lines kept here, with the ids they got in that scan
    lines = stored(text.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.regexp_replace("value", "^\ufeff|\r$", "").alias("line"),
    ), "report-lines")
    # Lines of one file block are consecutive, so the smallest id of the first
    # block is the file's first line.
    blocks = lines.filter("block = 0")
    starts = blocks.groupBy("path").agg(F.min("id").alias("start"))
    head_line = F.max(F.when(F.col("id") - F.col("start") == lead_rows, F.col("line")))
    n_files = len(text.inputFiles())

    def by_file(rows: DataFrame, files: DataFrame) -> DataFrame:
        if n_files <= BROADCAST_ROWS:
            return rows.join(F.broadcast(files), "path")
        [heavy] = heavy_keys(rows, ["path"])
        return salted_left_join(rows, files, ["path"], heavy).filter(F.col("start").isNotNull())

    heads = by_file(blocks, starts).groupBy("path").agg(F.max("start").alias("start"), head_line.alias("head"))
    headings = heads.withColumn("headings", _cells("head"))
    lacking = F.array_except(F.array(*map(F.lit, required)), "headings")
    missing = F.concat(F.lit("missing columns: "), F.array_join(lacking, ", "))
    empty = F.coalesce(F.trim("head"), F.lit("")) == ""
    checked = headings.withColumn("error", F.when(empty, NO_HEADINGS).when(F.size(lacking) > 0, missing))
    rejected = checked.filter(F.col("error").isNotNull()).select("path", "error")

    # place 0 means the report lacks the heading
    places = [F.array_position("headings", label).alias(f"place{i}") for i, label in enumerate(labels)]
    accepted = checked.filter(F.col("error").isNull()).select("path", "start", F.size("headings").alias("width"), *places)
    lead = (F.col("block") == 0) & (F.col("id") - F.col("start") <= lead_rows)
    data = by_file(lines, accepted).filter(~lead & (F.trim("line") != ""))
    record = data.withColumn("record", _cells("line"))
    # a record that is cut by a line break, or lacks cells, rejects its file: its lines are checked before any is passed on
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    is_broken = (F.size("record") != F.col("width")) | (quotes % 2 == 1)
    broken = record.filter(is_broken).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    rejected = rejected.unionByName(broken.select("path", F.concat(F.lit(BROKEN), F.col("n").cast("string")).alias("error")))
    names = broken.select("path")
    record = record.join(F.broadcast(names) if n_files <= BROADCAST_ROWS else names, "path", "left_anti")
    fields = [F.get("record", (F.col(f"place{i}") - 1).cast("int")) for i in range(len(labels))]
    return record.select("path", F.array(*fields).alias("fields")), rejected


def _read_xlsx(spark: SparkSession, paths: list[str], lead_rows: int, labels: list[str],
               required: list[str]) -> tuple[DataFrame, DataFrame]:
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of each file; one with an error, at the end, if the file is no report."""
        from spendlens.sources.sheets import sheet_rows

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                places: list[int | None] | None = None
                rows: list[list[str | None]] = []
                error = None
                try:
                    for number, cells in sheet_rows(content):
                        if number <= lead_rows:
                            continue
                        if places is None:
                            columns = {text: column for column, text in reversed(cells.items())}
                            missing = [label for label in required if label not in columns]
                            if missing:
                                error = f"missing columns: {', '.join(missing)}"
                                break
                            places = [columns.get(label) for label in labels]
                            continue
                        rows.append([cells.get(p) for p in places])
                        if len(rows) == BATCH_ROWS:
                            yield pd.DataFrame({"path": path, "fields": rows, "error": None})
                            rows = []
                    if places is None and error is None:
                        error = NO_HEADINGS
                except Exception as damage:  # any damage rejects the file, not the job
                    error = f"{type(damage).__name__}: {damage}"
                if rows:
                    yield pd.DataFrame({"path": path, "fields": rows, "error": None})
                if error:
                    yield pd.DataFrame({"path": [path], "fields": [None], "error": [error]})

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    # decoded once: damage at the end of a file takes back the rows before it
    decoded = cut(files.mapInPandas(decode, "path string, fields array<string>, error string"))
    rejected = decoded.filter(F.col("error").isNotNull()).select("path", "error")
    return decoded.filter(F.col("error").isNull()).select("path", "fields").join(rejected.select("path"), "path", "left_anti"), rejected
