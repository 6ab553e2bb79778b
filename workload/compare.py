"""Run checked queries on Spark and DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _rows(pdf: pd.DataFrame) -> list[str]:
    """Rows as text, columns by name, in sorted order."""

    def cell(v) -> str:
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)[:10] if isinstance(v, pd.Timestamp) else str(v)

    pdf = pdf.astype(object).reindex(columns=sorted(pdf.columns))
    return sorted("|".join(map(cell, row)) for row in pdf.itertuples(index=False))


def difference(spark: SparkSession, con, query, sql: str, sf_dir: str) -> str | None:
    """What differs between the two engines, or None."""
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    mine = pd.DataFrame(rows, columns=df.columns, dtype=object)
    cursor = con.execute(sql)
    theirs = pd.DataFrame(cursor.fetchall(), columns=[d[0] for d in cursor.description], dtype=object)
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} / {sorted(theirs.columns)}"
    left, right = _rows(mine), _rows(theirs)
    if left == right:
        return None
    extra, lacking = sorted(set(left) - set(right)), sorted(set(right) - set(left))
    return f"{len(left)} / {len(right)} rows; only Spark {extra[:3]}; only SQL {lacking[:3]}"


def main(sf_dir: str, names: list[str]) -> int:
    from spendlens.session import build_session
    from workload.oracle import ORACLE
    from workload.queries import QUERIES

    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names or QUERIES:
        begin = time.time()
        if name not in ORACLE:
            print("NOSQL", name, QUERIES[name](spark, sf_dir).count())
            continue
        try:
            problem = difference(spark, con, QUERIES[name], ORACLE[name], sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print("FAIL" if problem else "ok", name, f"{time.time() - begin:.2f}s", problem or "", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
