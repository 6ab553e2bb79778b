"""Tables kept as immutable snapshots, with a log that says which of them count.

A write goes to a folder of its own.  Only when all its files are there does a
row of the log name it, so a load that fails half-way changes nothing, and
readers of an older version go on reading its files.  The log is appended to;
an entry is ``fresh`` if it replaces what came before, else it adds to it.
Tables are kept and read again, so their files are packed closer than by default.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession

from spendlens.operators.lineage import shared_folder

LOG = "version long, folder string, fresh boolean"


def home(session: SparkSession, name: str) -> str:
    return f"{shared_folder(session)}/snapshots/{name}"


def entries(session: SparkSession, name: str) -> list[Row]:
    """The log, oldest first; one row for each load."""
    try:
        log = session.read.schema(LOG).json(f"{home(session, name)}/log")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(log.collect())


def add(session: SparkSession, name: str, tables: Mapping[str, DataFrame], fresh: bool) -> str:
    """Write the tables as the next version, in folders under one that the log
    then names, and return that one."""
    folder = f"{home(session, name)}/{uuid.uuid4().hex}"
    for part, df in tables.items():
        df.write.option("compression", "zstd").parquet(f"{folder}/{part}")
    known = entries(session, name)
    version = known[-1]["version"] + 1 if known else 1
    session.createDataFrame([(version, folder, fresh)], LOG).coalesce(1).write.mode("append").json(f"{home(session, name)}/log")
    return folder


def folders(session: SparkSession, name: str, version: int | None = None) -> list[str]:
    """The folders that make up a version, by default the last; none before any load."""
    found: list[str] = []
    for entry in entries(session, name):
        if version is None or entry["version"] <= version:
            found = [entry["folder"]] if entry["fresh"] else [*found, entry["folder"]]
    return found


def read(session: SparkSession, name: str, part: str, version: int | None = None) -> DataFrame:
    """One of the tables of a version."""
    found = folders(session, name, version)
    if not found:
        raise ValueError(f"no snapshot of {name!r}")
    return session.read.parquet(*[f"{folder}/{part}" for folder in found])
