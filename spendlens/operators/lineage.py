"""Materialising a table that many later steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(session: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``,
    or on one machine, as in tests, its warehouse.  A cluster must name one."""
    named = session.conf.get("spark.checkpoint.dir", None)
    if named is None and not session.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return (named or session.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The table, computed now and kept in the checkpoint folder, so later
    readers start from files that outlive any executor.

    The folder is the session's ``spark.checkpoint.dir``, or one in the
    warehouse where a session names none, as in tests.
    """
    session = df.sparkSession
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        named = session.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or shared_folder(session) + "/checkpoints")
    return df.checkpoint()


def stored(df: DataFrame, kind: str) -> DataFrame:
    """The table written as Parquet to a folder of its own in the shared folder
    and read back: computed once, and later readers take the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
