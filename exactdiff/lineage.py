"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(session: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set and Spark runs in one process."""
    context = session.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = session.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"exactdiff-{uuid.uuid4().hex}"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the session's checkpoint folder."""
    folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet folder below the session's checkpoint folder: filters reach its row groups, and parts of
    it can be read alone."""
    path = f"{folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
