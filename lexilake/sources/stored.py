"""Tables that outlive a query, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none and all tasks run in this machine's one process
    (tests) a local folder is made and set for this session; a cluster must name one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexilake-"))
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """What changes when a file of a table does: their number, and a hash of names, lengths and times. Contents are not read."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path", "length", "modificationTime").alias("h"), "length")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.bit_xor("h")).head())


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: worked out once, and a lost executor loses nothing of it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
