"""What the operators of this package share: tables, digests and cut lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from lexilake.sources.stored import fresh_path, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_number(df: DataFrame, name: str) -> Column:
    """The column as a bigint; any but an integral type raises an error that names it."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise ValueError(f"{name} must be of an integral type, not {kind.simpleString()}")
    return F.col(name).cast("bigint")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of ``df`` (in any case) has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


#: Rows of a file where the number of a table's rows is known.
FILE_ROWS = 250_000


def written(df: DataFrame, name: str, batch_bytes: int | None = None, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder.

    A lost executor loses nothing of it, and Catalyst knows its true size, so a
    join with it is broadcast only if it is below the session's threshold.
    ``batch_bytes`` bounds the Arrow batches on the way there, for rows that are
    large blocks. ``rows``, at most so many, says how few files the table needs: a
    small table of many partitions costs more for its files than for its rows. It is
    for what comes straight out of a shuffle, or from tables that are as small.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(ARROW_BYTES)
    if batch_bytes:
        spark.conf.set(ARROW_BYTES, str(batch_bytes))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_BYTES, before)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partition_keys(spark: SparkSession, parts: int) -> list[int]:
    """For each of ``parts`` shuffle partitions an int that ``repartition(parts, key)`` deals to it.

    Packed blocks dealt out by these are spread evenly, which a hash of few bucket
    numbers would not do.
    """
    where = F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("part")
    found = spark.range(0, 64 * parts, 1, 1).select(F.col("id").cast("int").alias("key"), where).groupBy("part").agg(F.min("key").alias("key"))
    keys = {r["part"]: r["key"] for r in found.collect()}  # as many as there are partitions
    return [keys.get(p, p) for p in range(parts)]
