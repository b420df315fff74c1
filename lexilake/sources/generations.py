"""Stored tables in generations: ``gen=0`` is the build, ``gen=k`` the k-th batch of changes.

``touched`` names the keys that a batch replaced or removed; ``stats`` has one row and
is written last, so a generation without it does not exist for readers, and a batch
that is run again writes the same generation over. A row counts if no later generation
touched its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row groups are the grain at which a filter on sorted rows skips.
GROUP_BYTES = 16 << 20


def write(df: DataFrame, path: str, table: str, gen: int) -> None:
    df.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/{table}/gen={gen}")


def last(spark: SparkSession, path: str, before: int | None = None) -> int:
    gens = spark.read.parquet(f"{path}/stats").select("gen")
    return (gens if before is None else gens.where(F.col("gen") < before)).agg(F.max("gen")).head()[0]


def stats(spark: SparkSession, path: str, gen: int) -> DataFrame:
    return spark.read.parquet(f"{path}/stats").where(F.col("gen") == gen).drop("gen")


def live(spark: SparkSession, path: str, table: str, upto: int, key: str = "item_id") -> DataFrame:
    rows = spark.read.parquet(f"{path}/{table}").where(F.col("gen") <= upto)
    if upto == 0:
        return rows.drop("gen")
    late = spark.read.parquet(f"{path}/touched").where(F.col("gen") <= upto).groupBy(key).agg(F.max("gen").alias("late"))
    return rows.join(late, key, "left").where(F.col("late").isNull() | (F.col("gen") >= F.col("late"))).drop("gen", "late")
