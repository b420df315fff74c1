"""The similarity graph over items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexilake.functions import vectors as V
from lexilake.operators import search as S
from lexilake.operators import vector_index as I

MAX_EDGES, THRESHOLD = 5, 0.9
PENDING, PENDING_NEIGHBOURS = 20, 5


def normalised(pairs: DataFrame, a: str = "item_a", b: str = "item_b") -> DataFrame:
    return pairs.withColumn("_a", F.least(a, b)).withColumn("_b", F.greatest(a, b)).drop(a, b).withColumnsRenamed({"_a": "item_a", "_b": "item_b"})


def edges(index: I.VectorIndex, threshold: float = THRESHOLD, top: int = MAX_EDGES) -> DataFrame:
    """item_a < item_b, type, score: each item's nearest others within the threshold.

    A pair found from both ends keeps the score of the end with the smaller id,
    which is the one that would have been inserted first.
    """
    near = I.neighbours(index, S.mean_vectors(index.rows), top, prefetch=max(4 * top, 20), within=threshold).where(F.col("distance") <= threshold)
    pairs = near.select(F.least("item_a", "item_b").alias("a"), F.greatest("item_a", "item_b").alias("b"), F.struct(F.col("item_a").alias("src"), "distance").alias("found"))
    one = pairs.groupBy("a", "b").agg(F.min("found").alias("found"))
    return one.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), F.lit("similar").alias("type"), V.linear_score(F.col("found.distance")).alias("score"))


def relations_of(all_edges: DataFrame, item_id: int) -> DataFrame:
    """The other ends of an item's edges, best first."""
    mine = all_edges.where((F.col("item_a") == item_id) | (F.col("item_b") == item_id))
    other = F.when(F.col("item_a") == item_id, F.col("item_b")).otherwise(F.col("item_a"))
    return mine.select(other.alias("item_id"), "type", "score").orderBy(F.desc("score"), "item_id")


def pending_pairs(index: I.VectorIndex, known: DataFrame, most: int = PENDING, top: int = PENDING_NEIGHBOURS) -> DataFrame:
    """The first pairs without a label, walking items by id and their neighbours by distance."""
    near = I.neighbours(index, S.mean_vectors(index.rows), top)
    pairs = near.select(F.least("item_a", "item_b").alias("a"), F.greatest("item_a", "item_b").alias("b"), F.struct("item_a", "rn", "distance").alias("met"))
    first = pairs.groupBy("a", "b").agg(F.min("met").alias("met")).withColumnsRenamed({"a": "item_a", "b": "item_b"})
    fresh = first.join(known.select("item_a", "item_b"), ["item_a", "item_b"], "left_anti")
    return fresh.orderBy("met.item_a", "met.rn").limit(most).select("item_a", "item_b", F.col("met.distance").alias("distance"))


def stored_labels(labelled: DataFrame, known: DataFrame) -> DataFrame:
    """Which labelled pairs (item_a, item_b, type, distance) are inserted: valid ends, first of its key, not there yet."""
    keys = ["item_a", "item_b", "type"]
    order = W.partitionBy(*keys).orderBy("distance")
    first = labelled.withColumn("rn", F.row_number().over(order)).join(known.select(*keys).withColumn("there", F.lit(True)), keys, "left")
    ok = (F.col("item_a") < F.col("item_b")) & (F.col("rn") == 1) & F.col("there").isNull()
    return first.select(*keys, V.reciprocal_score(F.col("distance")).alias("score"), ok.alias("inserted"))
