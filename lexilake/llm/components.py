"""Connected components by rounds of contraction, without collecting anything.

Each round hooks every node to its smallest neighbour, relabels the edges by that
and drops loops and repeats; the number of nodes at least halves. What a round
makes is written to the shared folder, so lineage stays short and a lost executor
costs one round's tasks. Joins read plain exchanges on both sides, which lets
adaptive execution split a node that has a large part of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.llm.common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Node and label (smallest node of its component) of every node with an edge to another.

    Nulls and loops make no link; repeated edges count once; no edges: no rows.
    """
    rest = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    labels, nodes = None, 2 * rest.count()
    while n := rest.count():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("to")).withColumnRenamed("a", "node"), "hooks", rows=2 * n)
        # one jump, so that short chains fold at once
        up = hook.select(F.col("node").alias("n2"), F.col("to").alias("to2"))
        hook = written(hook.join(up, F.col("to") == F.col("n2"), "left").select("node", F.coalesce("to2", "to").alias("to")), "jumps", rows=2 * n)
        ha, hb = (hook.select(F.col("node").alias(f"n{x}"), F.col("to").alias(f"t{x}")) for x in "ab")
        moved = rest.join(ha, F.col("a") == F.col("na")).select("ta", "b").join(hb, F.col("b") == F.col("nb")).select("ta", "tb")
        rest = written(moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges", rows=n)
        if labels is None:
            labels = hook.select("node", F.col("to").alias("label"))
        else:
            labels = labels.join(hook.select(F.col("node").alias("n2"), F.col("to").alias("to2")), F.col("label") == F.col("n2"), "left")
            labels = written(labels.select("node", F.coalesce("to2", "label").alias("label")), "labels", rows=nodes)
    if labels is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
