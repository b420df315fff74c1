"""Hard-negative mining: ball trees whose nodes bound inner products from above and below.

Rows are dealt out in ranges of (label, hash of the id) and packed into trees of
bounded size: halves of halves, each a ball around its mean. For a query and a ball,
the product with the centre plus or minus the query's length times the radius bounds
every product within. Two searches go down the same stored trees. The first finds each
anchor's positives among its own label; the second the negatives of other labels
within the score window of each positive. A node is left out if it lies outside the
window, strictly beneath the current k-th score, or holds no label that counts. Blocks
of anchors meet the parts of the table, never each other's rows, and a part sends on
only the best of each anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexilake.llm.common import written
from lexilake.llm.vectors import NONE, Best, matrix, products, squared_length, unpacked, whole_vectors

#: Rows of a tree and of a leaf, anchors of a block, and parts of the table at most.
TREE, LEAF, ASKED, PARTS = 2048, 64, 256, 65_536


def _cuts(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end."""
    return np.arange(2**level + 1) * n // 2**level


def _depth(n: int) -> int:
    return max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))


def ball_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the rows, and centre and radius of each node, level by level.

    A node is halved along the line between two rows that lie far apart in it.
    """
    n, order, x = len(v), np.arange(len(v)), v.astype(float)
    centres, radii = [], []
    for level in range(_depth(n) + 1):
        cuts, halves = _cuts(n, level), _cuts(n, level + 1)[1::2]
        for lo, half, hi in zip(cuts[:-1], halves, cuts[1:]):
            own = x[order[lo:hi]]
            centre = own.mean(axis=0)
            away = ((own - centre) ** 2).sum(axis=1)
            centres.append(centre)
            radii.append(np.sqrt(away.max()))
            if level < _depth(n):
                one = own[away.argmax()]
                along = own @ (one - own[((own - one) ** 2).sum(axis=1).argmax()])
                order[lo:hi] = order[lo:hi][np.argpartition(along, half - lo)]
    return order, np.array(centres), np.array(radii)


def _planted(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["n", "low", "high", "held", "labels", "vectors", "centres", "radii"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                own = batch.slice(at, TREE)
                ids, labels, v = own.column(0).to_numpy(), own.column(1).to_numpy(), matrix(own.column(2), width)
                order, centres, radii = ball_tree(v)
                row = [[len(ids)], [labels.min()], [labels.max()], *[[x.tobytes()] for x in (ids[order], labels[order], v[order], centres, radii)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i < 3 else pa.binary()) for i, x in enumerate(row)], names)

    return run


def _packed(width: int, parts: list[tuple[int, int, int]], same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of anchors with their windows, one for each part that holds a label that counts for one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), width)
            size = np.diff(batch.column(3).offsets.to_numpy())
            bounds = batch.column(3).flatten().to_numpy()  # positive scores of each anchor
            first = np.concatenate([[0], np.cumsum(size)])
            for part, low, high in parts:
                own = np.flatnonzero((low <= labels) & (labels <= high) if same else (low < high) | (labels != low))
                for at in range(0, len(own), ASKED):
                    i = own[at : at + ASKED]
                    of = np.repeat(np.arange(len(i)), size[i])
                    at_bound = np.concatenate([np.arange(first[j], first[j + 1]) for j in i])
                    blobs = (ids[i], labels[i], v[i], of, at_bound - first[i][of], bounds[at_bound])
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([np.ascontiguousarray(b).tobytes()], pa.binary()) for b in blobs]], ["part", "asked", "own", "queries", "of", "window", "score"])

    return run


def _search(width: int, k: int, same: bool, window: tuple[int, int], product: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Best rows of each (anchor, window) in the trees that a block of anchors met one after another."""

    def search(best: Best, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, own: np.ndarray, q: np.ndarray, of: np.ndarray, tree: list[pa.Scalar]) -> None:
        held, labels, v = unpacked(tree[0], np.int64), unpacked(tree[1], np.int64), unpacked(tree[2], np.int32, width)
        centres, radii = unpacked(tree[3], np.float64, width), unpacked(tree[4], np.float64)
        middle, reach = q.astype(float) @ centres.T, np.sqrt((q.astype(float) ** 2).sum(axis=1))[:, None] * radii
        slack = 1 + 1e-9 * product
        upper, lower = (middle + reach + slack)[of], (middle - reach - slack)[of]
        alive = np.ones((len(of), 1), bool)
        for level in range(_depth(len(held)) + 1):
            cuts, node = _cuts(len(held), level), slice(2**level - 1, 2 ** (level + 1) - 1)
            if level:
                alive = np.repeat(alive, 2, axis=1)
            low, high = np.minimum.reduceat(labels, cuts[:-1]), np.maximum.reduceat(labels, cuts[:-1])
            label = own[of][:, None]
            alive = alive & ((low <= label) & (label <= high) if same else (low < high) | (label != low))
            alive &= (upper[:, node] >= np.maximum(lo, best.last)[:, None]) & (lower[:, node] <= hi[:, None])
            if not alive.any():
                return
        upper = upper[:, node]
        for leaf in np.argsort(-np.where(alive, upper, -np.inf).max(axis=0), kind="stable"):
            rows = np.flatnonzero(alive[:, leaf] & (upper[:, leaf] >= best.last))
            if not len(rows):
                continue
            near = slice(cuts[leaf], cuts[leaf + 1])
            anchors, at = np.unique(of[rows], return_inverse=True)
            score = products(q[anchors], v[near], product)
            counts = (labels[near] == own[anchors][:, None]) == same
            counts &= held[near] != ids[anchors][:, None]
            score = np.where(counts, score, NONE)[at]
            score[(score < lo[rows, None]) | (score > hi[rows, None])] = NONE
            best.take(score, held[near], rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, best = None, None

        def out() -> Iterator[pa.RecordBatch]:
            i, score, found = best.found()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[of[i]], number[i], score, found)], ["anchor_id", "window", "score", "id"])

        for batch in batches:
            for row in range(batch.num_rows):
                asked, own, queries, of_, window_, positive, *tree = (batch.column(i)[row] for i in range(11))
                if (key := asked.as_py()) != before:
                    if best is not None:
                        yield from out()
                    before, ids, own, q = key, np.frombuffer(key, np.int64), unpacked(own, np.int64), unpacked(queries, np.int32, width)
                    of, number, positive = unpacked(of_, np.int64), unpacked(window_, np.int64), unpacked(positive, np.int64)
                    if same:
                        lo, hi = np.full(len(of), NONE + 1), np.full(len(of), 2**63 - 1)
                    else:  # least and largest whole score with low * positive <= 100 * score <= high * positive
                        whole, rest = positive // 100, positive % 100
                        lo, hi = window[0] * whole - (-window[0] * rest // 100), window[1] * whole + window[1] * rest // 100
                    best, mine = Best(len(of), k), own
                search(best, lo, hi, ids, mine, q, of, tree)
        if best is not None:
            yield from out()

    return run


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row of ``anchors`` (a condition on the rows) and each of its ``positives``
    best other rows of the same label, the ``negatives`` best rows of another label
    whose score is from ``window[0]`` to ``window[1]`` percent of the positive's. Scores
    are inner products of floor(scale * x), whole and exact; ties go to the smaller id.
    Null ids, labels and vectors, and vectors with a null or non-finite component, take
    no part; of rows that share an id the smallest (label, vector) counts; shorter
    vectors count as filled up with zeros. Fewer rows than asked for give all; a
    positive of negative score has an empty window; an empty table gives no rows. Other
    columns are not read. Ids and labels must be of integral types.
    """
    spark = rows.sparkSession
    clean = written(whole_vectors(rows, scale, id_col, vector_col, label_col), "vectors")
    n, longest, width = clean.agg(F.count("*"), F.coalesce(F.max(squared_length()), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0))).head()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n:
        return spark.createDataFrame([], schema)
    width, product = max(width, 1), float(longest)
    wanted = min(PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 131_072)))
    dealt = clean.select("id", "label", "v").repartitionByRange(wanted, "label", F.xxhash64("id"), "id").sortWithinPartitions("label", F.xxhash64("id"))
    trees = dealt.mapInArrow(_planted(width), "n bigint, low bigint, high bigint, held binary, labels binary, vectors binary, centres binary, radii binary")
    trees = written(trees.withColumn("part", F.spark_partition_id()), "ball-trees")
    # at most as many rows as there are parts
    parts = [tuple(r) for r in trees.groupBy("part").agg(F.min("low"), F.max("high")).orderBy("part").collect()]
    held = trees.select("part", "held", "labels", "vectors", "centres", "radii")
    asking = clean.join(rows.where(anchors).select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")

    def found(asked: DataFrame, k: int, same: bool) -> DataFrame:
        packed = asked.mapInArrow(_packed(width, parts, same), "part int, asked binary, own binary, queries binary, of binary, window binary, score binary")
        met = packed.hint("merge").join(held, "part").drop("part")  # a block of anchors meets its trees one after another
        best = met.mapInArrow(_search(width, k, same, window, product), "anchor_id bigint, window bigint, score bigint, id bigint")
        by_score = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), F.asc("id"))
        return best.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)

    no_bound = F.array(F.lit(0).cast("bigint"))
    near = written(found(asking.select("id", "label", "v", no_bound.alias("scores")), positives, True), "positives")
    # positives are numbered by rank, from 0
    scores = near.groupBy(F.col("anchor_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    far = found(asking.join(scores, "id").select("id", "label", "v", "scores"), negatives, False)
    named = near.select("anchor_id", (F.col("rank") - 1).cast("bigint").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.join(named, ["anchor_id", "window"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
