"""Exact top-k search by inner product: a pivot-distance index.

A coordinate that fills every vector up to the longest one's length turns the highest
inner products into the smallest distances. Vectors are keyed by their nearest pivot
and their distance to it, sorted by that, and packed into blocks; a ring of distances
around a pivot is a cell, whose blocks lie together. By the triangle inequality a cell
has an upper bound on the score of any query. Each query reads its cells in the order
of that bound, in a few widening rounds, and stops where the bound falls below its
k-th score; inside a block the same inequality cuts a range out of the sorted
distances. Rounds are joins of packed blocks on the cell, never of rows; large cells
are dealt out over several keys, so a vector with a third of all rows is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexilake.llm.common import written
from lexilake.llm.vectors import NONE, Best, matrix, products, squared_length, unpacked, whole_vectors

#: Pivots and rings are fitted on this many vectors (those with the smallest hash); all vectors are indexed.
SAMPLE = 8192
PIVOTS, RINGS = 64, 8
#: Vectors of a block, queries of a block, and queries routed together.
BLOCK, ASKED, ROUTED = 1024, 256, 2048
#: Cells that a query has read after each round, before the last reads what is left.
ROUNDS = (1, 8)


class Pivots:
    """Pivots in the filled-up space and the edges of their rings."""

    def __init__(self, sample: np.ndarray, longest: float, pivots: int, rings: int):
        self.longest = longest
        x = self.filled(sample.astype(float))
        centres = x[:1]
        near = ((x - centres[0]) ** 2).sum(axis=1)
        while len(centres) < min(pivots, max(1, len(x) // 16)) and near.max() > 0:
            centres = np.vstack([centres, x[near.argmax()]])
            near = np.minimum(near, ((x - centres[-1]) ** 2).sum(axis=1))
        for _ in range(4):
            of = self._distances(x, centres).argmin(axis=1)
            centres = np.array([x[of == c].mean(axis=0) for c in np.unique(of)])
        self.centres = centres
        distance = self._distances(x, centres)
        of = distance.argmin(axis=1)
        cuts = np.linspace(0, 1, rings + 1)[1:-1]
        self.edges = [np.unique(np.quantile(distance[of == c, c], cuts)) if (of == c).any() else np.zeros(0) for c in range(len(centres))]
        self.first = np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges])])
        self.pivot_of = np.repeat(np.arange(len(centres)), np.diff(self.first))

    def filled(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0, self.longest - (x * x).sum(axis=1)))[:, None]])

    @staticmethod
    def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * (x @ centres.T)))

    def keys(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its pivot."""
        distance = self._distances(self.filled(v.astype(float)), self.centres)
        of = distance.argmin(axis=1)
        own, cell = distance[np.arange(len(of)), of], np.zeros(len(of), np.int32)
        for c in np.unique(of):
            cell[of == c] = self.first[c] + np.searchsorted(self.edges[c], own[of == c], "right")
        return cell, own

    def asked(self, v: np.ndarray) -> np.ndarray:
        """Distances of queries to the pivots; a query's own filling is zero."""
        q = v.astype(float)
        return self._distances(np.hstack([q, np.zeros((len(q), 1))]), self.centres)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that are sorted by cell and distance."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, distance, ids = (batch.column(i).to_numpy() for i in range(3))
        size = len(batch.column(3)[0].as_buffer())
        blob = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(3)), np.uint8).reshape(len(cell), size)
        cuts = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            for at in range(lo, hi, BLOCK):
                own = slice(at, min(hi, at + BLOCK))
                row = [[int(cell[at])], [own.stop - at], [distance[at]], [distance[own.stop - 1]], [ids[own].tobytes()], [distance[own].tobytes()], [blob[own].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.float64(), pa.float64(), *[pa.binary()] * 3))], ["cell", "n", "lo", "hi", "ids", "distances", "vectors"])


def pivot_index(rows: DataFrame, width: int, pivots: Pivots, parts: int) -> DataFrame:
    """The stored index: blocks of at most BLOCK vectors of a cell, sorted by distance."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), width)
            cell, distance = pivots.keys(v)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(distance), batch.column(0), pa.array([x.tobytes() for x in v], pa.binary())], ["cell", "distance", "id", "vector"])

    sorted_rows = rows.select("id", "v").mapInArrow(keyed, "cell int, distance double, id bigint, vector binary").repartitionByRange(parts, "cell", "distance", "id").sortWithinPartitions("cell", "distance", "id")
    return written(sorted_rows.mapInArrow(_pack, "cell int, n bigint, lo double, hi double, ids binary, distances binary, vectors binary"), "pivot-index")


def _router(width: int, pivots: Pivots, cells: dict[str, np.ndarray], start: int, end: int):
    """Packed queries for the cells of one round: those whose rank by bound is in the round and that may still give a result."""
    of = pivots.pivot_of[cells["cell"]]

    def routed(ids: np.ndarray, v: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        q2 = (v.astype(float) ** 2).sum(axis=1)[:, None]
        distance = pivots.asked(v)
        near = distance[:, of]
        gap = np.maximum(0, np.maximum(near - cells["hi"], cells["lo"] - near))
        bound = (q2 + pivots.longest - gap * gap) / 2
        slack = 1 + 1e-9 * (q2 + pivots.longest)
        rank = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
        want = (rank >= start) & (rank < end) & (bound + slack >= last[:, None])
        for c in np.flatnonzero(want.any(axis=0)):
            own = np.flatnonzero(want[:, c])
            for at in range(0, len(own), ASKED):
                i = own[at : at + ASKED]
                blobs = [x.tobytes() for x in (ids[i], v[i], near[i, c], last[i])]
                for slot in range(cells["slots"][c]):
                    yield pa.RecordBatch.from_arrays([pa.array([int(cells["cell"][c])], pa.int32()), pa.array([slot], pa.int32()), *[pa.array([b], pa.binary()) for b in blobs]], ["cell", "slot", "asked", "queries", "near", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, ids, last = matrix(batch.column(1), width), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for at in range(0, len(ids), ROUTED):
                yield from routed(ids[at : at + ROUTED], v[at : at + ROUTED], last[at : at + ROUTED])

    return run


def _searcher(width: int, k: int, longest: float, product: float):
    """The best of each query in the blocks that it met in a row; one query block follows another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, best, ids = None, None, None

        def out() -> Iterator[pa.RecordBatch]:
            i, score, found = best.found()
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(score), pa.array(found)], ["query_id", "score", "id"])

        for batch in batches:
            for row in range(batch.num_rows):
                asked, queries, near, last, held, distances, vectors = (batch.column(i)[row] for i in range(7))
                key = asked.as_py()
                if key != before:
                    if best is not None:
                        yield from out()
                    before, ids, q = key, np.frombuffer(key, np.int64), unpacked(queries, np.int32, width)
                    best, reach, q2 = Best(len(ids), k), unpacked(last, np.int64), (q.astype(float) ** 2).sum(axis=1)
                floor = np.maximum(reach, best.last).astype(float)
                radius = np.sqrt(np.maximum(0, q2 + longest - 2 * floor) + 1 + 1e-9 * (q2 + longest))
                distance, mine = unpacked(distances, np.float64), unpacked(near, np.float64)
                lo, hi = np.searchsorted(distance, (mine - radius).min(), "left"), np.searchsorted(distance, (mine + radius).max(), "right")
                if lo >= hi:
                    continue
                others = unpacked(held, np.int64)[lo:hi]
                score = products(q, unpacked(vectors, np.int32, width)[lo:hi], product)
                score[(others == ids[:, None]) | (score < reach[:, None])] = NONE
                best.take(score, others, np.arange(len(ids)))
        if best is not None:
            yield from out()

    return run


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, rings: int = RINGS, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of highest inner product with each query, ties to the smaller id.

    Components become floor(scale * x); products are whole and exact. A query's own
    id is no candidate. Null ids and vectors, and vectors with a null or non-finite
    component, take no part; of rows that share an id the smallest vector counts;
    shorter vectors count as filled up with zeros; fewer than ``k`` candidates give
    fewer rows; an empty table or no query gives none. Other columns are not read.
    Ids must be of an integral type.
    """
    spark = rows.sparkSession
    clean = written(whole_vectors(rows, scale, id_col, vector_col), "vectors")
    asked = written(whole_vectors(queries, scale, id_col, vector_col), "queries")
    size = lambda df: df.agg(F.count("*"), F.coalesce(F.max(squared_length()), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0))).head()
    (n, longest, width), (n_asked, longest_asked, width_asked) = size(clean), size(asked)
    if not n or not n_asked:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = max(width, width_asked, 1)
    sample = clean.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    fitted = Pivots(matrix(sample, width), float(longest), pivots, rings)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 131_072))
    index = pivot_index(clean, width, fitted, parts)
    # as many rows as there are cells, at most pivots * rings
    found = index.groupBy("cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("cell").toPandas()
    cells = {c: found[c].to_numpy() for c in ("cell", "lo", "hi")}
    cells["slots"] = np.ceil(found["n"].to_numpy() / min(256 * BLOCK, max(4 * BLOCK, 2 * n / len(found)))).astype(int)
    slots = np.ones(fitted.first[-1], int)
    slots[cells["cell"]] = cells["slots"]
    slot = F.pmod(F.xxhash64("ids"), F.array(*[F.lit(int(s)) for s in slots])[F.col("cell")]).cast("int")
    blocks = index.select("cell", slot.alias("slot"), F.col("ids").alias("held"), "distances", "vectors")
    product = float(longest) ** 0.5 * float(longest_asked) ** 0.5
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    best = None
    for start, end in zip((0, *rounds), (*rounds, len(found))):
        if start >= len(found):
            break
        if best is None:
            open_queries = asked.withColumn("last", F.lit(NONE))
        else:
            last = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("last"))
            open_queries = asked.join(last, "id", "left").select("id", "v", F.coalesce("last", F.lit(NONE)).alias("last"))
        packed = open_queries.mapInArrow(_router(width, fitted, cells, start, end), "cell int, slot int, asked binary, queries binary, near binary, last binary")
        met = packed.hint("merge").join(blocks, ["cell", "slot"]).select("asked", "queries", "near", "last", "held", "distances", "vectors")
        new = met.mapInArrow(_searcher(width, k, float(longest), product), "query_id bigint, score bigint, id bigint")
        new = new if best is None else new.unionByName(best.select("query_id", "score", "id"))
        best = written(new.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k), "best")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
