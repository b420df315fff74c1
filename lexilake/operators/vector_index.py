"""The stored vector index: cells around centres, exact by the triangle inequality, kept up in generations.

Centres are fitted to a bounded sample; every vector goes to the cell of its nearest
centre with its distance to it. Under one path, in generations (``sources.generations``):

* ``vectors``: user_id, cell, distance, item_id, chunk_id, embedding, in ranges of the
  first three and sorted by them, so a cell's ring of distances is a filter on row groups;
* ``cells``: user_id, cell, and its number of vectors and least and largest distance;
* ``touched`` and ``stats``.

A query at distance d from a centre is at least d - hi, and lo - d, away from all of
that cell. It reads the cells with the least bounds until they hold enough vectors;
the distance of the last result found so far then rules out cells, and rings of cells,
and what is left is read. All distances are measured anew from the vectors, in the
same order as ``functions.vectors.l2``, so results are those of a search without index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexilake.functions import vectors as V
from lexilake.sources import generations as G
from lexilake.sources.stored import written

#: Cells of an index at most, vectors that its centres are fitted to, and rounds of fitting.
CELLS, SAMPLE, ROUNDS = 64, 8192, 5
#: Vectors of a block where many queries meet many vectors, and products that are looked at together.
BLOCK, AT_ONCE = 4096, 1 << 21
#: A first reading holds so many times the results asked for.
AHEAD = 4
#: Far above the error of a product of doubles, for vectors of length one.
ERROR = 1e-9
KEYS = ("user_id", "item_id", "chunk_id")


@dataclass(frozen=True)
class VectorIndex:
    rows: DataFrame
    cells: DataFrame
    centres: np.ndarray

    def of_user(self, user: int) -> VectorIndex:
        own = F.col("user_id") == user
        return replace(self, rows=self.rows.where(own), cells=self.cells.where(own))


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat, size = vectors.flatten().to_numpy(zero_copy_only=False).astype(float), np.diff(vectors.offsets.to_numpy())
    if len(size) and (size != size[0]).any():
        raise ValueError("the vectors of an index have one width")
    return flat.reshape(len(size), size[0] if len(size) else 0)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * (x @ centres.T)))


def _whole(chunks: DataFrame) -> DataFrame:
    return chunks.select(*KEYS, "embedding").dropna().where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))))


def fitted_centres(chunks: DataFrame, cells: int = CELLS) -> np.ndarray:
    """Centres of the chunks with the smallest hashes, at most SAMPLE of them: one for each 32, at most ``cells``."""
    sample = _whole(chunks).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    x = _matrix(sample)
    if not len(x):
        return x
    centres, near = x[:1], _distances(x, x[:1])[:, 0]
    while len(centres) < min(cells, max(1, len(x) // 32)) and near.max() > 0:
        centres = np.vstack([centres, x[near.argmax()]])
        near = np.minimum(near, _distances(x, centres[-1:])[:, 0])
    for _ in range(ROUNDS):
        of = _distances(x, centres).argmin(axis=1)
        centres = np.array([x[of == c].mean(axis=0) for c in np.unique(of)])
    return centres


def _write_vectors(chunks: DataFrame, centres: np.ndarray, path: str, gen: int) -> None:
    kinds = {n: chunks.schema[n].dataType.simpleString() for n in (*KEYS, "embedding")}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = _distances(_matrix(batch.column(3)), centres)
                cell = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])], [*KEYS, "embedding", "cell", "distance"])

    rows = _whole(chunks).mapInArrow(placed, ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", cell int, distance double")
    order = ("user_id", "cell", "distance")
    G.write(rows.repartitionByRange(*order, "chunk_id").sortWithinPartitions(*order), path, "vectors", gen)
    own = chunks.sparkSession.read.parquet(f"{path}/vectors/gen={gen}")
    G.write(own.groupBy("user_id", "cell").agg(F.count("*").alias("n"), F.min("distance").alias("lo"), F.max("distance").alias("hi")), path, "cells", gen)


def build(chunks: DataFrame, path: str, cells: int = CELLS) -> None:
    """Write the index of all chunks (``user_id``, ``item_id``, ``chunk_id``, ``embedding``) to an empty ``path``.

    Rows with a null in any of these, or a null or undefined component, are in no
    index; vectors of different widths raise an error.
    """
    centres = fitted_centres(chunks, cells)
    spark = chunks.sparkSession
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    _write_vectors(chunks, centres, path, 0)
    G.write(chunks.select("item_id").limit(0), path, "touched", 0)
    G.write(chunks.sparkSession.range(1).select(F.lit(len(centres)).alias("centres")), path, "stats", 0)


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    found = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most CELLS
    return np.array([r["centre"] for r in found]).reshape(len(found), len(found[0]["centre"]) if found else 0)


def read(spark: SparkSession, path: str) -> VectorIndex:
    """The live vectors. A cell's numbers are of all generations, so its bounds hold for what is left of them."""
    gen = G.last(spark, path)
    rows = G.live(spark, path, "vectors", gen).select("user_id", "cell", "distance", "item_id", "chunk_id", "embedding")
    cells = spark.read.parquet(f"{path}/cells").where(F.col("gen") <= gen).groupBy("user_id", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return VectorIndex(rows, cells, _centres(spark, path))


def apply_batch(spark: SparkSession, path: str, touched: DataFrame, after: DataFrame, batch: int) -> None:
    """Keep the index up with one batch: ``touched`` are the items that changed or went (``item_id``), ``after`` all chunks of the new and changed ones.

    For ``foreachBatch``: ``batch`` counts from 0, and one that failed half-way or
    comes twice leaves the same generation. Centres stay; an index that was empty when
    it was built gets them from its first batch.
    """
    gen, centres = batch + 1, _centres(spark, path)
    if not len(centres):
        centres = fitted_centres(after)
        spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    _write_vectors(after, centres, path, gen)
    G.write(touched.select("item_id").unionByName(after.select("item_id")).distinct(), path, "touched", gen)
    G.write(spark.range(1).select(F.lit(len(centres)).alias("centres")), path, "stats", gen)


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write the live vectors as a new index, with centres of their own."""
    build(read(spark, path).rows, to)


@dataclass(frozen=True)
class Reading:
    """What a search read: of how many cells of its user, and how many of them."""

    cells: int
    read: int


def candidates(index: VectorIndex, query: list[float], user: int, enough: int, found: Callable[[DataFrame], float | None]) -> tuple[DataFrame, Reading]:
    """The vectors of a user that a search with these results can need.

    ``found`` looks at a first reading (cells with at least ``AHEAD * enough``
    vectors) and returns the distance of the last result in it, or None if there are
    too few. Every vector within that distance is returned, and some others.
    """
    cells = index.cells.where(F.col("user_id") == user).orderBy("cell").collect()  # at most CELLS
    own = index.rows.where(F.col("user_id") == user)
    if not cells:
        return own, Reading(0, 0)
    away = _distances(np.array([query], float), index.centres)[0]
    bounds = sorted((max(0.0, away[c["cell"]] - c["hi"], c["lo"] - away[c["cell"]]), c["cell"], c["n"]) for c in cells)
    held = np.cumsum([n for _, _, n in bounds])
    first = bounds[: int(np.searchsorted(held, AHEAD * enough)) + 1]
    last = found(own.where(F.col("cell").isin([c for _, c, _ in first])))
    if last is None:
        return own, Reading(len(cells), len(cells))
    reach = last + ERROR * (1 + last)
    near = [c for bound, c, _ in bounds if bound <= reach]
    ring = lambda c: (F.col("cell") == c) & F.col("distance").between(float(away[c] - reach), float(away[c] + reach))
    return own.where(reduce(Column.__or__, [ring(c) for c in near], F.lit(False))), Reading(len(cells), len({*near, *(c for _, c, _ in first)}))


def nearest_items(index: VectorIndex, query: list[float], user: int, limit: int, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, Reading]:
    """The user's nearest items by their best chunk (item_id, chunk_id, distance), and what was read.

    ``keep`` filters or semi-joins rows before anything is ranked, so a filter never
    starves the result. Ties in distance go to the smaller chunk, then item.
    """
    q = V.literal(query)

    def best(rows: DataFrame) -> DataFrame:
        near = keep(rows).select("item_id", F.struct(V.l2(F.col("embedding"), q).alias("distance"), "chunk_id").alias("best"))
        near = near.groupBy("item_id").agg(F.min("best").alias("best"))
        return near.select("item_id", "best.chunk_id", "best.distance").orderBy("distance", "item_id").limit(limit)

    def last(rows: DataFrame) -> float | None:
        n, far = best(rows).agg(F.count("*"), F.max("distance")).head()
        return far if n >= limit else None

    rows, reading = candidates(index, query, user, limit, last)
    return best(rows), reading


def nearest_chunks(index: VectorIndex, query: list[float], user: int, limit: int, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, Reading]:
    """The user's nearest chunks (item_id, chunk_id, distance), ties to the smaller chunk, and what was read."""

    def best(rows: DataFrame) -> DataFrame:
        return keep(rows).select("item_id", "chunk_id", V.l2(F.col("embedding"), V.literal(query)).alias("distance")).orderBy("distance", "chunk_id").limit(limit)

    def last(rows: DataFrame) -> float | None:
        n, far = best(rows).agg(F.count("*"), F.max("distance")).head()
        return far if n >= limit else None

    rows, reading = candidates(index, query, user, limit, last)
    return best(rows), reading


def _opened(block: pa.ListScalar, vector: int) -> tuple[list[pa.Array], np.ndarray]:
    fields = block.values.flatten()
    own = fields.pop(vector)
    return fields, own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)


def _ranks(ids: pa.Array) -> np.ndarray:
    return np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]


def _within(group: np.ndarray) -> np.ndarray:
    """The position of each row in its run of equal values."""
    first = np.concatenate([[True], group[1:] != group[:-1]])
    return np.arange(len(group)) - np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))


def _router(centres: np.ndarray, enough: int, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of items for each block of the cells they need: in the ``first`` round the nearest that hold enough, then what their limit leaves of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            users, items, cells = batch.column(0), batch.column(1), batch.column(3)
            away, limit = _distances(_matrix(batch.column(2)), centres), batch.column(4).to_numpy(zero_copy_only=False)
            users_of = _ranks(users)
            for user in np.unique(users_of):
                own = np.flatnonzero(users_of == user)
                of, n, lo, hi = (x.to_numpy(zero_copy_only=False) for x in cells[int(own[0])].values.flatten())
                near = away[own][:, of]
                bound = np.maximum(0, np.maximum(near - hi, lo - near))
                order = np.argsort(bound, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                want = np.zeros(bound.shape, bool)
                np.put_along_axis(want, order, before < enough, axis=1)
                if not first:
                    want = ~want & (bound <= limit[own][:, None] + ERROR * (1 + limit[own][:, None]))
                for c in np.flatnonzero(want.any(axis=0)):
                    rows = own[want[:, c]]
                    for at in range(0, len(rows), BLOCK):
                        some = pa.array(rows[at : at + BLOCK])
                        asked = pa.StructArray.from_arrays([items.take(some), batch.column(2).take(some), batch.column(4).take(some)], ["item_id", "vector", "limit"])
                        for block in range(-(-int(n[c]) // BLOCK)):
                            row = [users.take(some[:1]), pa.array([int(of[c])], pa.int32()), pa.array([block], pa.int64()), pa.array([len(some)], pa.int64()), pa.ListArray.from_arrays([0, len(some)], asked)]
                            yield pa.RecordBatch.from_arrays(row, ["user_id", "cell", "block", "n", "asked"])

    return run


def _best_of_blocks(top: int, prefetch: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a block of items and a block of chunks what may be among an item's nearest: those within its limit that no others of the block push out."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, held in zip(batch.column(0), batch.column(1)):
                (items, limits), q = _opened(asked, 1)
                (others, chunk_ids), c = _opened(held, 2)
                known = limits.to_numpy(zero_copy_only=False)
                order = np.argsort(_ranks(others), kind="stable")
                others, chunk_ids, c = others.take(pa.array(order)), chunk_ids.take(pa.array(order)), c[order]
                both = _ranks(pa.concat_arrays([items, others]))
                mine, theirs, chunk_rank = both[: len(items)], both[len(items) :], _ranks(chunk_ids)
                starts = np.flatnonzero(np.concatenate([[True], theirs[1:] != theirs[:-1]]))
                q2, c2 = (q * q).sum(axis=1), (c * c).sum(axis=1)
                slack = ERROR * (1 + q2.max() + c2.max())
                step = max(1, AT_ONCE // len(c))
                for at in range(0, len(q), step):
                    near = q2[at : at + step, None] + c2 - 2 * (q[at : at + step] @ c.T)
                    near[mine[at : at + step, None] == theirs] = np.inf
                    judged = near if prefetch else np.minimum.reduceat(near, starts, axis=1)
                    k = min(prefetch or top, judged.shape[1])
                    limit = np.minimum(np.partition(judged, k - 1, axis=1)[:, k - 1], known[at : at + step] ** 2)[:, None] + slack
                    i, j = np.nonzero((near <= limit) & np.isfinite(near))
                    exact = np.zeros(len(i))
                    for d in range(q.shape[1]):
                        exact += (c[j, d] - q[at + i, d]) ** 2
                    exact = np.sqrt(exact)
                    if not prefetch:  # the best chunk of each item
                        rank = np.lexsort((chunk_rank[j], exact, theirs[j], i))
                        rank = rank[_within(i[rank] * len(both) + theirs[j[rank]]) == 0] if len(i) else rank
                        i, j, exact = i[rank], j[rank], exact[rank]
                    rank = np.lexsort((chunk_rank[j] if prefetch else theirs[j], exact, i))
                    rank = rank[_within(i[rank]) < k] if len(i) else rank
                    i, j = pa.array(at + i[rank]), pa.array(j[rank])
                    yield pa.RecordBatch.from_arrays([items.take(i), others.take(j), chunk_ids.take(j), pa.array(exact[rank])], ["item_a", "item_b", "chunk_id", "distance"])

    return best


def neighbours(index: VectorIndex, means: DataFrame, top: int, prefetch: int | None = None, within: float = float("inf"), readings: tuple[Observation, Observation] | None = None) -> DataFrame:
    """For each item (item_id, user_id, mean) its ``top`` nearest others of the same user by best chunk: item_a, item_b, distance, rn.

    With ``prefetch`` only so many nearest chunks are looked at; what is farther than
    ``within`` may be missing. An item's own chunks
    are left out, and so are null means and users; ties go to the smaller item (with
    ``prefetch``: chunk, then item). Items meet the cells they need in two rounds, in
    blocks: no pair of rows is a row, and no block goes where no item needs it.
    ``readings`` observe how many (item, cell block) pairs each round reads, as ``n``.
    """
    kinds = {n: index.rows.schema[n].dataType.simpleString() for n in KEYS}
    if not len(index.centres):
        return means.sparkSession.createDataFrame([], f"item_a {kinds['item_id']}, item_b {kinds['item_id']}, distance double, rn int")
    sizes = index.cells.select("user_id", "cell", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    dealt = index.rows.join(sizes, ["user_id", "cell"]).withColumn("block", F.pmod(F.xxhash64("item_id", "chunk_id"), "blocks"))
    held = dealt.groupBy("user_id", "cell", "block").agg(F.collect_list(F.struct("item_id", "chunk_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))).alias("held"))
    of_user = index.cells.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("cell", "n", "lo", "hi"))).alias("cells"))  # at most CELLS
    asked = means.where("mean is not null and user_id is not null").join(of_user, "user_id").select("user_id", "item_id", F.col("mean").alias("vector"), "cells")
    enough = AHEAD * (prefetch or top)

    def met(some: DataFrame, first: bool) -> DataFrame:
        routed = some.mapInArrow(_router(index.centres, enough, first), f"user_id {kinds['user_id']}, cell int, block bigint, n bigint, asked array<struct<item_id: {kinds['item_id']}, vector: array<double>, limit: double>>")
        if readings:
            routed = routed.observe(readings[not first], F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        both = routed.join(held, ["user_id", "cell", "block"]).select("asked", "held")
        return both.mapInArrow(_best_of_blocks(top, prefetch), f"item_a {kinds['item_id']}, item_b {kinds['item_id']}, chunk_id {kinds['chunk_id']}, distance double")

    def near_chunks(near: DataFrame) -> DataFrame:
        order = W.partitionBy("item_a").orderBy("distance", "chunk_id")
        return near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= prefetch) if prefetch else near

    def near_items(near: DataFrame) -> DataFrame:
        best = near.groupBy("item_a", "item_b").agg(F.min("distance").alias("distance"))
        return best.withColumn("rn", F.row_number().over(W.partitionBy("item_a").orderBy("distance", "item_b"))).where(F.col("rn") <= top)

    seed = written(met(asked.withColumn("limit", F.lit(within)), True), "neighbours-seed")
    last = near_chunks(seed).where(F.col("k") == prefetch) if prefetch else near_items(seed).where(F.col("rn") == top)
    limits = last.select(F.col("item_a").alias("item_id"), F.col("distance").alias("limit"))
    rest = met(asked.join(limits, "item_id", "left").select("user_id", "item_id", "vector", "cells", F.coalesce("limit", F.lit(within)).alias("limit")), False)
    return near_items(near_chunks(seed.unionByName(rest)))
