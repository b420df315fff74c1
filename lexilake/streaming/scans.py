"""Limiters as parallel scans: a key's events are cut into blocks, and blocks are put together by what they do to a state.

``blocked`` deals events out in ranges of (key, order), so a hot key is many blocks of
bounded size. What happens inside a block is worked out for every block at once; what
it does to the state that enters it is a small value or function; and the states that
enter the blocks of a key follow from those by a prefix over blocks, of which there are
as many as tasks, not as events. No frame and no task holds a key.

The three limiters decide as their folds in ``folds`` do, which streams keep using.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexilake.sources.stored import written

#: Events of a block.
BLOCK = 1 << 20
DAY_MS = 86_400_000
ORDER = ("ms", "event_id")


def blocked(events: DataFrame, key: str, order: tuple[str, ...] = ORDER, block: int | None = None) -> DataFrame:
    """The events with the number ``block`` of their range of (key, order); the key's blocks follow its order. Stored, so numbers stay."""
    spark = events.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-events.count() // (block or BLOCK)))
    return written(events.repartitionByRange(parts, key, *order).withColumn("block", F.spark_partition_id()), "event-blocks")


def _own(key: str, order: tuple[str, ...]) -> W:
    return W.partitionBy(key, "block").orderBy(*order)


def _earlier(key: str) -> W:
    return W.partitionBy(key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)


def _entering(local: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Each event with what stands before its block; a null key is a key."""
    before = before.withColumnsRenamed({key: "_key", "block": "_block"})
    return local.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block"))).drop("_key", "_block")


def with_sums(rows: DataFrame, key: str, sums: dict[str, Column], order: tuple[str, ...] = ORDER) -> DataFrame:
    """Running sums over a key's events, their own value included. ``rows`` are ``blocked``; sums of whole numbers, as bigint."""
    totals = rows.groupBy(key, "block").agg(*[F.sum(v.cast("bigint")).alias(n) for n, v in sums.items()])
    before = totals.select(key, "block", *[F.coalesce(F.sum(n).over(_earlier(key)), F.lit(0)).alias(f"{n}_before") for n in sums])
    local = rows.withColumns({n: F.sum(v.cast("bigint")).over(_own(key, order).rowsBetween(W.unboundedPreceding, 0)) for n, v in sums.items()})
    both = _entering(local, before, key)
    return both.withColumns({n: F.col(n) + F.col(f"{n}_before") for n in sums}).drop(*[f"{n}_before" for n in sums])


def budget_lanes(events: DataFrame, key: str, cap: int, reserve: int, order: tuple[str, ...] = ORDER, block: int | None = None) -> DataFrame:
    """``ok`` and ``remaining`` of each event (``ms``, ``lane``) of a key (a UTC day), as ``folds.budget_lane``.

    Up to ``cap - reserve`` events of a day, all are admitted; of those behind them the
    first ``reserve`` that are interactive. So two running sums decide: an event's
    place, and how many interactive ones stand behind that place up to it.
    """
    open_to_all = max(0, min(cap, cap - reserve))
    placed = with_sums(blocked(events, key, order, block), key, {"place": F.lit(1)}, order)
    late = (F.col("lane") == "interactive") & (F.col("place") > open_to_all)
    # a place is in the same block as before, so the blocks hold for the second sum too
    both = with_sums(written(placed, "placed-events"), key, {"late": late.cast("int")}, order)
    used = F.when(F.col("place") <= open_to_all, F.col("place") - 1).otherwise(open_to_all + F.col("late") - 1)
    most = F.when(F.col("lane") == "interactive", cap).otherwise(cap - reserve)
    ok = F.when(F.col("lane") == "interactive", used < cap).otherwise(F.col("place") <= open_to_all)
    return both.select(*events.columns, ok.alias("ok"), F.when(ok, most - used - 1).otherwise(0).cast("bigint").alias("remaining"))


def token_bucket(events: DataFrame, key: str, capacity: int, per_minute: int | Fraction, order: tuple[str, ...] = ORDER, block: int | None = None) -> DataFrame:
    """``at`` (when each event proceeds) and ``tokens`` (left then), as ``folds.token_bucket``, with exact fractions of a millisecond.

    Let a token take ``e`` to come and ``z`` be the time at which the bucket would last
    have been empty: an event proceeds at the whole millisecond from ``z + e`` on, and
    ``z`` becomes ``max(z + e, ms - (capacity - 1) * e)``. That is a sum and a maximum, so
    the i-th ``z`` is ``i * e`` plus a running maximum of ``ms_j - j * e``; a block hands on
    its number of events and its maximum. Needs a token less than the capacity to take a
    millisecond or more, or a capacity of one; else an error: use the fold.
    """
    each = Fraction(60_000) / Fraction(per_minute)
    if capacity == 1:
        each = Fraction(-(-each.numerator // each.denominator))  # the wait is whole, and nothing is left
    elif capacity < 1 or (capacity - 1) * each < 1:
        raise ValueError("tokens come faster than whole milliseconds can tell: use folds.token_bucket")
    e, q = each.numerator, each.denominator  # times in units of 1 / q of a millisecond
    own = _own(key, order)
    rows = blocked(events, key, order, block)
    j = F.row_number().over(own).cast("bigint")
    local = rows.withColumn("j", j).withColumn("lead", F.col("ms") * q - F.col("j") * e)
    local = local.withColumn("top", F.max("lead").over(own.rowsBetween(W.unboundedPreceding, -1)))
    sizes = local.groupBy(key, "block").agg(F.count("*").alias("n"), F.max("lead").alias("top"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(_earlier(key)), F.lit(0)))
    before = before.withColumn("top_before", F.max(F.col("top") - F.col("before") * e).over(_earlier(key))).select(key, "block", "before", "top_before")
    both = _entering(local, before, key)
    i = F.col("before") + F.col("j")
    top = F.greatest(F.col("top") - F.col("before") * e, "top_before")  # null only where no event is before
    both = both.withColumn("free", i * e + top - (capacity - 1) * e)
    both = both.withColumn("at", F.greatest("ms", F.expr(f"(free + pmod(-free, {q}L)) div {q}L")))
    z = F.greatest("free", F.col("at") * q - (capacity - 1) * e)
    return both.select(*events.columns, "at", ((F.col("at") * q - z) / e).alias("tokens"))


class Windows:
    """What a run of events does to the end of the open window: a step function, and the rank of the event that opened the last one.

    An end up to ``breaks[k]`` and above ``breaks[k - 1]`` becomes ``ends[k]``, opened by the
    event of ``ranks[k]``; an end above all breaks stays.
    """

    def __init__(self, breaks: np.ndarray, ends: np.ndarray, ranks: np.ndarray):
        self.breaks, self.ends, self.ranks = breaks, ends, ranks

    @classmethod
    def of(cls, ms: np.ndarray, first: int, window: int) -> Windows:
        """Of sorted times whose first has rank ``first``. Windows follow each other by links to the first event at or behind their end; links are doubled."""
        n = len(ms)
        after = np.searchsorted(ms, ms + window, "left")
        last = np.where(after < n, after, np.arange(n))
        while True:
            further = last[last]
            if (further == last).all():
                break
            last = further
        breaks, entry = np.unique(ms, return_index=True)
        last = last[entry]
        keep = np.append(last[1:] != last[:-1], True)
        return cls(breaks[keep], ms[last[keep]] + window, first + last[keep])

    def __call__(self, end: int, rank: int) -> tuple[int, int]:
        k = int(np.searchsorted(self.breaks, end, "left"))
        return (int(self.ends[k]), int(self.ranks[k])) if k < len(self.breaks) else (end, rank)

    def then(self, later: Windows) -> Windows:
        """First this, then ``later``, whose events come after."""
        k = np.searchsorted(later.breaks, self.ends, "left")
        inside = k < len(later.breaks)
        at = np.minimum(k, len(later.breaks) - 1)
        ends, ranks = np.where(inside, later.ends[at], self.ends), np.where(inside, later.ranks[at], self.ranks)
        new = later.breaks > self.breaks[-1]
        breaks, ends, ranks = (np.concatenate(x) for x in ((self.breaks, later.breaks[new]), (ends, later.ends[new]), (ranks, later.ranks[new])))
        keep = np.append((ends[1:] != ends[:-1]) | (ranks[1:] != ranks[:-1]), True)
        return Windows(breaks[keep], ends[keep], ranks[keep])

    def packed(self) -> list[bytes]:
        return [x.astype(np.int64).tobytes() for x in (self.breaks, self.ends, self.ranks)]

    @classmethod
    def unpacked(cls, *blobs: pa.Scalar) -> Windows:
        return cls(*(np.frombuffer(b.as_buffer(), np.int64) for b in blobs))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks whole (rows come sorted by block, key, order; the first column is the block) with the edges of their runs of a key."""
    held: list[pa.RecordBatch] = []
    at = None

    def whole() -> tuple[pa.RecordBatch, np.ndarray]:
        block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        codes = block.column(1).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        codes = np.where(np.isnan(codes), -1, codes) if codes.dtype.kind == "f" else codes
        return block, np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]])

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            if held and blocks[lo] != at:
                yield whole()
                held = []
            at = blocks[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield whole()


def fixed_window(events: DataFrame, key: str, limit: int, window_ms: int, order: tuple[str, ...] = ORDER, block: int | None = None) -> DataFrame:
    """``allowed`` and ``retry_after_sec`` of each event, as ``folds.fixed_window``: a window opens at the first event at or behind the end of the last.

    The function of each block of a key with several is put together with those
    before it by doubling: after k rounds it is that of 2^k blocks. Then every block
    knows the window that is open when it begins, and an event's place in its window
    is the difference of two ranks. A null key is a key.
    """
    spark = events.sparkSession
    kind = events.schema[key].dataType.simpleString()
    rows = with_sums(blocked(events, key, order, block), key, {"rank": F.lit(1)}, order)
    rows = written(rows, "ranked-events")
    parts = max(1, rows.select("block").distinct().count())
    by_block = rows.select("block", key, "rank", *order).repartition(parts, "block").sortWithinPartitions("block", key, *order)

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, edges in _runs(batches):
            ms, rank = own.column(3).to_numpy(), own.column(2).to_numpy()
            for lo, hi in {(edges[0], edges[1]), (edges[-2], edges[-1])}:  # the others lie inside their block
                f = Windows.of(ms[lo:hi], int(rank[lo]), window_ms)
                row = [own.column(1).slice(lo, 1), own.column(0).slice(lo, 1), *[pa.array([b], pa.binary()) for b in f.packed()]]
                yield pa.RecordBatch.from_arrays(row, [key, "block", "breaks", "ends", "ranks"])

    packed = f"{key} {kind}, block int, breaks binary, ends binary, ranks binary"
    found = written(by_block.mapInArrow(functions, packed).withColumn("k", F.row_number().over(W.partitionBy(key).orderBy("block"))), "window-functions")
    most = found.agg(F.coalesce(F.max("k"), F.lit(1))).head()[0]

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i) for i in range(3, 9))):
                f = Windows.unpacked(*row[:3])
                out.append((Windows.unpacked(*row[3:]).then(f) if row[3].is_valid else f).packed())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *[pa.array([r[i] for r in out], pa.binary()) for i in range(3)]], [key, "block", "k", "breaks", "ends", "ranks"])

    step = 1
    while step < most:
        before = found.select(F.col(key).alias("_key"), (F.col("k") + step).alias("_k"), *[F.col(c).alias(f"_{c}") for c in ("breaks", "ends", "ranks")])
        met = found.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("k") == F.col("_k")), "left")
        met = met.select(key, "block", "k", "breaks", "ends", "ranks", "_breaks", "_ends", "_ranks")
        found = written(met.mapInArrow(composed, f"{key} {kind}, block int, k int, breaks binary, ends binary, ranks binary"), "window-functions")
        step *= 2

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [Windows.unpacked(*row)(-(2**62), 0) for row in zip(*(batch.column(i) for i in range(2, 5)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([s[i] for s in said], pa.int64()) for i in (0, 1)]], [key, "k", "end", "opener"])

    ends = found.select(key, "k", "breaks", "ends", "ranks").mapInArrow(entered, f"{key} {kind}, k int, end bigint, opener bigint")
    after = ends.select(F.col(key).alias("_key"), (F.col("k") + 1).alias("_k"), "end", "opener")
    entry = found.select(F.col(key).alias("_own"), "k", F.col("block").alias("_block")).join(after, F.col("_own").eqNullSafe(F.col("_key")) & (F.col("k") == F.col("_k"))).select("_own", "_block", "end", "opener")
    # one row for each block at most: a key that came from the block before
    opened = by_block.join(entry, (F.col("block") == F.col("_block")) & F.col(key).eqNullSafe(F.col("_own")), "left").select("block", key, "rank", *order, "end", "opener")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, edges in _runs(batches):
            n = own.num_columns
            ms, rank = own.column(3).to_numpy(), own.column(2).to_numpy()
            end_of, opener_of = np.empty(len(ms), np.int64), np.empty(len(ms), np.int64)
            for lo, hi in zip(edges[:-1], edges[1:]):
                end, opener, at = own.column(n - 2)[lo].as_py(), own.column(n - 1)[lo].as_py(), lo
                while at < hi:
                    if end is None or ms[at] >= end:
                        end, opener = int(ms[at]) + window_ms, int(rank[at])
                    until = lo + int(np.searchsorted(ms[lo:hi], end, "left"))
                    end_of[at:until], opener_of[at:until] = end, opener
                    at = until
            allowed = rank - opener_of < limit
            wait = np.where(allowed, 0, np.maximum(1, -(-(end_of - ms) // 1000)))
            yield pa.RecordBatch.from_arrays([own.column(1), *[own.column(3 + i) for i in range(len(order))], pa.array(allowed), pa.array(wait)], [key, *order, "allowed", "retry_after_sec"])

    kinds = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in order)
    return opened.repartition(parts, "block").sortWithinPartitions("block", key, *order).mapInArrow(judged, f"{key} {kind}, {kinds}, allowed boolean, retry_after_sec bigint")
