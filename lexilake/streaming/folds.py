"""Order-dependent folds over events: limiters, budgets, job states.

Each fold is one Python function over the ordered events of a key and its state.
Streams run it with ``applyInPandasWithState``, where a frame is what a key has in one
micro-batch. In batch the limiters are parallel scans (``scans``), which decide alike;
job states, whose keys are jobs with few events each, run by ``applyInPandas``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fixed_window(state: tuple | None, ms: int, limit: int, window_ms: int) -> tuple[tuple, tuple[bool, int]]:
    """A window opens at the first event after the last one ended. State: count, end."""
    count, end = state if state and ms < state[1] else (0, ms + window_ms)
    count += 1
    return (count, end), ((False, max(1, math.ceil((end - ms) / 1000))) if count > limit else (True, 0))


def token_bucket(state: tuple | None, ms: int, capacity: int, per_minute: int | Fraction) -> tuple[tuple, tuple[int, float]]:
    """Events queue up and none is refused: each proceeds when its turn has come and there is a token.

    Said of each event: when it proceeds, in whole milliseconds, and the tokens left
    then. State: when the bucket would last have been empty (in fractions of a
    millisecond, so nothing is rounded), and the time of the last event.
    """
    each = Fraction(60_000) / Fraction(per_minute)
    e, q = each.numerator, each.denominator
    empty, last = state or (ms * q - capacity * e, ms)
    at = max(ms, last, -(-(empty + e) // q))
    empty = max(empty, at * q - capacity * e) + e
    return (empty, at), (at, (at * q - empty) / e)


def budget_lane(state: tuple | None, ms: int, lane: str, cap: int, reserve: int) -> tuple[tuple, tuple[bool, int]]:
    """One unit of the UTC day's budget; the background lane leaves the reserve. State: day, used."""
    day = ms // 86_400_000
    used = state[1] if state and state[0] == day else 0
    limit = cap if lane == "interactive" else cap - reserve
    if used >= limit:
        return (day, used), (False, 0)
    return (day, used + 1), (True, limit - used - 1)


def job_state(state: tuple | None, ms: int, what: str, most: int = 5, base_ms: int = 1000, cap_ms: int = 900_000) -> tuple[tuple, tuple[str, int, int]]:
    """enqueue, claim, done, fail. State: status, attempts, due."""
    status, attempts, due = state or ("none", 0, 0)
    if what == "enqueue" and status in ("none", "done", "failed"):
        status, attempts, due = "queued", 0, ms
    elif what == "claim" and status == "queued" and ms >= due:
        status, attempts = "active", attempts + 1
    elif what == "done" and status == "active":
        status = "done"
    elif what == "fail" and status == "active":
        status, due = ("failed", due) if attempts >= most else ("queued", ms + min(cap_ms, base_ms * 2 ** max(0, attempts - 1)))
    return (status, attempts, due), (status, attempts, due)


def folded(events: DataFrame, key: str, columns: list[str], step: Callable, schema: str, order: tuple[str, ...] = ("ms", "event_id")) -> DataFrame:
    """Run a fold over each key's events in order: key, the order columns and what the step says of each event."""
    kind = lambda c: events.schema[c].dataType.simpleString()
    names = [x.split()[0] for x in schema.split(",")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order))
        state, out = None, []
        for values in rows[columns].itertuples(index=False, name=None):
            state, said = step(state, *values)
            out.append(said)
        return pd.concat([rows[[key, *order]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    head = ", ".join(f"{c} {kind(c)}" for c in (key, *order))
    return events.select(key, *dict.fromkeys([*order, *columns])).groupBy(key).applyInPandas(run, f"{head}, {schema}")


def folded_stream(events: DataFrame, key: str, columns: list[str], step: Callable, schema: str, state_schema: str, order: tuple[str, ...] = ("ms", "event_id")) -> DataFrame:
    """The same fold over a stream: each micro-batch is ordered and continues from the kept state."""
    kind = lambda c: events.schema[c].dataType.simpleString()
    names = [x.split()[0] for x in schema.split(",")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(list(order))
        state, out = (tuple(kept.get) if kept.exists else None), []
        for values in rows[columns].itertuples(index=False, name=None):
            state, said = step(state, *values)
            out.append(said)
        kept.update(state)
        yield pd.concat([rows[[key, *order]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    head = ", ".join(f"{c} {kind(c)}" for c in (key, *order))
    chosen = events.select(key, *dict.fromkeys([*order, *columns]))
    return chosen.groupBy(key).applyInPandasWithState(run, f"{head}, {schema}", state_schema, "append", GroupStateTimeout.NoTimeout)


def spaced(events: DataFrame, key: str, gap_ms: int) -> DataFrame:
    """When each event may start, at least a gap behind the one before of its key.

    ``start_i = max(arrival_i, start_(i-1) + gap)`` is a running maximum of
    ``arrival_j - j * gap``, so no fold is needed.
    """
    w = W.partitionBy(key).orderBy("ms", "event_id")
    n = F.row_number().over(w) * gap_ms
    return events.withColumn("n", n).withColumn("start", F.max(F.col("ms") - F.col("n")).over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("n")).drop("n")


def single_lane_budget(events: DataFrame, limit: int) -> DataFrame:
    """Events of one lane: the first ``limit`` of each UTC day are admitted."""
    w = W.partitionBy("day").orderBy("ms", "event_id")
    return events.withColumn("day", F.floor(F.col("ms") / 86_400_000)).withColumn("admitted", F.row_number().over(w) <= limit)


def released(items: DataFrame, per_tick: int) -> DataFrame:
    """The tick in which each waiting item is released, oldest first within a user."""
    w = W.partitionBy("user_id").orderBy("pos")
    return items.withColumn("tick", F.floor((F.row_number().over(w) - 1) / per_tick))


def daily_counts(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Tumbling-day counts by type; late events within the watermark still count."""
    days = events.withWatermark("at", lateness).groupBy(F.window("at", "1 day"), "event_type")
    return days.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.unix_millis("window.start").alias("day_ms"), "event_type", "n", "value")
