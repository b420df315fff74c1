"""The stage pipeline: items go through their stages one by one, with retries, as state that outlives a query.

One function, ``Stages.step``, takes an item from a point in time as far as it comes: a
stage that ends hands on to the next, an error that no retry mends ends the item, any
other waits for its backoff, and the last attempt ends it too. ``stream`` keeps the
state of each item in Spark's state store, with a timer for each wait; ``batch`` runs the
same function over events in the order of their times. What is said of an attempt
carries the time at which it was due, so results do not depend on how the events were
cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attempts of a stage, and the waits between them.
ATTEMPTS, BASE_MS, CAP_MS = 5, 1_000, 900_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SAID = "stage string, attempt int, ms bigint, outcome string, status string, reason string"
COLUMNS = [x.split()[0] for x in SAID.split(", ")]
STATE = "at int, attempts int, due bigint, status string, payload string"


class PermanentError(Exception):
    """An error that no retry mends."""


class Item(NamedTuple):
    """``at`` is the stage that comes next, ``due`` its time (null: nothing waits)."""

    at: int
    attempts: int
    due: int | None
    status: str
    payload: str | None


class Stages:
    """Named stages in their order; each is called with the item's id, payload and attempt, and fails by raising."""

    def __init__(self, stages: list[tuple[str, Callable[[Any, str | None, int], None]]], attempts: int = ATTEMPTS, base_ms: int = BASE_MS, cap_ms: int = CAP_MS):
        self.stages, self.most, self.base_ms, self.cap_ms = stages, attempts, base_ms, cap_ms
        self.names = [name for name, _ in stages]

    def start(self, item: Item | None, ms: int, stage: str | None, payload: str | None) -> tuple[Item | None, list[tuple]]:
        """A request to run an item from a stage (null: the first). One that waits is left alone, and so is an unknown stage."""
        if item is not None and item.due is not None:
            return item, [(stage, None, ms, "conflict", item.status, None)]
        if stage is not None and stage not in self.names:
            return item, [(stage, None, ms, "unknown stage", item.status if item else None, None)]
        at = self.names.index(stage) if stage else 0
        return Item(at, 0, ms, "processing", payload if payload is not None or item is None else item.payload), []

    def step(self, key: Any, item: Item, until: int) -> tuple[Item, list[tuple]]:
        """Run what is due up to ``until``."""
        said = []
        while item.due is not None and item.due <= until:
            (name, run), attempt, now = self.stages[item.at], item.attempts + 1, item.due
            try:
                run(key, item.payload, attempt)
            except PermanentError as e:
                item = item._replace(attempts=attempt, due=None, status="failed")
                said.append((name, attempt, now, "failed", "failed", str(e)))
            except Exception as e:  # noqa: BLE001  any other error may pass
                if attempt >= self.most:
                    item = item._replace(attempts=attempt, due=None, status="failed")
                    said.append((name, attempt, now, "failed", "failed", f"{e} (gave up after {self.most} attempts)"))
                else:
                    item = item._replace(attempts=attempt, due=now + min(self.cap_ms, self.base_ms * 2 ** (attempt - 1)))
                    said.append((name, attempt, now, "retry", "processing", str(e)))
            else:
                last = item.at + 1 == len(self.stages)
                item = item._replace(at=item.at + 1, attempts=0, due=None if last else now, status="done" if last else "processing")
                said.append((name, attempt, now, "done", item.status, None))
        return item, said

    def take(self, key: Any, item: Item | None, rows: list[tuple]) -> tuple[Item | None, list[tuple]]:
        """Requests (ms, stage, payload) of one item in the order of their times; what falls due before each runs before it."""
        said = []
        for ms, stage, payload in sorted(rows, key=lambda r: (r[0], r[1] or "", r[2] or "")):
            if item is not None:
                item, more = self.step(key, item, ms)
                said += more
            item, more = self.start(item, ms, stage, payload)
            said += more
            if item is not None:
                item, more = self.step(key, item, ms)
                said += more
        return item, said


def _frame(key: Any, name: str, said: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(said, columns=COLUMNS)
    out["attempt"] = out["attempt"].astype("Int32")
    out.insert(0, name, [key] * len(out))
    return out


def _plain(value: Any) -> Any:
    return None if value is None or value is pd.NA or value != value else value


def _requests(rows: pd.DataFrame) -> list[tuple]:
    return [(int(ms), _plain(stage), _plain(payload)) for ms, stage, payload in rows[["ms", "stage", "payload"]].itertuples(index=False, name=None)]


def batch(requests: DataFrame, stages: Stages, until_ms: int | None = None, id_col: str = "item_id") -> DataFrame:
    """What each attempt of each item came to, over requests (``id_col``, ``ms``, ``stage``, ``payload``): id, stage, attempt, ms, outcome, status, reason.

    With ``until_ms`` waits that end later are left waiting; without, all run out. An
    item's requests are few; items are dealt out by key and worked off one by one.
    """
    kind = requests.schema[id_col].dataType.simpleString()

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            yield from frame.itertuples(index=False, name=None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for own, asked in groupby(rows(frames), key=lambda r: r[0]):
            item, said = stages.take(own, None, [(int(ms), _plain(stage), _plain(payload)) for _, ms, stage, payload in asked])
            if item is not None:
                said += stages.step(own, item, 2**62 if until_ms is None else until_ms)[1]
            held.append(_frame(own, id_col, said))
            if len(held) >= 500:
                yield pd.concat(held)
                held = []
        if held:
            yield pd.concat(held)

    dealt = requests.select(id_col, "ms", "stage", "payload").where(F.col(id_col).isNotNull()).repartition(id_col).sortWithinPartitions(id_col, "ms")
    return dealt.mapInPandas(run, f"{id_col} {kind}, {SAID}")


def stream(requests: DataFrame, stages: Stages, lateness: str = "10 seconds", id_col: str = "item_id") -> DataFrame:
    """The same over a stream of requests; a wait ends when the watermark on ``ms`` passes it.

    An item's place, attempts and wait are in the state store, so a query that is
    stopped or killed goes on from its checkpoint: what an attempt came to is
    emitted, and counts, once. A stage itself may run again if its micro-batch was
    cut off, so its effect must bear that. The session needs the RocksDB state store.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    kind = requests.schema[id_col].dataType.simpleString()
    if requests.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.items = handle.getValueState("item", STATE)

        def _item(self) -> Item | None:
            return Item(*self.items.get()) if self.items.exists() else None

        def _keep(self, item: Item | None, before: int | None) -> None:
            if item is None:
                return
            self.items.update(tuple(item))
            if before is not None and before != item.due:
                self.handle.deleteTimer(before)
            if item.due is not None and before != item.due:
                self.handle.registerTimer(item.due)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            was = self._item()
            item, said = stages.take(key[0], was, [r for frame in rows for r in _requests(frame)])
            self._keep(item, was.due if was else None)
            yield _frame(key[0], id_col, said)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            was = self._item()
            # a timer that is set here would end no sooner than the next micro-batch
            item, said = stages.step(key[0], was, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
            self.items.update(tuple(item))
            if item.due is not None:
                self.handle.registerTimer(item.due)
            yield _frame(key[0], id_col, said)

    timed = requests.select(id_col, "ms", "stage", "payload", F.timestamp_millis("ms").alias("at")).where(F.col(id_col).isNotNull()).withWatermark("at", lateness)
    return timed.groupBy(id_col).transformWithStateInPandas(Processor(), f"{id_col} {kind}, {SAID}", "Append", "EventTime")
