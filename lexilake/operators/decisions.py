"""Decisions over tables: models, attempts, retries, checks before a write, extension points."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexilake.functions import urls as U
from lexilake.sources.stored import written
from lexilake.streaming import scans as Y

UNKNOWN_CONTEXT = 8192
#: Parts of the terms in which two keyword indexes are compared.
SYNC_PARTS = 65_536
#: Extraction errors that a retry may cure, and those that it may not.
RETRYABLE = ("rate_limited", "blocked", "network_error")
PERMANENT = ("unsupported_url", "not_found", "invalid_pdf")
STAGES = ("resolve", "extract", "enrich", "embed", "relate", "index")


class Embedder(Protocol):
    """Vectors of passages and of queries; the two may differ by a prefix."""

    model: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class HashEmbedder:
    """A deterministic embedder for tests: words hashed onto signed places, unit length."""

    model = "hash"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(word.encode()[:8].ljust(8, b"\1"), "little") * 0x9E3779B97F4A7C15 & (1 << 64) - 1
                out[row, h % self.dimensions] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    def embed_query(self, text: str) -> list[float]:
        return self.embed([text])[0]


def embedded(chunks: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """Chunks with their vectors in the same rows, so neither can be written without the other. A wrong width raises."""
    columns = [f.name for f in chunks.schema]
    width = embedder.dimensions

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts, vectors = rows["text"].fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                vectors += embedder.embed(texts[at : at + batch])
            if any(len(v) != width for v in vectors):
                raise ValueError(f"the embedder gave another width than {width}")
            yield rows[columns].assign(embedding=vectors, embedding_model=embedder.model)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInPandas(run, f"{schema}, embedding array<float>, embedding_model string")


def requests_left(cap: int, reserve: int, used: int, lane: str) -> int:
    """How many requests a lane may still make today; the background lane leaves the reserve."""
    return max(0, (cap if lane == "interactive" else cap - reserve) - used)


def granted(chunks: DataFrame, order: tuple[str, ...], left: int, batch: int = 64, block: int | None = None) -> DataFrame:
    """The chunks with ``batch``, the number of the request that each goes in, and ``granted``: the first ``left`` requests.

    Requests are counted before any is made: places are running sums over blocks of
    the order (``streaming.scans``), so no task sees all chunks, and the sum of what
    all tasks are granted is never above what is left.
    """
    rows = Y.blocked(chunks.withColumn("_all", F.lit(0)), "_all", order, block)
    placed = Y.with_sums(rows, "_all", {"_place": F.lit(1)}, order)
    number = F.floor((F.col("_place") - 1) / batch).cast("bigint")
    return placed.select(*chunks.columns, number.alias("batch"), (number < left).alias("granted"))


def embedded_within(chunks: DataFrame, embedder: Embedder, order: tuple[str, ...], left: int, batch: int = 64, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of the requests that the budget grants with their vectors, and those of the refused ones, to be asked for again.

    A request is one call of the embedder for up to ``batch`` chunks, and counts as
    one whatever it holds; no chunk, no request.
    """
    judged = written(granted(chunks, order, left, batch, block), "granted-chunks")
    own = F.struct(*[F.col(c) for c in chunks.columns])
    calls = judged.where("granted").groupBy("batch").agg(F.array_sort(F.collect_list(own)).alias("rows"))  # at most ``batch`` rows
    width, names = embedder.dimensions, chunks.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, rows in zip(frame["batch"], frame["rows"]):
                made = pd.DataFrame([tuple(r[c] for c in names) for r in rows], columns=names)
                vectors = embedder.embed(made["text"].fillna("").tolist())
                if any(len(v) != width for v in vectors):
                    raise ValueError(f"the embedder gave another width than {width}")
                yield made.assign(batch=number, embedding=vectors, embedding_model=embedder.model)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return calls.mapInPandas(run, f"{schema}, batch bigint, embedding array<float>, embedding_model string"), judged.where("not granted").drop("granted")


def one_model(chunks: DataFrame, model: str) -> None:
    """Raise if the stored vectors are of another model, or of several widths."""
    seen = chunks.agg(F.collect_set("embedding_model").alias("models"), F.count_distinct(F.size("embedding")).alias("widths")).head()
    if set(seen["models"]) - {model} or seen["widths"] > 1:
        raise ValueError(f"vectors of {sorted(seen['models'])} cannot be mixed with {model}")


def longest_context(chain: DataFrame, models: DataFrame) -> DataFrame:
    """The largest context of each chain of models; unknown ones count as 8192."""
    met = chain.join(models.select("model", "context"), "model", "left")
    return met.groupBy("chain").agg(F.max(F.coalesce("context", F.lit(UNKNOWN_CONTEXT))).alias("context"))


def repaired(attempts: DataFrame) -> DataFrame:
    """The outcome of validate-then-repair: the first two attempts of a call count."""
    w = W.partitionBy("call_id").orderBy("attempt")
    two = attempts.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    out = two.groupBy("call_id").agg(F.min(F.when(F.col("ok"), F.col("rn"))).alias("won"))
    return out.select("call_id", F.when(F.col("won") == 1, "valid").when(F.col("won") == 2, "repaired").otherwise("failed").alias("outcome"))


def may_retry(error: Column) -> Column:
    return F.coalesce(error.isin(*RETRYABLE), F.lit(False))


def retries(asked: DataFrame, jobs: DataFrame) -> DataFrame:
    """Whether a retry (item_id, stage) starts: not from resolve, a known stage, nothing of the item pending."""
    pending = jobs.where(F.col("state").isin("queued", "active")).select("item_id").distinct().withColumn("busy", F.lit(True))
    met = asked.join(pending, "item_id", "left")
    why = F.when(F.col("stage") == "resolve", "not allowed").when(~F.col("stage").isin(*STAGES), "unknown stage").when(F.col("busy"), "conflict").otherwise("started")
    return met.select("item_id", "stage", why.alias("outcome"))


def staged(items: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Run the registered stages in their order; each replaces an item's rows, so a rerun changes nothing."""
    for name in STAGES:
        if name in stages:
            items = stages[name](items)
    return items


def conversations_resolved(asked: DataFrame, known: DataFrame) -> DataFrame:
    """The conversation of each request (request_id, user_id, conv_id, message): the user's own, else a new one named by the message."""
    own = known.select(F.col("conv_id").alias("k"), F.col("user_id").alias("u"), F.col("title").alias("old"))
    met = asked.join(own, (F.col("conv_id") == F.col("k")) & (F.col("user_id") == F.col("u")), "left")
    return met.select("request_id", F.col("k").alias("conv_id"), F.coalesce("old", F.left(F.trim("message"), F.lit(120))).alias("title"), F.col("k").isNull().alias("is_new"))


def droppable(statuses: DataFrame, columns: DataFrame, transitions: DataFrame) -> DataFrame:
    """Which board columns (col, status) a card of a status may go to: its own, or one with a status it can reach."""
    own = statuses.join(columns, "status").select(F.col("status").alias("from_status"), "col")
    reach = transitions.join(columns.withColumnRenamed("status", "to_status"), "to_status").select("from_status", "col")
    return own.unionByName(reach).distinct()


def settled(results: DataFrame, group: str) -> DataFrame:
    """Of each bulk action: how many worked, and which did not."""
    return results.groupBy(group).agg(F.count_if("ok").alias("succeeded"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("item_id")))).alias("failed"))


def unshortened(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Links of known shorteners with where they lead (url, target); those that failed stay as they are.

    One row per link, whatever ``targets`` repeats: of several targets of one short link the smallest counts.
    """
    known = U.host_of(F.col("url")).isin(*U.SHORTENERS)
    once = targets.where(known).groupBy(F.col("url").alias("_short")).agg(F.min("target").alias("_target"))
    met = links.join(once, F.when(known, F.col("url")) == F.col("_short"), "left")
    return met.select(*links.columns, F.coalesce("_target", "url").alias("resolved"))


def posts_in_order(posts: DataFrame) -> DataFrame:
    """Posts of a thread once each, by their number: ids too long for a float are decimals."""
    return posts.dropDuplicates(["post_id"]).orderBy(F.col("post_id").cast("decimal(38,0)"))


def index_in_sync(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Postings that only one of the two has, as often as it has more of them; none if the index is in sync.

    Parts of the terms are compared by their number of rows and sums of two 64-bit hashes
    of them (in halves, so that no sum overflows); only parts that differ are compared row by row.
    """
    columns = stored.columns
    part = F.pmod(F.xxhash64("term"), F.lit(SYNC_PARTS))
    said = [*columns, *[F.isnull(c) for c in columns]]  # a hash passes over nulls
    halves = [f(h) for h in (F.xxhash64(*said), F.xxhash64(F.lit("again"), *said)) for f in (lambda h: F.shiftrightunsigned(h, 32), lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    signed = lambda df, sign: df.select(*columns, F.lit(sign).alias("sign"))
    both = signed(stored, 1).unionByName(signed(fresh, -1))
    sums = {f"s{k}": F.sum(h * F.col("sign")) for k, h in enumerate(halves)} | {"n": F.sum("sign")}
    differ = both.groupBy(part.alias("part")).agg(*[x.alias(k) for k, x in sums.items()]).where(reduce(Column.__or__, [F.col(k) != 0 for k in sums]))
    rows = both.withColumn("part", part).join(F.broadcast(written(differ.select("part"), "sync-parts")), "part", "left_semi")
    left = rows.groupBy(*columns).agg(F.sum("sign").alias("n")).where("n <> 0")
    return left.select(*columns, F.when(F.col("n") > 0, "stored").otherwise("fresh").alias("side"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("n"))).alias("_n")).drop("_n")


def shown_results(ready: bool, hybrid: DataFrame, keyword: DataFrame) -> DataFrame:
    """Hybrid rows once they are there, keyword rows until then."""
    return hybrid if ready else keyword


def claimed(jobs: DataFrame, now: int, most: int = 1) -> DataFrame:
    """The oldest due jobs (by run_at, then id) as they are once claimed: active, one attempt more.

    Null and later times are not due. A single writer, such as ``foreachBatch``, makes the claim atomic.
    """
    due = jobs.where((F.col("status") == "queued") & (F.col("run_at") <= now)).orderBy("run_at", "job_id").limit(most)
    return due.withColumns({"status": F.lit("active"), "attempts": F.col("attempts") + 1})


def backfill_tick(imports: DataFrame, now: int, daily: int, external: int | Column, resets_at: int, per_tick: int = 20) -> DataFrame:
    """What one tick does to each import: ``outcome``, ``enqueued``, ``resumes_at`` and the state that follows.

    ``imports`` has import_id, state, n_candidates, next_index, released_on (a UTC
    date or null) and released_for_day. A running import releases the least of what
    it has left, what its own daily cap leaves, what the shared budget leaves and
    ``per_tick``; the checks come in this order.
    """
    today, external = F.to_date(F.timestamp_millis(F.lit(now))), F.lit(external) if isinstance(external, int) else external
    used = F.when(F.col("released_on") == today, F.col("released_for_day")).otherwise(0)
    left, own = F.col("n_candidates") - F.col("next_index"), F.greatest(F.lit(0), F.lit(daily) - used)
    running = F.col("state") == "running"
    stop = F.when(~running, "not_running").when(left <= 0, "completed").when(own <= 0, "daily_cap_reached").when(F.least(external, F.lit(per_tick)) <= 0, "waiting_for_budget")
    n = F.when(stop.isNotNull(), 0).otherwise(F.least(left, own, external, F.lit(per_tick))).cast("bigint")
    out = imports.select("*", stop.alias("_stop"), n.alias("enqueued"), used.alias("_used"), (running & (n >= left)).alias("_done"))
    outcome = F.coalesce("_stop", F.when(F.col("_done"), "completed").otherwise("progressed"))
    resumes = F.when(F.col("_stop") == "daily_cap_reached", (F.floor(F.lit(now) / 86_400_000) + 1) * 86_400_000).when(F.col("_stop") == "waiting_for_budget", F.lit(resets_at))
    moved = F.col("enqueued") > 0
    return out.select(
        "import_id", outcome.alias("outcome"), "enqueued", resumes.cast("bigint").alias("resumes_at"),
        F.when(F.col("_done"), "completed").otherwise(F.col("state")).alias("state"),
        (F.col("next_index") + F.col("enqueued")).alias("next_index"),
        F.when(moved, today).otherwise(F.col("released_on")).alias("released_on"),
        F.when(moved, F.col("_used") + F.col("enqueued")).otherwise(F.col("released_for_day")).alias("released_for_day"),
    )
