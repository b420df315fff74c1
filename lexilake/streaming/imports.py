"""Imports that release their links little by little: a stored cursor for each, moved by ticks.

Under one path, in generations (``sources.generations``): ``progress`` has each import as
it is after the batch, ``queue`` the links that the batch released. A batch that is run
again reads the generation before it and writes the same one over, so a rerun moves
nothing; a restart between two ticks loses nothing.

An import is previewed, running, paused, completed or failed; only actions lead from
one to the other, but for the tick that releases the last link.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.operators.decisions import backfill_tick
from lexilake.sources import generations as G
from lexilake.streaming import scans as Y

PROGRESS = "import_id bigint, state string, n_candidates bigint, next_index bigint, released_on date, released_for_day bigint, error string"
COLUMNS = [c.split()[0] for c in PROGRESS.split(", ")]
#: The states that an action may find, and where it leads.
ACTIONS = {"commit": (("previewed",), "running"), "pause": (("running",), "paused"), "resume": (("paused",), "running"), "cancel": (("previewed", "running", "paused"), "failed")}
CANCELLED = "cancelled by user"


def acted(imports: DataFrame, actions: DataFrame) -> DataFrame:
    """Each action (import_id, action) with ``outcome`` (the new state, ``conflict``, or ``not found``); of several on one import in a batch the first by name counts."""
    one = actions.groupBy("import_id").agg(F.min("action").alias("action"))
    met = one.join(imports.select("import_id", "state"), "import_id", "left")
    outcome = F.when(F.col("state").isNull(), "not found")
    for name, (states, to) in ACTIONS.items():
        outcome = outcome.when((F.col("action") == name) & F.col("state").isin(*states), to)
    return met.select("import_id", "action", outcome.otherwise("conflict").alias("outcome"))


def after_actions(imports: DataFrame, actions: DataFrame) -> DataFrame:
    moved = acted(imports, actions).where(~F.col("outcome").isin("conflict", "not found")).select("import_id", F.col("outcome").alias("_to"), "action")
    met = imports.join(moved, "import_id", "left")
    return met.withColumns({"state": F.coalesce("_to", "state"), "error": F.when(F.col("action") == "cancel", CANCELLED).otherwise(F.col("error"))}).select(*COLUMNS)


def shared_tick(imports: DataFrame, now: int, daily: int, external: int, resets_at: int, per_tick: int = 20, block: int | None = None) -> DataFrame:
    """One tick over all imports, as ``operators.decisions.backfill_tick``, but the external budget is one for them all.

    Imports take from it in the order of their ids. What an import may have is the
    budget less the sum of what those before it would take, a running sum over
    blocks; so the tick never releases more than the budget, whatever their number.
    """
    alone = backfill_tick(imports, now, daily, external, resets_at, per_tick).select("import_id", F.col("enqueued").alias("wanted"))
    rows = Y.blocked(imports.join(alone, "import_id").withColumn("_all", F.lit(0)), "_all", ("import_id",), block)
    summed = Y.with_sums(rows, "_all", {"_sum": F.col("wanted")}, ("import_id",))
    left = F.greatest(F.lit(0), external - (F.col("_sum") - F.col("wanted")))
    return backfill_tick(summed.withColumn("_left", left), now, daily, F.col("_left"), resets_at, per_tick)


def start(imports: DataFrame, path: str) -> None:
    """Store new imports (import_id, n_candidates), previewed, as generation 0 of an empty path."""
    new = imports.selectExpr("import_id", "'previewed' as state", "n_candidates", "0L as next_index", "cast(null as date) as released_on", "0L as released_for_day", "cast(null as string) as error")
    G.write(new, path, "progress", 0)
    G.write(new.select("import_id", F.lit(0).cast("bigint").alias("idx"), F.lit("").alias("url")).limit(0), path, "queue", 0)
    G.write(new.agg(F.count("*").alias("n")), path, "stats", 0)


def progress(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{path}/progress").where(F.col("gen") == G.last(spark, path, before)).select(*COLUMNS)


def released(spark: SparkSession, path: str) -> DataFrame:
    """The links released so far: import_id, idx, url."""
    return spark.read.parquet(f"{path}/queue").where(F.col("gen") <= G.last(spark, path)).drop("gen")


def ticking(path: str, candidates: DataFrame, daily: int, per_tick: int = 20) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over a stream of (ms, import_id, action, external, resets_at): actions, and ticks (rows without an action).

    A batch's actions come first, then one tick with the time and budget of its
    latest row. ``candidates`` are the links of the imports: import_id, idx (from 0), url.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark, gen = batch.sparkSession, number + 1
        now = after_actions(progress(spark, path, gen), batch.where("action is not null"))
        tick = batch.where("action is null").orderBy(F.desc("ms")).limit(1).collect()  # one row
        if tick:
            ms, external, resets_at = (tick[0][c] for c in ("ms", "external", "resets_at"))
            moved = shared_tick(now, ms, daily, external, resets_at, per_tick)
            after = now.select("import_id", "n_candidates", "error", F.col("next_index").alias("_from")).join(moved, "import_id")
            G.write(after.select(*COLUMNS), path, "progress", gen)
            links = after.where("enqueued > 0").select("import_id", "_from", "next_index").join(candidates, "import_id").where("idx >= _from and idx < next_index")
            G.write(links.select("import_id", "idx", "url"), path, "queue", gen)
        else:
            G.write(now, path, "progress", gen)
            G.write(candidates.select("import_id", "idx", "url").limit(0), path, "queue", gen)
        G.write(now.agg(F.count("*").alias("n")), path, "stats", gen)

    return each
