"""Library queries: filters, sort modes, pages, topics, tags, grouping, statistics, writes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Which status an item may go to from each.
TRANSITIONS = {
    "queued": (),
    "processing": (),
    "inbox": ("to_test", "testing", "tested", "archived", "dropped"),
    "to_test": ("inbox", "testing", "tested", "archived", "dropped"),
    "testing": ("inbox", "to_test", "tested", "archived", "dropped"),
    "tested": ("inbox", "to_test", "testing", "archived", "dropped"),
    "archived": ("inbox",),
    "dropped": ("inbox",),
    "failed": (),
}
RANK_STEP, RANK_GAP = 1024.0, 1e-7


def require_user_id(user_id: int) -> int:
    if isinstance(user_id, bool) or not isinstance(user_id, int) or user_id < 1:
        raise ValueError("a user id is a positive whole number")
    return user_id


def scoped(df: DataFrame, user_id: int, *extra: Column | None) -> DataFrame:
    """Rows of one user; further conditions that are None do not count. Apply below any ranking."""
    return df.where(reduce(and_, [x for x in extra if x is not None], F.col("user_id") == require_user_id(user_id)))


@dataclass(frozen=True)
class Filters:
    """AND between fields, OR inside one; an empty field does not filter."""

    kinds: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    tiers: tuple[str, ...] = ()
    created_from: int | None = None
    created_to: int | None = None
    tags: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()

    def active(self) -> int:
        """How many are set; the date range counts once."""
        return sum(map(len, (self.kinds, self.statuses, self.tiers, self.tags, self.topics))) + (self.created_from is not None or self.created_to is not None)


def filtered(items: DataFrame, by: Filters, item_tags: DataFrame | None = None, item_topics: DataFrame | None = None) -> DataFrame:
    """Plain conditions reach the scan; tags and topics (``item_id``, ``label`` / ``slug``) are semi joins."""
    for column, values in (("kind", by.kinds), ("status", by.statuses), ("extraction_tier", by.tiers)):
        if values:
            items = items.where(F.col(column).isin(*values))
    if by.created_from is not None:
        items = items.where(F.col("created_at") >= by.created_from)
    if by.created_to is not None:
        items = items.where(F.col("created_at") <= by.created_to)
    if by.tags:
        items = items.join(item_tags.where(F.col("label").isin(*by.tags)), "item_id", "left_semi")
    if by.topics:
        items = items.join(item_topics.where(F.col("slug").isin(*by.topics)), "item_id", "left_semi")
    return items


def primary_topics(item_topics: DataFrame, topics: DataFrame, ties: str = "desc") -> DataFrame:
    """Each item's topic of highest confidence; ties go to the largest (lists) or smallest (search) topic id."""
    tie = F.desc("topic_id") if ties == "desc" else F.asc("topic_id")
    first = item_topics.withColumn("rn", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("confidence"), tie))).where("rn = 1").drop("rn")
    return first.join(topics.select("topic_id", "slug", "label"), "topic_id")


SORTS = {
    "newest": (F.col, "created_at", False),
    "oldest": (F.col, "created_at", True),
    "recently_opened": (lambda c: F.coalesce(F.col(c), F.lit(-1)), "last_opened_at", False),
    "most_related": (F.col, "n_related", False),
}


def list_page(items: DataFrame, sort: str = "newest", limit: int = 20, cursor: tuple[int, int] | None = None) -> DataFrame:
    """One row more than ``limit`` in a sort mode, strictly behind a cursor (value, id); the id breaks ties the same way."""
    make, column, rising = SORTS[sort]
    key = make(column)
    if cursor is not None:
        v, i = cursor
        after = (key > v) | ((key == v) & (F.col("item_id") > i)) if rising else (key < v) | ((key == v) & (F.col("item_id") < i))
        items = items.where(after)
    order = (key.asc(), F.asc("item_id")) if rising else (key.desc(), F.desc("item_id"))
    return items.withColumn("sort_value", key).orderBy(*order).limit(limit + 1)


def built_page(items: DataFrame, sort: str = "newest", limit: int = 20, cursor: tuple[int, int] | None = None) -> DataFrame:
    """The page itself: ``has_more`` on every row and, if there is more, ``next_value`` and ``next_id`` of its last row.

    The windows are over one row more than the page, never over the table.
    """
    rows = list_page(items, sort, limit, cursor)
    rising = SORTS[sort][2]
    order = W.orderBy(*((F.asc(c) if rising else F.desc(c)) for c in ("sort_value", "item_id")))
    every = W.partitionBy(F.lit(0))
    page = rows.withColumn("position", F.row_number().over(order)).withColumn("has_more", F.count("*").over(every) > limit)
    last = page.where(F.col("position") <= limit)
    for name, column in (("next_value", "sort_value"), ("next_id", "item_id")):
        last = last.withColumn(name, F.when(F.col("has_more"), F.max_by(column, "position").over(every)))
    return last.orderBy("position")


def related_counts(edges: DataFrame) -> DataFrame:
    """Edges that touch each item: item_id, n_related. Both ends by an explode, so the join stays an equi-join."""
    return edges.select(F.explode(F.array("item_a", "item_b")).alias("item_id")).groupBy("item_id").agg(F.count("*").alias("n_related"))


def counts_by(items: DataFrame, column: str) -> DataFrame:
    return items.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def grouped_in_order(items: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Non-empty groups of a fixed list in its order: value, pos, n. Values off the list are no group."""
    return zero_filled(counts_by(items, column), values).where("n > 0").select("value", F.col("pos").cast("bigint").alias("pos"), "n")


def free_slugs(wanted: DataFrame, taken: DataFrame, attempts: int | None = 5) -> DataFrame:
    """A slug of its own for each new name of a user: id, user_id, slug, free.

    ``wanted``: id, user_id, slug; ``taken``: user_id, slug, the ones that are there. The
    first of a user's slug, by id, gets it if it is free, the others ``slug-2``, ``slug-3``
    and so on, without those that are there or wanted by themselves; ``free`` is null
    where ``attempts`` numbers (None: any) do not suffice. Each slug is numbered by
    itself, so nothing but the names that clash meets in one task.
    """
    base = F.regexp_extract("slug", r"^(.*?)(?:-(\d{1,9}))?$", 1)
    number = F.regexp_extract("slug", r"^(.*?)(?:-(\d{1,9}))?$", 2)
    w = W.partitionBy("user_id", "slug").orderBy("id")
    nth = wanted.select("id", "user_id", "slug", F.row_number().over(w).alias("nth"))
    own = taken.select("user_id", F.col("slug").alias("base"), F.lit(1).alias("k"))
    suffixed = taken.select("user_id", "slug").unionByName(wanted.select("user_id", "slug")).where(number.rlike("^[1-9]")).select("user_id", base.alias("base"), number.cast("int").alias("k")).where("k > 1")
    used = own.unionByName(suffixed).groupBy("user_id", "base").agg(F.array_sort(F.collect_set("k")).alias("used")).withColumnRenamed("user_id", "of_user")
    met = nth.join(used, F.col("user_id").eqNullSafe(F.col("of_user")) & (F.col("slug") == F.col("base")), "left")
    # the nth free number: step over each used one that is not beyond it
    k = F.aggregate(F.coalesce("used", F.array().cast("array<int>")), F.col("nth"), lambda at, u: F.when(u <= at, at + 1).otherwise(at))
    free = F.when(k == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", k.cast("string")))
    return met.select("id", "user_id", "slug", (free if attempts is None else F.when(k <= attempts, free)).alias("free"))


def tags_added(item_tags: DataFrame, chosen: DataFrame, labels: list[str]) -> DataFrame:
    """The tags of the chosen items (item_id) with the labels added, each once: item_id, label."""
    more = chosen.select("item_id", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    return item_tags.join(chosen.select("item_id"), "item_id", "left_semi").select("item_id", "label").unionByName(more).distinct()


def zero_filled(counts: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Every value of a fixed list, at 0 where it has no rows."""
    dim = counts.sparkSession.createDataFrame([(v, k) for k, v in enumerate(values)], "value string, pos int")
    return dim.join(counts, "value", "left").select("value", "pos", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def date_bucket(created: Column, now: int) -> tuple[Column, Column]:
    """Key and rank of the day bucket of an epoch time, seen from ``now``; the future is today."""
    day = lambda ms: F.to_date(F.timestamp_millis(ms))
    today, own = day(F.lit(now)), day(created)
    diff = F.date_diff(today, own)
    months = (F.year(today) - F.year(own)) * 12 + F.month(today) - F.month(own)
    key = F.when(diff <= 0, "today").when(diff == 1, "yesterday").when(diff <= 6, "this-week").when(months == 0, "this-month").otherwise(F.date_format(own, "yyyy-MM"))
    rank = F.when(diff <= 0, 0).when(diff == 1, 1).when(diff <= 6, 2).otherwise(3 + months)
    return key, rank.cast("bigint")


def transitions(spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in TRANSITIONS.items() for b in to], "from_status string, to_status string")


def apply_transitions(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted change (item_id, to_status): from, to, whether it is allowed, the status after it."""
    allowed = F.broadcast(transitions(items.sparkSession)).withColumn("ok", F.lit(True))  # a fixed table of 22 rows
    met = items.select("item_id", F.col("status").alias("from_status")).join(wanted, "item_id").join(allowed, ["from_status", "to_status"], "left")
    ok = F.coalesce("ok", F.lit(False))
    return met.select("item_id", "from_status", "to_status", ok.alias("allowed"), F.when(ok, F.col("to_status")).otherwise(F.col("from_status")).alias("status"))


def common_transitions(selected: DataFrame) -> DataFrame:
    """The statuses that every selected item may go to."""
    n = selected.agg(F.count_distinct("status").alias("n"))
    reach = selected.select(F.col("status").alias("from_status")).distinct().join(F.broadcast(transitions(selected.sparkSession)), "from_status")  # a fixed table
    return reach.groupBy("to_status").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).where("c = n").select("to_status")


def column_sorted(items: DataFrame) -> DataFrame:
    """Board order in each column: ranked first by rank, then unranked, newest first."""
    order = W.partitionBy("status").orderBy(F.asc_nulls_last("board_rank"), F.desc("created_at"), F.desc("item_id"))
    return items.withColumn("pos", F.row_number().over(order).cast("bigint"))


def rebalanced(items: DataFrame) -> DataFrame:
    """New ranks of ranked items, a step apart, and the midpoint to the next; ``needs`` where the gap was too small."""
    w = W.partitionBy("status").orderBy("board_rank", "item_id")
    after = F.lead("board_rank").over(w)
    mid = F.when(after.isNull(), F.col("board_rank") + RANK_STEP).otherwise((F.col("board_rank") + after) / 2)
    own = items.where(F.col("board_rank").isNotNull())
    return own.select("item_id", "status", (F.row_number().over(w) * RANK_STEP).alias("new_rank"), mid.alias("midpoint"), F.coalesce(after - F.col("board_rank") < RANK_GAP, F.lit(False)).alias("needs"))


# Writes, as whole-table rewrites that a batch job makes.


def upserted(base: DataFrame, patch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union in which the latest row of each key by ``order`` wins; on ties the patch."""
    both = base.withColumn("_new", F.lit(0)).unionByName(patch.withColumn("_new", F.lit(1)))
    w = W.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def inserted_if_absent(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Base and those rows whose key it lacks; of rows with one key, one."""
    return base.unionByName(rows.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti"))


def patched(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Columns of the patch where it has a value; others stay."""
    columns = [c for c in patch.columns if c != key]
    joined = base.join(patch.select(key, *[F.col(c).alias(f"_{c}") for c in columns]), key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def deleted(base: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return base.join(keys, on, "left_anti")


def set_changes(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """Labels to add to and remove from each item: item_id, added, removed (sorted arrays)."""
    have = current.groupBy("item_id").agg(F.collect_set("label").alias("have"))
    want = wanted.groupBy("item_id").agg(F.collect_set("label").alias("want"))
    none = F.array().cast("array<string>")
    both = have.join(want, "item_id", "full")
    have, want = F.coalesce("have", none), F.coalesce("want", none)
    return both.select("item_id", F.array_sort(F.array_except(want, have)).alias("added"), F.array_sort(F.array_except(have, want)).alias("removed"))


def found_or_created(existing: DataFrame, names: DataFrame, key: str, id_col: str) -> DataFrame:
    """Ids of names: those that exist, and new ones counted on from the largest."""
    known = names.select(key).distinct().join(existing.select(key, id_col), key, "left")
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    fresh = known.where(F.col(id_col).isNull()).select(key).withColumn("n", F.row_number().over(W.orderBy(key))).crossJoin(F.broadcast(top))
    return known.where(F.col(id_col).isNotNull()).unionByName(fresh.select(key, (F.col("top") + F.col("n")).cast("bigint").alias(id_col)))


def without_manual_topic(item_topics: DataFrame, item_id: int) -> DataFrame:
    """Clearing a manual topic takes away every assignment of confidence exactly 1."""
    return item_topics.where(~((F.col("item_id") == item_id) & (F.col("confidence") == 1)))


def quality_report(items: DataFrame, edges: DataFrame) -> DataFrame:
    """How many rows break each constraint of the data model."""
    checks = [
        items.select(F.lit("item_id is unique").alias("check"), (F.count("*") - F.count_distinct("item_id")).alias("broken")),
        items.select(F.lit("status is known").alias("check"), F.count_if(~F.col("status").isin(*TRANSITIONS)).alias("broken")),
        edges.select(F.lit("item_a below item_b").alias("check"), F.count_if(~(F.col("item_a") < F.col("item_b"))).alias("broken")),
        edges.select(F.lit("score in 0 to 1").alias("check"), F.count_if(~F.col("score").between(0, 1)).alias("broken")),
    ]
    return reduce(DataFrame.unionByName, checks)
