"""Registered queries over the library: filters, pages, topics, tags, statistics, relations, writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.operators import library as L
from lexilake.operators import relations as R
from lexilake.plans.search_queries import vector_index
from lexilake.sources import tables as D
from lexilake.sources.tables import with_views

#: Parameters of the registered queries; the edge threshold suits the 64-dimensional test vectors.
USER, NOW, EDGE = 2, D.EPOCH + 40 * 86_400_000, 1.3
KEYSET = (D.EPOCH + 300 * D.HOUR, 300)


def _named_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.item_topics(spark, sf_dir).join(D.topics(spark).select("topic_id", "slug", "label"), "topic_id")


def items_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = L.Filters(kinds=("article", "video", "pdf"), statuses=("queued", "to_test", "processing", "archived"), tiers=("full", "partial"), created_from=D.EPOCH + 10 * D.HOUR, created_to=D.EPOCH + 800 * D.HOUR)
    return L.filtered(L.scoped(D.items(spark, sf_dir), USER), by).select("item_id", "kind", "status", "extraction_tier", "created_at")


def items_tag_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = L.Filters(tags=("de", "src3"))
    return L.filtered(L.scoped(D.items(spark, sf_dir), USER), by, item_tags=D.item_tags(spark, sf_dir)).select("item_id", "lang", "source")


def items_any_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = L.Filters(topics=("databases", "history"))
    return L.filtered(L.scoped(D.items(spark, sf_dir), USER), by, item_topics=_named_topics(spark, sf_dir)).select("item_id", "kind")


def items_primary_topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = L.primary_topics(D.item_topics(spark, sf_dir), D.topics(spark))
    return L.filtered(L.scoped(D.items(spark, sf_dir), USER), L.Filters(topics=("databases", "history")), item_topics=first).select("item_id", "kind")


def items_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hydrated list rows: item, primary topic, tags by label, wire id."""
    first = L.primary_topics(D.item_topics(spark, sf_dir), D.topics(spark)).select("item_id", F.col("slug").alias("topic"))
    tags = D.item_tags(spark, sf_dir).groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("tags"))
    out = L.scoped(D.items(spark, sf_dir), USER).join(first, "item_id", "left").join(tags, "item_id", "left")
    return out.select(F.concat(F.lit("itm_"), "item_id").alias("id"), "title", "kind", "status", "extraction_tier", "topic", "tags")


def _page(spark: SparkSession, sf_dir: str, sort: str, cursor=None) -> DataFrame:
    return L.list_page(L.scoped(D.items(spark, sf_dir), USER), sort, 20, cursor).select("item_id", F.col("sort_value").cast("bigint").alias("sort_value"))


def items_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "newest")


def items_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "oldest")


def items_recently_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "recently_opened")


def items_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "newest", KEYSET)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.edges(vector_index(spark, sf_dir), EDGE)


def items_most_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = D.items(spark, sf_dir).where(F.col("user_id") == USER).join(L.related_counts(_edges(spark, sf_dir)), "item_id", "left").withColumn("n_related", F.coalesce("n_related", F.lit(0)))
    return L.list_page(items, "most_related", 20).select("item_id", F.col("sort_value").cast("bigint").alias("sort_value"))


def primary_topic_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.primary_topics(D.item_topics(spark, sf_dir), D.topics(spark)).select("item_id", "topic_id", "slug", "confidence")


def primary_topic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.primary_topics(D.item_topics(spark, sf_dir), D.topics(spark), ties="asc").select("item_id", "topic_id", "slug", "confidence")


def tags_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.item_tags(spark, sf_dir).groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("tags"), F.count("*").alias("n"))


def items_fts_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = D.item_tags(spark, sf_dir).groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("label")), " ").alias("tags"))
    return D.items(spark, sf_dir).join(tags, "item_id", "left").select("item_id", "title", "tags", F.length("content").cast("bigint").alias("content_chars"))


def stats_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.counts_by(D.items(spark, sf_dir), "kind")


def stats_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.counts_by(D.items(spark, sf_dir), "status")


def stats_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.counts_by(D.items(spark, sf_dir), "extraction_tier")


def stats_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.counts_by(L.primary_topics(D.item_topics(spark, sf_dir), D.topics(spark)), "label")


def library_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, df: df.groupBy().agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    out = one("items", D.items(spark, sf_dir)).unionByName(one("item_tags", D.item_tags(spark, sf_dir)))
    return out.unionByName(one("item_topics", D.item_topics(spark, sf_dir))).unionByName(one("chunks", D.chunk_vectors(spark, sf_dir)))


def kind_counts_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.zero_filled(L.counts_by(D.items(spark, sf_dir), "kind"), D.KINDS).select("value", "n")


def group_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.grouped_in_order(D.items(spark, sf_dir), "kind", D.KINDS)


def group_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.grouped_in_order(D.items(spark, sf_dir), "status", D.STATUSES)


def slugs_freed(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = D.items(spark, sf_dir).select(F.col("item_id").alias("id"), "user_id", F.concat(F.lit("t"), F.floor(F.col("item_id") / 30).cast("string")).alias("slug"))
    taken = wanted.where("id % 12 = 0").select("user_id", "slug").unionByName(wanted.where("id % 9 = 0").select("user_id", F.concat("slug", F.lit("-3")).alias("slug")))
    return L.free_slugs(wanted, taken)


def bulk_tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tags_added(D.item_tags(spark, sf_dir), D.items(spark, sf_dir).where("status = 'inbox'"), ["to read", "new"])


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = D.items(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("item_id")).limit(100).select("item_id")
    first = L.primary_topics(D.item_topics(spark, sf_dir), D.topics(spark)).join(page, "item_id", "left_semi")
    topics = first.groupBy(F.col("slug").alias("value")).agg(F.min("label").alias("label")).withColumn("facet", F.lit("topic"))
    tags = D.item_tags(spark, sf_dir).join(page, "item_id", "left_semi").select(F.col("label").alias("value")).distinct().withColumn("label", F.col("value")).withColumn("facet", F.lit("tag"))
    return topics.unionByName(tags).select("facet", "value", "label")


def group_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = L.primary_topics(D.item_topics(spark, sf_dir), D.topics(spark)).select("item_id", "slug", "label")
    own = L.scoped(D.items(spark, sf_dir), USER).join(first, "item_id", "left")
    return own.groupBy(F.coalesce("label", F.lit("No topic")).alias("label"), F.col("slug").isNull().alias("last")).agg(F.count("*").alias("n")).orderBy("last", F.desc("n"), "label")


def group_by_date_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, rank = L.date_bucket(F.col("created_at"), NOW)
    return D.items(spark, sf_dir).groupBy(key.alias("bucket"), rank.alias("rank")).agg(F.count("*").alias("n")).orderBy("rank")


def board_column_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.column_sorted(L.scoped(D.items(spark, sf_dir), USER)).select("item_id", "status", "pos")


def board_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rebalanced(L.scoped(D.items(spark, sf_dir), USER))


def relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).withColumn("score", F.round("score", 6))


def relations_of_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.relations_of(_edges(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


def pending_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _edges(spark, sf_dir).where("(item_a + item_b) % 3 = 0")
    return R.pending_pairs(vector_index(spark, sf_dir).of_user(USER), known).withColumn("distance", F.round("distance", 6))


def labeled_pairs_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _edges(spark, sf_dir)
    labelled = own.selectExpr("if(item_a % 4 = 0, item_b, item_a) as item_a", "if(item_a % 4 = 0, item_a, item_b) as item_b", "type", "round(2 * (1 - score), 9) as distance")
    out = R.stored_labels(labelled, own.where("item_b % 5 = 0"))
    return out.withColumn("score", F.round("score", 6))


def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = D.items(spark, sf_dir)
    wanted = items.selectExpr("item_id", f"element_at(array({', '.join(repr(s) for s in D.STATUSES)}), cast(item_id * 5 % 9 as int) + 1) as to_status")
    return L.apply_transitions(items, wanted)


def common_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.common_transitions(D.items(spark, sf_dir).where("status in ('inbox', 'to_test', 'tested')"))


def tag_set_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = D.item_tags(spark, sf_dir)
    want = D.items(spark, sf_dir).selectExpr("item_id", "explode(array(lang, concat('k-', kind))) as label")
    return L.set_changes(have, want).select("item_id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


def patch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = D.items(spark, sf_dir).select("item_id", "title", "status")
    patch = base.where("item_id % 3 = 0").selectExpr("item_id", "case when item_id % 2 = 0 then 'renamed' end as title", "'archived' as status")
    return L.patched(base, patch, "item_id")


def topics_found_or_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = D.items(spark, sf_dir).selectExpr("concat('t-', source) as slug").unionByName(D.topics(spark).select("slug"))
    return L.found_or_created(D.topics(spark).where("user_id = 1"), names, "slug", "topic_id")


def chat_cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = D.chat_messages(spark, sf_dir).selectExpr("conv_id", "turn", "role", "length(text) as chars")
    return L.upserted(said.where("turn % 2 = 0"), said.where("turn % 2 = 1"), ["conv_id", "role"], "turn").selectExpr("conv_id", "role", "turn", "cast(chars as bigint) as chars")


def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.quality_report(D.items(spark, sf_dir), _edges(spark, sf_dir))


def star_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = D.raw(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return orders.where("o_totalprice < 200000 or (o_totalprice = 200000 and o_orderkey < 1000)").orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(21)


def star_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = D.raw(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    li = D.raw(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority", "l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    )


def star_nation_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (D.raw(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    orders = D.raw(spark, sf_dir, "orders").where("o_totalprice > 350000").select("o_custkey")
    idle = c.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return idle.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("idle"), F.round(F.avg("c_acctbal"), 4).alias("balance"))


QUERIES = {f.__name__: f for f in (group_by_kind, group_by_status, slugs_freed, bulk_tag_union, items_filtered, items_tag_exists, items_any_topic, items_primary_topic_filter, items_summary, items_newest, items_oldest, items_recently_opened, items_keyset_page, items_most_related, primary_topic_list, primary_topic_search, tags_by_item, items_fts_source, stats_by_kind, stats_by_status, stats_by_tier, stats_topics, library_counts, kind_counts_zero_fill, facets, group_by_topic, group_by_date_bucket, board_column_sort, board_ranks, relation_edges, relations_of_item, pending_pairs, labeled_pairs_store, status_transitions, common_transitions, tag_set_changes, patch_items, topics_found_or_created, chat_cache_latest, data_quality, star_keyset, star_group_stats, star_nation_customers)}

_I = with_views("items", sql="")
_IT = with_views("items", "topics", "item_topics", "item_tags", sql="")[:-1]
_PT = ", pt AS (SELECT item_id, topic_id, slug, label, confidence FROM (SELECT * FROM item_topics QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY confidence DESC, topic_id {0}) = 1) JOIN topics USING (topic_id))\n"
_D2 = "sqrt(list_sum(list_transform(list_zip(embedding, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
_MEAN = f"""{with_views("items", "topics", "item_topics", "item_tags", "chunk_vectors", sql="")[:-1]},
u AS (SELECT item_id, user_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM chunk_vectors),
mp AS (SELECT item_id, user_id, pos, avg(x) AS x FROM u GROUP BY ALL),
mv AS (SELECT item_id, user_id, list(x ORDER BY pos) AS m FROM mp GROUP BY ALL),
near AS (SELECT mv.item_id AS a, c.item_id AS b, c.chunk_id, mv.user_id, {_D2} AS d FROM mv JOIN chunk_vectors c ON mv.user_id = c.user_id AND mv.item_id <> c.item_id)"""
_EDGES = f"""{_MEAN},
nb AS (SELECT a, b, min(d) AS d FROM (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, chunk_id) <= 20) GROUP BY a, b QUALIFY row_number() OVER (PARTITION BY a ORDER BY min(d), b) <= 5),
edges AS (SELECT least(a, b) AS item_a, greatest(a, b) AS item_b, 'similar' AS type, greatest(0.0, least(1.0, 1 - arg_min(d, a) / 2)) AS score FROM nb WHERE d <= {EDGE} GROUP BY 1, 2)"""
_DAY = "CAST(epoch_ms(created_at) AS DATE)"
_TODAY = f"CAST(epoch_ms(CAST({NOW} AS BIGINT)) AS DATE)"
_TR = "tr(f, t) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, to in L.TRANSITIONS.items() for b in to) + ")"

ORACLE = {
    "items_filtered": f"{_I} SELECT item_id, kind, status, extraction_tier, created_at FROM items WHERE user_id = {USER} AND kind IN ('article', 'video', 'pdf') AND status IN ('queued', 'to_test', 'processing', 'archived') AND extraction_tier IN ('full', 'partial') AND created_at BETWEEN {D.EPOCH + 10 * D.HOUR} AND {D.EPOCH + 800 * D.HOUR}",
    "items_tag_exists": f"{_IT} SELECT item_id, lang, source FROM items i WHERE user_id = {USER} AND EXISTS (SELECT 1 FROM item_tags t WHERE t.item_id = i.item_id AND label IN ('de', 'src3'))",
    "items_any_topic": f"{_IT} SELECT item_id, kind FROM items i WHERE user_id = {USER} AND EXISTS (SELECT 1 FROM item_topics t JOIN topics USING (topic_id) WHERE t.item_id = i.item_id AND slug IN ('databases', 'history'))",
    "items_primary_topic_filter": f"{_IT}{_PT.format('DESC')} SELECT item_id, kind FROM items WHERE user_id = {USER} AND item_id IN (SELECT item_id FROM pt WHERE slug IN ('databases', 'history'))",
    "items_summary": f"{_IT}{_PT.format('DESC')} SELECT 'itm_' || i.item_id AS id, title, kind, status, extraction_tier, slug AS topic, (SELECT string_agg(t.label, ',' ORDER BY t.label) FROM item_tags t WHERE t.item_id = i.item_id) AS tags FROM items i LEFT JOIN pt USING (item_id) WHERE user_id = {USER}",
    "items_newest": f"{_I} SELECT item_id, created_at AS sort_value FROM items WHERE user_id = {USER} ORDER BY 2 DESC, 1 DESC LIMIT 21",
    "items_oldest": f"{_I} SELECT item_id, created_at AS sort_value FROM items WHERE user_id = {USER} ORDER BY 2, 1 LIMIT 21",
    "items_recently_opened": f"{_I} SELECT item_id, coalesce(last_opened_at, -1) AS sort_value FROM items WHERE user_id = {USER} ORDER BY 2 DESC, 1 DESC LIMIT 21",
    "items_keyset_page": f"{_I} SELECT item_id, created_at AS sort_value FROM items WHERE user_id = {USER} AND (created_at < {KEYSET[0]} OR (created_at = {KEYSET[0]} AND item_id < {KEYSET[1]})) ORDER BY 2 DESC, 1 DESC LIMIT 21",
    "items_most_related": f"{_EDGES} SELECT item_id, (SELECT count(*) FROM edges WHERE item_a = item_id OR item_b = item_id) AS sort_value FROM items WHERE user_id = {USER} ORDER BY 2 DESC, 1 DESC LIMIT 21",
    "primary_topic_list": f"{_IT}{_PT.format('DESC')} SELECT item_id, topic_id, slug, confidence FROM pt",
    "primary_topic_search": f"{_IT}{_PT.format('ASC')} SELECT item_id, topic_id, slug, confidence FROM pt",
    "group_by_kind": f"{_I}, k AS (SELECT unnest({list(D.KINDS)}) AS value, unnest(range({len(D.KINDS)})) AS pos) SELECT value, pos, count(*) AS n FROM items JOIN k ON kind = value GROUP BY 1, 2",
    "group_by_status": f"{_I}, k AS (SELECT unnest({list(D.STATUSES)}) AS value, unnest(range({len(D.STATUSES)})) AS pos) SELECT value, pos, count(*) AS n FROM items JOIN k ON status = value GROUP BY 1, 2",
    "slugs_freed": """WITH w AS (SELECT doc_id AS id, doc_id % 5 + 1 AS user_id, 't' || doc_id // 30 AS slug FROM documents),
taken AS (SELECT user_id, slug FROM w WHERE id % 12 = 0 UNION SELECT user_id, slug || '-3' FROM w WHERE id % 9 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, slug ORDER BY id) AS nth FROM w),
c AS (SELECT user_id, slug, k, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS made FROM (SELECT DISTINCT user_id, slug FROM w), range(1, 6) r(k)),
f AS (SELECT user_id, slug, made, row_number() OVER (PARTITION BY user_id, slug ORDER BY k) AS nth FROM c WHERE (user_id, made) NOT IN (SELECT user_id, slug FROM taken))
SELECT id, n.user_id AS user_id, n.slug AS slug, made AS free FROM n LEFT JOIN f ON n.user_id = f.user_id AND n.slug = f.slug AND n.nth = f.nth""",
    "bulk_tag_union": f"{_IT}, chosen AS (SELECT doc_id AS item_id FROM documents WHERE doc_id % {len(D.STATUSES)} = {D.STATUSES.index('inbox')}) SELECT item_id, label FROM item_tags WHERE item_id IN (SELECT item_id FROM chosen) UNION SELECT item_id, unnest(['to read', 'new']) FROM chosen",
    "tags_by_item": f"{_IT} SELECT item_id, string_agg(label, ',' ORDER BY label) AS tags, count(*) AS n FROM item_tags GROUP BY item_id",
    "items_fts_source": f"{_IT} SELECT item_id, title, (SELECT string_agg(label, ' ' ORDER BY label) FROM item_tags t WHERE t.item_id = i.item_id) AS tags, length(content) AS content_chars FROM items i",
    "stats_by_kind": f"{_I} SELECT kind AS value, count(*) AS n FROM items GROUP BY 1",
    "stats_by_status": f"{_I} SELECT status AS value, count(*) AS n FROM items GROUP BY 1",
    "stats_by_tier": f"{_I} SELECT extraction_tier AS value, count(*) AS n FROM items GROUP BY 1",
    "stats_topics": f"{_IT}{_PT.format('DESC')} SELECT label AS value, count(*) AS n FROM pt GROUP BY 1",
    "library_counts": f"{_IT} SELECT 'items' AS name, count(*) AS n FROM items UNION ALL SELECT 'item_tags', count(*) FROM item_tags UNION ALL SELECT 'item_topics', count(*) FROM item_topics UNION ALL SELECT 'chunks', count(*) FROM embeddings",
    "kind_counts_zero_fill": f"{_I} SELECT k AS value, (SELECT count(*) FROM items WHERE kind = k) AS n FROM (SELECT unnest({list(D.KINDS)}) AS k)",
    "facets": f"{_IT}{_PT.format('DESC')}, pg AS (SELECT item_id FROM items ORDER BY created_at DESC, item_id DESC LIMIT 100) SELECT 'topic' AS facet, slug AS value, min(label) AS label FROM pt WHERE item_id IN (FROM pg) GROUP BY slug UNION ALL SELECT DISTINCT 'tag', label, label FROM item_tags WHERE item_id IN (FROM pg)",
    "group_by_topic": f"{_IT}{_PT.format('DESC')} SELECT coalesce(label, 'No topic') AS label, slug IS NULL AS last, count(*) AS n FROM items LEFT JOIN pt USING (item_id) WHERE user_id = {USER} GROUP BY 1, 2",
    "group_by_date_bucket": f"""{_I}, d AS (SELECT date_diff('day', {_DAY}, {_TODAY}) AS diff, date_diff('month', {_DAY}, {_TODAY}) AS m, {_DAY} AS own FROM items)
SELECT CASE WHEN diff <= 0 THEN 'today' WHEN diff = 1 THEN 'yesterday' WHEN diff <= 6 THEN 'this-week' WHEN m = 0 THEN 'this-month' ELSE strftime(own, '%Y-%m') END AS bucket,
  CASE WHEN diff <= 0 THEN 0 WHEN diff = 1 THEN 1 WHEN diff <= 6 THEN 2 ELSE 3 + m END AS rank, count(*) AS n FROM d GROUP BY 1, 2""",
    "board_column_sort": f"{_I} SELECT item_id, status, row_number() OVER (PARTITION BY status ORDER BY board_rank ASC NULLS LAST, created_at DESC, item_id DESC) AS pos FROM items WHERE user_id = {USER}",
    "board_ranks": f"{_I}, r AS (SELECT *, lead(board_rank) OVER w AS nx, row_number() OVER w AS rn FROM items WHERE user_id = {USER} AND board_rank IS NOT NULL WINDOW w AS (PARTITION BY status ORDER BY board_rank, item_id)) SELECT item_id, status, CAST(rn AS DOUBLE) * 1024.0 AS new_rank, CASE WHEN nx IS NULL THEN board_rank + 1024.0 ELSE (board_rank + nx) / 2 END AS midpoint, coalesce(nx - board_rank < 1e-7, false) AS needs FROM r",
    "relation_edges": f"{_EDGES} SELECT item_a, item_b, type, round(score, 6) AS score FROM edges",
    "relations_of_item": f"{_EDGES} SELECT CASE WHEN item_a = 10 THEN item_b ELSE item_a END AS item_id, type, round(score, 6) AS score FROM edges WHERE item_a = 10 OR item_b = 10",
    "pending_pairs": f"""{_EDGES}, nk AS (SELECT a, b, min(d) AS d, row_number() OVER (PARTITION BY a ORDER BY min(d), b) AS rn FROM near WHERE user_id = {USER} GROUP BY a, b QUALIFY rn <= 5),
pp AS (SELECT least(a, b) AS item_a, greatest(a, b) AS item_b, min((a, rn, d)) AS met FROM nk GROUP BY 1, 2)
SELECT item_a, item_b, round(met[3], 6) AS distance FROM pp WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.item_a = pp.item_a AND e.item_b = pp.item_b AND (e.item_a + e.item_b) % 3 = 0) ORDER BY met LIMIT 20""",
    "labeled_pairs_store": f"""{_EDGES}, lb AS (SELECT CASE WHEN item_a % 4 = 0 THEN item_b ELSE item_a END AS item_a, CASE WHEN item_a % 4 = 0 THEN item_a ELSE item_b END AS item_b, type, round(2 * (1 - score), 9) AS d FROM edges)
SELECT item_a, item_b, type, round(1 / (1 + greatest(0.0, d)), 6) AS score, item_a < item_b AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.item_a = lb.item_a AND e.item_b = lb.item_b AND e.item_b % 5 = 0) AS inserted FROM lb""",
    "status_transitions": f"{_I}, {_TR}, w AS (SELECT item_id, status AS from_status, ({list(D.STATUSES)})[item_id * 5 % 9 + 1] AS to_status FROM items), k AS (SELECT *, EXISTS (SELECT 1 FROM tr WHERE f = from_status AND t = to_status) AS allowed FROM w) SELECT *, CASE WHEN allowed THEN to_status ELSE from_status END AS status FROM k",
    "common_transitions": f"WITH {_TR} SELECT t AS to_status FROM tr WHERE f IN ('inbox', 'to_test', 'tested') GROUP BY t HAVING count(*) = 3",
    "tag_set_changes": f"{_IT}, h AS (SELECT DISTINCT item_id, label FROM item_tags), w AS (SELECT item_id, lang AS label FROM items UNION SELECT item_id, 'k-' || kind FROM items) SELECT item_id, coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT label FROM w WHERE w.item_id = i.item_id AND label NOT IN (SELECT label FROM h WHERE h.item_id = i.item_id))), '') AS added, coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT label FROM h WHERE h.item_id = i.item_id AND label NOT IN (SELECT label FROM w WHERE w.item_id = i.item_id))), '') AS removed FROM items i",
    "patch_items": f"{_I} SELECT item_id, CASE WHEN item_id % 6 = 0 THEN 'renamed' ELSE title END AS title, CASE WHEN item_id % 3 = 0 THEN 'archived' ELSE status END AS status FROM items",
    "topics_found_or_created": f"{_IT}, ex AS (SELECT slug, topic_id FROM topics WHERE user_id = 1), nm AS (SELECT DISTINCT 't-' || source AS slug FROM items UNION SELECT slug FROM topics) SELECT slug, topic_id FROM nm JOIN ex USING (slug) UNION ALL SELECT slug, (SELECT max(topic_id) FROM ex) + row_number() OVER (ORDER BY slug) FROM nm WHERE slug NOT IN (SELECT slug FROM ex)",
    "chat_cache_latest": "SELECT conv_id, role, turn, length(text) AS chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1",
    "data_quality": "SELECT * FROM (VALUES ('item_id is unique', CAST(0 AS BIGINT)), ('status is known', 0), ('item_a below item_b', 0), ('score in 0 to 1', 0)) t(\"check\", broken)",
    "star_keyset": "SELECT o_orderkey, o_totalprice, o_custkey FROM orders WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey < 1000) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 21",
    "star_group_stats": "SELECT o_orderpriority, l_returnflag, count(*) AS n, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "star_nation_customers": "SELECT r_name, count(*) AS idle, round(avg(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000) GROUP BY 1",
}
