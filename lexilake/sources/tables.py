"""The library's relations, as views over the raw tables.

Every view is a narrow projection of one raw table, so filters and column pruning
reach the Parquet scan through it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The item kinds, research statuses, extraction tiers and capture surfaces, in their order.
KINDS = ("article", "video", "github", "social", "pdf", "audio", "other")
STATUSES = ("queued", "processing", "inbox", "to_test", "testing", "tested", "archived", "dropped", "failed")
TIERS = ("full", "partial", "metadata_only")
SURFACES = ("extension", "share", "import", "manual")
TOPIC_SLUGS = ("databases", "machine-learning", "distributed-systems", "web-design", "history", "music-theory")
EPOCH = 1704067200000
HOUR = 3600000


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], n: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast({n} % {len(values)} as int) + 1)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "documents").selectExpr(
        "doc_id as item_id", "doc_id % 5 + 1 as user_id", "text as content", "left(split_part(text, '\\n', 1), 80) as title",
        f"{_pick(KINDS, 'doc_id')} as kind", f"{_pick(STATUSES, 'doc_id')} as status", f"{_pick(TIERS, 'doc_id')} as extraction_tier",
        f"{_pick(SURFACES, 'doc_id')} as source_surface", f"{EPOCH} + doc_id * {HOUR} as created_at",
        f"case when doc_id % 4 = 0 then {EPOCH} + (doc_id * 7919 % 100000) * 60000 end as last_opened_at",
        "case when doc_id % 3 = 0 then cast(doc_id * 31 % 1000 as double) end as board_rank", "lang", "source",
    )


def topics(spark: SparkSession) -> DataFrame:
    """Six topics of each of the five users: a dimension of fixed size."""
    slugs = F.array(*[F.lit(s) for s in TOPIC_SLUGS])
    return spark.range(1, 6).select(F.col("id").alias("user_id"), F.posexplode(slugs).alias("k", "slug")).select(
        (F.col("user_id") * 10 + F.col("k")).alias("topic_id"), "user_id", "slug", F.initcap(F.translate("slug", "-", " ")).alias("label")
    )


def item_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two topics of most items, with confidences."""
    docs = raw(spark, sf_dir, "documents").select("doc_id").where("doc_id % 11 <> 0")
    one = docs.selectExpr("doc_id as item_id", "(doc_id % 5 + 1) * 10 + doc_id % 6 as topic_id", "(doc_id * 37 % 100) / 100.0D as confidence")
    two = docs.where("doc_id % 2 = 0 and doc_id div 7 % 6 <> doc_id % 6").selectExpr(
        "doc_id as item_id", "(doc_id % 5 + 1) * 10 + doc_id div 7 % 6 as topic_id", "(doc_id * 53 % 100) / 100.0D as confidence"
    )
    return one.unionByName(two)


def item_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tags of each item: its language and its source."""
    return raw(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), (F.col("doc_id") % 5 + 1).alias("user_id"), F.explode(F.array("lang", "source")).alias("label"))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "embeddings").selectExpr("vec_id as chunk_id", "vec_id div 4 as item_id", "vec_id div 4 % 5 + 1 as user_id", "embedding")


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", "text")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in epoch milliseconds and as a timestamp that watermarks accept."""
    return raw(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "benchmark").selectExpr("item_id as query_id", "text as query")


#: The same views for the oracle.
def _sql_pick(values: tuple[str, ...]) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[doc_id % {len(values)} + 1]"


SQL_VIEWS = {
    "items": f"""SELECT doc_id AS item_id, doc_id % 5 + 1 AS user_id, text AS content, left(split_part(text, chr(10), 1), 80) AS title,
  {_sql_pick(KINDS)} AS kind, {_sql_pick(STATUSES)} AS status, {_sql_pick(TIERS)} AS extraction_tier, {_sql_pick(SURFACES)} AS source_surface,
  {EPOCH} + doc_id * {HOUR} AS created_at, CASE WHEN doc_id % 4 = 0 THEN {EPOCH} + (doc_id * 7919 % 100000) * 60000 END AS last_opened_at,
  CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id * 31 % 1000 AS DOUBLE) END AS board_rank, lang, source FROM documents""",
    "topics": "SELECT user_id * 10 + k AS topic_id, user_id, slug, label FROM (SELECT unnest(range(1, 6)) AS user_id), (VALUES "
    + ", ".join(f"({k}, '{s}', '{s.replace('-', ' ').title()}')" for k, s in enumerate(TOPIC_SLUGS))
    + ") t(k, slug, label)",
    "item_topics": """SELECT doc_id AS item_id, (doc_id % 5 + 1) * 10 + doc_id % 6 AS topic_id, CAST(doc_id * 37 % 100 AS DOUBLE) / 100.0 AS confidence FROM documents WHERE doc_id % 11 <> 0
  UNION ALL SELECT doc_id, (doc_id % 5 + 1) * 10 + doc_id // 7 % 6, CAST(doc_id * 53 % 100 AS DOUBLE) / 100.0 FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 2 = 0 AND doc_id // 7 % 6 <> doc_id % 6""",
    "item_tags": "SELECT doc_id AS item_id, doc_id % 5 + 1 AS user_id, lang AS label FROM documents UNION ALL SELECT doc_id, doc_id % 5 + 1, source FROM documents",
    "chunk_vectors": "SELECT vec_id AS chunk_id, vec_id // 4 AS item_id, vec_id // 4 % 5 + 1 AS user_id, embedding::DOUBLE[] AS embedding FROM embeddings",
    "chat_messages": "SELECT conv_id, turn, role, text FROM conversations",
    "event_log": "SELECT *, epoch_us(ts) // 1000 AS ms FROM events",
}


def with_views(*names: str, sql: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names) + "\n" + sql
