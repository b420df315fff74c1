"""Registered queries over request fields, payloads and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.functions import fields as P
from lexilake.operators import decisions as X
from lexilake.operators import ingest as G
from lexilake.operators import keyword_index as K
from lexilake.operators import library as L
from lexilake.operators import rag as R
from lexilake.plans.search_queries import TEXT_TOKENS, index_path, tokenized_items
from lexilake.sources import tables as D
from lexilake.sources.tables import with_views
from lexilake.streaming import imports as I

BOARD = (("inbox", "inbox"), ("to_test", "to_test"), ("testing", "testing"), ("tested", "tested"), ("done", "archived"), ("done", "dropped"))


def enum_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit(" "), "kind", F.lit(", nope,,"), "kind", F.lit(",pdf"))
    return D.items(spark, sf_dir).select("item_id", F.array_join(P.enum_list(said, D.KINDS), ",").alias("kinds"), P.enum_list(said, D.KINDS, strict=True).isNull().alias("refused"))


def epoch_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("item_id") % 4 == 0, "NaN").when(F.col("item_id") % 4 == 1, "x1").otherwise(F.concat(F.lit(" "), F.col("created_at").cast("string")))
    return D.items(spark, sf_dir).select("item_id", P.epoch(said).alias("epoch"))


def wire_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.items(spark, sf_dir).select("item_id", F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("itm_0"), "item_id")).otherwise(P.wire_id("itm", F.col("item_id"))).alias("wire"))
    return own.select("item_id", "wire", P.parsed_wire_id("itm", F.col("wire")).alias("parsed"))


def kind_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.events(spark, sf_dir).select("event_id", "props")
    merged = P.merged_json(F.col("props"), F.concat(F.lit('{"starCount":"'), F.col("event_id").cast("string"), F.lit('","extra":"x"}')))
    return own.select("event_id", P.kind_field(F.to_json(merged), "starCount", "bigint").alias("stars"), P.kind_field(F.to_json(merged), "k", "bigint").alias("k"))


#: Bytes that the fields of an item may have together.
CAPPED = 1000
#: An import's own releases a day, and those of all imports of a tick.
DAILY, SHARED = 25, 150


def byte_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.items(spark, sf_dir).select("item_id", P.byte_cut(F.col("content"), 1000).alias("cut"))
    return own.select("item_id", F.octet_length("cut").cast("bigint").alias("bytes"), F.sha2("cut", 256).alias("digest"))


def byte_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fields of each item within 1000 bytes together."""
    fields = {"html": F.col("content"), "transcript": F.left(F.reverse("content"), F.lit(700)), "caption": F.when(F.col("item_id") % 3 > 0, F.col("title"))}
    own = D.items(spark, sf_dir).select("item_id", P.byte_capped(fields, CAPPED).alias("x"))
    return own.select("item_id", *[F.sha2(f"x.{n}", 256).alias(n) for n in fields], "x.truncated")


def enrichment_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("item_id")
    listed = lambda k, size: F.array_join(F.transform(F.sequence(F.lit(1), (n % k + 1).cast("int")), lambda i: F.concat(F.lit('"'), F.repeat(F.lit("a"), size.cast("int")), F.lit('"'))), ",")
    more = F.when(n % 2 == 0, F.concat(F.lit(',"kindFields":{"what_it_does":"'), F.repeat(F.lit("w"), (n % 5 * 100).cast("int")), F.lit('","primary_use_case":"u"}'))).otherwise("")
    said = F.concat(F.lit('{"tldr":"t","bullets":['), listed(6, n % 7 * 80), F.lit('],"tags":['), listed(10, n % 11 * 5), F.lit('],"topic":"'), F.repeat(F.lit("x"), (n % 13 * 8).cast("int")), F.lit('","confidence":'), (n % 12 / 10).cast("string"), more, F.lit("}"))
    return D.items(spark, sf_dir).select("item_id", P.enrichment_ok(said, F.col("kind")).alias("ok"))


def validate_then_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.events(spark, sf_dir).select((F.col("event_id") / 3).cast("bigint").alias("call_id"), (F.col("event_id") % 3).alias("attempt"), (F.col("event_id") * 31 % 4 == 0).alias("ok"))
    return X.repaired(own)


def longest_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.raw(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("model"), F.col("s_nationkey").alias("chain"))
    models = D.raw(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("model"), (F.col("s_suppkey") * 100).alias("context"))
    return X.longest_context(own, models).select("chain", F.col("context").cast("bigint").alias("context"))


def model_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("tools"))).when(F.col("item_id") % 3 == 1, F.array(F.lit("tools"), F.lit("structured_outputs"))).otherwise(F.array().cast("array<string>"))
    return D.items(spark, sf_dir).select("item_id", R.strategy(caps).alias("strategy"), R.routed(F.length("content"), 500, F.lit(3000)).alias("model"))


def retry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = D.items(spark, sf_dir)
    asked = items.where("status = 'failed'").selectExpr("item_id", "element_at(array('resolve', 'extract', 'enrich', 'nothing'), cast(item_id % 4 as int) + 1) as stage")
    jobs = items.where("item_id % 5 = 0").selectExpr("item_id", "case when item_id % 10 = 0 then 'queued' else 'done' end as state")
    return X.retries(asked, jobs)


def retryable_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = ("unsupported_url", "not_found", "rate_limited", "blocked", "invalid_pdf", "network_error")
    code = F.element_at(F.array(*[F.lit(c) for c in codes]), (F.col("event_id") % 6 + 1).cast("int"))
    return D.events(spark, sf_dir).select(code.alias("code")).groupBy("code").agg(F.max(X.may_retry(F.col("code"))).alias("retry"), F.count("*").alias("n"))


def conversation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = D.chat_messages(spark, sf_dir).where("turn = 0")
    known = said.where("conv_id % 2 = 0").select("conv_id", (F.col("conv_id") % 5).alias("user_id"), F.concat(F.lit("t"), "conv_id").alias("title"))
    asked = said.select(F.col("conv_id").alias("request_id"), (F.col("conv_id") % 3).alias("user_id"), "conv_id", F.col("text").alias("message"))
    return X.conversations_resolved(asked, known).select("request_id", "conv_id", F.length("title").cast("bigint").alias("title_chars"), "is_new")


def board_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = spark.createDataFrame(BOARD, "col string, status string")
    return X.droppable(D.items(spark, sf_dir).select("status").distinct(), columns, L.transitions(spark))


def bulk_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.items(spark, sf_dir).select("user_id", "item_id", (F.col("item_id") % 7 > 0).alias("ok"))
    return X.settled(own, "user_id").select("user_id", "succeeded", F.size("failed").cast("bigint").alias("failed"), F.element_at("failed", 1).alias("first_failed"))


def shortened_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.raw(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://bit.ly/"), "page_id")).otherwise(F.col("url")).alias("url"))
    targets = own.where("page_id % 2 = 0").select("url", F.concat(F.lit("https://to.org/"), "page_id").alias("target"))
    return X.unshortened(own, targets).select("page_id", "resolved")


def thread_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.events(spark, sf_dir).select(F.concat(F.floor(F.col("event_id") / 2).cast("string"), F.lit("00000000000000000000")).alias("post_id"))
    return X.posts_in_order(own)


def index_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index, less the rows of one term, against one worked out afresh."""
    stored, _ = K.read(spark, index_path(spark, sf_dir))
    fresh = K.postings(tokenized_items(spark, sf_dir))
    return X.index_in_sync(stored.select(*fresh.columns).where("term <> 'the'"), fresh).groupBy("side", "term").agg(F.count("*").alias("n"))


def import_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick over the imports of each source and language: as many candidates as documents, states and cursors by their number."""
    docs = D.raw(spark, sf_dir, "documents")
    imports = docs.groupBy("lang", "source").agg(F.min("doc_id").alias("import_id"), F.count("*").alias("n_candidates"))
    k = F.col("import_id") % 7
    imports = imports.select(
        "import_id", F.when(k == 0, "paused").otherwise("running").alias("state"), "n_candidates", F.when(k == 1, F.col("n_candidates")).otherwise(F.floor(F.col("n_candidates") / 3)).cast("bigint").alias("next_index"),
        F.when(k > 2, F.lit("2024-01-01").cast("date")).alias("released_on"), (k * 4).cast("bigint").alias("released_for_day"),
    )
    return I.shared_tick(imports, D.EPOCH + 5, DAILY, SHARED, D.EPOCH + 86_400_000).drop("released_on")


def budgeted_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as far as the day's requests go, 16 to a request."""
    items = D.items(spark, sf_dir).select("item_id", F.col("content").alias("text"))
    made, refused = X.embedded_within(items, X.HashEmbedder(), ("item_id",), X.requests_left(30, 5, 4, "background"), 16)
    return made.select("item_id", "batch", "embedding_model").unionByName(refused.select("item_id", "batch", F.lit(None).cast("string").alias("embedding_model")))


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = G.chunked(D.items(spark, sf_dir))
    out = X.embedded(chunks, X.HashEmbedder())
    return out.groupBy("embedding_model").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("width"))


QUERIES = {f.__name__: f for f in (enum_filters, epoch_filters, wire_ids, kind_fields, byte_cuts, byte_caps, import_tick, budgeted_embedding, enrichment_validity, validate_then_repair, longest_contexts, model_routing, retry_outcomes, retryable_errors, conversation_resolution, board_drops, bulk_settled, shortened_links, thread_posts, index_sync, embedded_chunks)}

_I = with_views("items", sql="")[:-1]
_TR = "tr(f, t) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, to in L.TRANSITIONS.items() for b in to) + ")"

#: The longest head of so many bytes, character by character.
_HEAD = "array_to_string(list_transform(list_filter(list_zip(string_split(left({0}, {1}), ''), range(1, 1 + len(string_split(left({0}, {1}), '')))), lambda z: strlen(left({0}, z[2])) <= {1}), lambda z: z[1]), '')"
_ROOM = f"greatest(0, CAST(floor({CAPPED} * (CAST(strlen({{0}}) AS DOUBLE) / total)) AS INTEGER) - {len(P.CUT_MARKER.encode())})"
_SHARE = "CASE WHEN {0} IS NULL THEN NULL WHEN total <= " + str(CAPPED) + " THEN {0} ELSE (SELECT CASE WHEN length(k) < length({0}) THEN k || '" + P.CUT_MARKER.replace("\n", "' || chr(10) || '") + "' ELSE k END FROM (SELECT " + _HEAD.replace("{1}", _ROOM) + " AS k)) END"

ORACLE = {
    "enum_filters": f"{_I} SELECT item_id, CASE WHEN kind = 'pdf' THEN 'pdf' ELSE kind || ',pdf' END AS kinds, true AS refused FROM items",
    "epoch_filters": f"{_I} SELECT item_id, CASE WHEN item_id % 4 > 1 THEN created_at END AS epoch FROM items",
    "wire_ids": f"{_I} SELECT item_id, 'itm_' || CASE WHEN item_id % 3 = 0 THEN '0' ELSE '' END || item_id AS wire, CASE WHEN item_id % 3 > 0 THEN item_id END AS parsed FROM items",
    "kind_fields": "SELECT event_id, event_id AS stars, CAST(props ->> '$.k' AS BIGINT) AS k FROM events",
    "byte_cuts": f"{_I}, c AS (SELECT item_id, {_HEAD.format('content', '1000')} AS cut FROM items) SELECT item_id, CAST(strlen(cut) AS BIGINT) AS bytes, sha256(cut) AS digest FROM c",
    "byte_caps": f"""{_I}, f AS (SELECT item_id, content AS html, left(reverse(content), 700) AS transcript, CASE WHEN item_id % 3 > 0 THEN title END AS caption FROM items),
t AS (SELECT *, coalesce(strlen(html), 0) + coalesce(strlen(transcript), 0) + coalesce(strlen(caption), 0) AS total FROM f)
SELECT item_id, {", ".join(f"sha256({_SHARE.format(n)}) AS {n}" for n in ("html", "transcript", "caption"))}, total > {CAPPED} AS truncated FROM t""",
    "import_tick": f"""WITH g AS (SELECT min(doc_id) AS import_id, count(*) AS n FROM documents GROUP BY lang, source),
i AS (SELECT import_id, n, import_id % 7 AS k, CASE WHEN import_id % 7 = 1 THEN n ELSE n // 3 END AS idx, CASE WHEN import_id % 7 > 2 THEN import_id % 7 * 4 ELSE 0 END AS used FROM g),
w AS (SELECT *, n - idx AS open, greatest(0, {DAILY} - used) AS own, CASE WHEN k = 0 THEN 0 ELSE greatest(0, least(n - idx, {DAILY} - used, 20, {SHARED})) END AS wanted FROM i),
s AS (SELECT *, greatest(0, {SHARED} - coalesce(sum(wanted) OVER (ORDER BY import_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rest FROM w),
o AS (SELECT *, CASE WHEN k = 0 THEN 'not_running' WHEN open <= 0 THEN 'completed' WHEN own <= 0 THEN 'daily_cap_reached' WHEN rest <= 0 THEN 'waiting_for_budget' END AS stop, least(wanted, rest) AS enq FROM s)
SELECT import_id, coalesce(stop, CASE WHEN enq >= open THEN 'completed' ELSE 'progressed' END) AS outcome, CAST(CASE WHEN stop IS NULL THEN enq ELSE 0 END AS BIGINT) AS enqueued,
  CASE WHEN stop IN ('daily_cap_reached', 'waiting_for_budget') THEN {D.EPOCH + 86_400_000} END AS resumes_at, CASE WHEN k = 0 THEN 'paused' WHEN open <= 0 OR (stop IS NULL AND enq >= open) THEN 'completed' ELSE 'running' END AS state,
  CAST(idx + CASE WHEN stop IS NULL THEN enq ELSE 0 END AS BIGINT) AS next_index, CAST(CASE WHEN stop IS NULL AND enq > 0 THEN used + enq ELSE k * 4 END AS BIGINT) AS released_for_day FROM o""",
    "budgeted_embedding": f"{_I}, b AS (SELECT item_id, CAST((row_number() OVER (ORDER BY item_id) - 1) // 16 AS BIGINT) AS batch FROM items) SELECT item_id, batch, CASE WHEN batch < 21 THEN 'hash' END AS embedding_model FROM b",
    "enrichment_validity": f"{_I} SELECT item_id, item_id % 6 + 1 BETWEEN 3 AND 5 AND item_id % 7 * 80 BETWEEN 1 AND 400 AND item_id % 10 + 1 BETWEEN 3 AND 8 AND item_id % 11 * 5 BETWEEN 1 AND 40 AND item_id % 13 * 8 BETWEEN 1 AND 80 AND item_id % 12 <= 10 AND (kind <> 'github' OR item_id % 2 = 0 AND item_id % 5 * 100 BETWEEN 1 AND 300) AS ok FROM items",
    "validate_then_repair": "WITH a AS (SELECT event_id // 3 AS call_id, event_id % 3 AS attempt, event_id * 31 % 4 = 0 AS ok FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY attempt) AS rn FROM a QUALIFY rn <= 2) SELECT call_id, CASE min(rn) FILTER (ok) WHEN 1 THEN 'valid' WHEN 2 THEN 'repaired' ELSE 'failed' END AS outcome FROM b GROUP BY 1",
    "longest_contexts": "SELECT s_nationkey AS chain, CAST(max(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 100 ELSE 8192 END) AS BIGINT) AS context FROM supplier GROUP BY 1",
    "model_routing": f"{_I} SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'tool_call' WHEN 1 THEN 'response_format' ELSE 'prompt_repair' END AS strategy, CASE WHEN length(content) + 500 <= 3000 THEN 'primary' ELSE 'fallback' END AS model FROM items",
    "retry_outcomes": f"{_I} SELECT item_id, (['resolve', 'extract', 'enrich', 'nothing'])[item_id % 4 + 1] AS stage, CASE item_id % 4 WHEN 0 THEN 'not allowed' WHEN 3 THEN 'unknown stage' ELSE CASE WHEN item_id % 10 = 0 THEN 'conflict' ELSE 'started' END END AS outcome FROM items WHERE status = 'failed'",
    "retryable_errors": "WITH codes(k, code, retry) AS (VALUES (0, 'unsupported_url', false), (1, 'not_found', false), (2, 'rate_limited', true), (3, 'blocked', true), (4, 'invalid_pdf', false), (5, 'network_error', true)) SELECT code, any_value(retry) AS retry, count(*) AS n FROM events JOIN codes ON event_id % 6 = k GROUP BY 1",
    "conversation_resolution": "SELECT conv_id AS request_id, CASE WHEN conv_id % 2 = 0 AND conv_id % 3 = conv_id % 5 THEN conv_id END AS conv_id, CASE WHEN conv_id % 2 = 0 AND conv_id % 3 = conv_id % 5 THEN length('t' || conv_id) ELSE least(120, length(trim(text))) END AS title_chars, NOT (conv_id % 2 = 0 AND conv_id % 3 = conv_id % 5) AS is_new FROM conversations WHERE turn = 0",
    "board_drops": f"{_I}, {_TR}, bc(col, status) AS (VALUES {', '.join(map(str, BOARD))}) SELECT DISTINCT status AS from_status, col FROM items JOIN bc USING (status) UNION SELECT f, col FROM tr JOIN bc ON t = status",
    "bulk_settled": f"{_I} SELECT user_id, count(*) FILTER (item_id % 7 > 0) AS succeeded, count(*) FILTER (item_id % 7 = 0) AS failed, min(item_id) FILTER (item_id % 7 = 0) AS first_failed FROM items GROUP BY 1",
    "shortened_links": "SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'https://to.org/' || page_id WHEN page_id % 3 = 0 THEN 'https://bit.ly/' || page_id ELSE url END AS resolved FROM pages",
    "index_sync": f"{_I} SELECT 'fresh' AS side, 'the' AS term, count(*) AS n FROM items WHERE list_contains({TEXT_TOKENS}, 'the') HAVING count(*) > 0",
    "thread_posts": "SELECT DISTINCT (event_id // 2) || '00000000000000000000' AS post_id FROM events ORDER BY CAST(post_id AS DECIMAL(38, 0))",
}
