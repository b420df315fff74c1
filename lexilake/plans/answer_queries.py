"""Registered queries over context assembly, scores, queues, limits and streams."""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.functions import text as T
from lexilake.functions import times as TM
from lexilake.operators import evals as E
from lexilake.operators import library as L
from lexilake.operators import rag as R
from lexilake.operators import search as S
from lexilake.operators import vector_index as I
from lexilake.plans.search_queries import vector_index
from lexilake.sources import tables as D
from lexilake.sources.stored import fresh_path
from lexilake.sources.tables import with_views
from lexilake.streaming import folds as X
from lexilake.streaming import scans as Y
from lexilake.streaming import sources as Z
from lexilake.streaming import stages as P

#: Limits of the registered queries, which the test events reach; the defaults are in the operators.
CAP, RESERVE, PER_WINDOW, WINDOW_MS, GAP = 250, 50, 2, 86_400_000, 3_600_000
BUDGET, CEILING = 1500, 1.25


#: Documents that answers cite, and the share of a sentence's words that its source must have.
CITED, OVERLAP = 200, 0.1
#: Texts too short to extract, in characters, and how long a claim holds.
SHORT, LEASE = 400, 3_600_000


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = D.items(spark, sf_dir).select("user_id", "item_id", "title", "kind", T.estimated_tokens(F.col("content")).alias("tokens"))
    ranked = items.withColumn("rank", F.pmod(F.col("item_id") * 7919, F.lit(10007)))
    return ranked.withColumn("query_id", F.col("user_id") * 100 + F.col("item_id") % 37)


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.within_budget(_candidates(spark, sf_dir), BUDGET)
    return out.select("query_id", "item_id", F.col("used").cast("bigint").alias("used"), "included", "clipped", F.col("source").cast("bigint").alias("source"))


def rag_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best items of each user by distance with their first chunks."""
    q = D.raw(spark, sf_dir, "embeddings").where("vec_id = 1").head()["embedding"]
    near, _ = I.nearest_items(vector_index(spark, sf_dir), q, 3, R.ITEMS)
    chunks = R.leading_chunks(D.chunk_vectors(spark, sf_dir).select("item_id", F.col("chunk_id").alias("ord")), 2)
    return chunks.join(near.select("item_id", F.round("distance", 6).alias("distance")), "item_id").select("item_id", F.col("ord").alias("chunk_id"), "distance")


def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = R.within_budget(_candidates(spark, sf_dir), BUDGET).where("included").join(D.items(spark, sf_dir).select("item_id", "content"), "item_id")
    block = R.context_block(F.col("source"), F.col("title"), F.col("kind"), F.col("content"))
    return own.select("query_id", "item_id", F.sha2(block, 256).alias("block"))


def groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.raw(spark, sf_dir, "embeddings").select("vec_id", "label")
    return own.select("vec_id", S.groundedness(F.col("label"), F.col("vec_id") % 3 - 1, F.when(F.col("vec_id") % 5 > 0, 1.0 + F.col("label") / 10.0), CEILING).alias("grounded"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = D.chat_messages(spark, sf_dir).where("role = 'assistant'")
    return said.select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), F.concat("text", F.lit(" ["), (F.col("turn") % 4).cast("string"), F.lit("][2]")).alias("text"), "conv_id", "turn")


def citations_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _answers(spark, sf_dir)
    cited = T.citations(F.col("text"))
    return own.select("answer_id", F.array_join(F.transform(cited, lambda n: n.cast("string")), ",").alias("cited"), T.citations_valid(F.col("text"), F.col("conv_id") % 4).alias("valid"))


def refusal_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = F.array(*[F.lit(x) for x in ("I don't have anything saved.", "There is nothing in your library", "Nothing relevant found", "I couldn’t find anything", "It doesn't cover that", "a plain answer", "No matching items about it")])
    own = D.chat_messages(spark, sf_dir).select("conv_id", "turn", F.element_at(phrases, (F.col("conv_id") % 7 + 1).cast("int")).alias("said"))
    return own.select("conv_id", "turn", T.is_refusal(F.col("said")).alias("refusal"))


def answer_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("conv_id") * 7 + F.col("turn")
    bit = lambda k: F.floor(n / k) % 2 == 1
    return D.chat_messages(spark, sf_dir).select("conv_id", "turn", R.answer_decision(bit(1), bit(2), bit(4), bit(8)).alias("decision"))


def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_turns(D.chat_messages(spark, sf_dir), 3).select("conv_id", "turn", "pos", "role")


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.chat_messages(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", T.cache_key(F.lit(1), F.col("text"), F.lit("all")).alias("key"))
    return own.select("conv_id", "turn", F.length("key").cast("bigint").alias("n"), "key")


def eval_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = D.raw(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), (F.col("quality") == 1).alias("relevant"), (F.col("doc_id") % 10).alias("query_id"))
    from pyspark.sql import Window as W

    order = W.partitionBy("query_id").orderBy(F.pmod(F.col("item_id") * 7919, F.lit(10007)), "item_id")  # the key repeats after 100 070 ids
    ranked = labels.withColumn("rn", F.row_number().over(order)).where("rn <= 20")
    p = E.context_precision(ranked)
    r = E.recall(ranked, labels.where("relevant").select("query_id", "item_id"))
    return p.join(r, "query_id").select("query_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def eval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = D.queries(spark, sf_dir)
    docs = D.items(spark, sf_dir).select("item_id", "content")
    many = pages.select((F.max("query_id") + 1).alias("many"))  # one row
    met = docs.crossJoin(F.broadcast(many)).join(pages, F.col("item_id") % F.col("many") == F.col("query_id"))
    return met.select("item_id", "query_id", F.round(E.overlap(F.col("query"), F.col("content")), 6).alias("overlap"))


def eval_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers against the documents that they cite; every fifth question has no answer in them and should be declined."""
    own = _answers(spark, sf_dir).select("answer_id", "text", "conv_id", "turn")
    numbered = own.select("answer_id", F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)])).alias("n"))
    asked = numbered.withColumn("doc_id", (F.col("answer_id") * 7 + F.col("n")) % CITED)
    sources = asked.join(D.raw(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")), "doc_id").select("answer_id", "n", "body")
    out = own.join(E.grounded_share(own, sources, OVERLAP), "answer_id", "left")
    marked, valid = F.size(T.citations(F.col("text"))) > 0, T.citations_valid(F.col("text"), F.lit(3))
    score = E.faithfulness(marked, valid, F.col("grounded"), E.mention_coverage(F.col("text"), F.array(F.lit("the"), F.lit("de"))))
    declined = E.declined_score(F.col("turn") % 3 > 0, T.is_refusal(F.col("text")), marked, valid)
    return out.select("answer_id", F.round(F.when(F.col("conv_id") % 5 == 0, declined).otherwise(score), 6).alias("score"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.events(spark, sf_dir).select("event_id", "user_id", "event_type", "ms", "value", "props")


def queue_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = _jobs(spark, sf_dir).where("event_type = 'signup'")
    now = D.EPOCH + 40 * 86_400_000
    return waiting.agg(F.count("*").alias("pending"), F.min("ms").alias("oldest")).select("pending", "oldest", F.coalesce(F.greatest(F.lit(0), now - F.col("oldest")), F.lit(0)).cast("bigint").alias("age_ms"))


def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _jobs(spark, sf_dir).select("event_id", (F.col("event_id") % 13).alias("attempts"))
    return own.select("event_id", TM.backoff(F.col("attempts")).alias("wait_ms"))


def eta_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    own = _jobs(spark, sf_dir).select("event_id", TM.eta_ms(n % 4000, n % 700, n % 9 * 100, TM.next_midnight(F.col("ms")), F.col("ms")).alias("eta_ms"))
    return own.select("event_id", "eta_ms", TM.duration(F.col("eta_ms")).alias("human"))


def daily_budget_single_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.single_lane_budget(_jobs(spark, sf_dir), CAP - RESERVE)
    return out.groupBy("day").agg(F.count("*").alias("asked"), F.count_if("admitted").alias("admitted"))


def daily_budget_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _jobs(spark, sf_dir).withColumn("day", F.floor(F.col("ms") / 86_400_000)).withColumn("lane", F.when(F.col("event_type") == "purchase", "interactive").otherwise("background"))
    return Y.budget_lanes(own, "day", CAP, RESERVE).select("event_id", "ok", "remaining")


def fixed_window_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Y.fixed_window(_jobs(spark, sf_dir), "user_id", PER_WINDOW, WINDOW_MS)
    return out.select("event_id", "user_id", "allowed", "retry_after_sec")


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Y.token_bucket(_jobs(spark, sf_dir), "user_id", 2, Fraction(1, 1440))
    return out.select("event_id", "user_id", "at", F.round("tokens", 6).alias("tokens"))


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    what = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "done").otherwise("claim")
    out = X.folded(_jobs(spark, sf_dir).withColumn("what", what), "user_id", ["ms", "what"], lambda s, ms, w: X.job_state(s, ms, w), "status string, attempts bigint, due bigint")
    return out.groupBy("status").agg(F.count("*").alias("n"), F.max("attempts").alias("attempts"))


def _extract(key: int, text: str, attempt: int) -> None:
    if len(text) < SHORT:
        raise P.PermanentError("too short")


def _enrich(key: int, text: str, attempt: int) -> None:
    if attempt <= len(text) % 7:
        raise ConnectionError("no answer")


def stage_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item through three stages: short texts fail for good, others fail as often as their length says."""
    asked = D.items(spark, sf_dir).select("item_id", F.col("created_at").alias("ms"), F.lit(None).cast("string").alias("stage"), F.coalesce("content", F.lit("")).alias("payload"))
    out = P.batch(asked, P.Stages([("extract", _extract), ("enrich", _enrich), ("index", lambda key, text, attempt: None)]))
    return out.select("item_id", "stage", "attempt", "ms", "outcome", "status", "reason")


def claim_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the requests for one thing, in their order, those that find it free: a claim holds it until its lease runs out."""
    held = Y.fixed_window(_jobs(spark, sf_dir), "event_type", 1, LEASE)
    return held.select("event_id", "event_type", F.col("allowed").alias("won"))


def domain_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.spaced(_jobs(spark, sf_dir), "user_id", GAP).select("event_id", "user_id", F.col("start").cast("bigint").alias("start"))


def backfill_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.items(spark, sf_dir).select("item_id", "user_id", F.col("created_at").alias("pos"))
    return X.released(own, 20).select("item_id", F.col("tick").cast("bigint").alias("tick"))


def failover_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _jobs(spark, sf_dir).select((F.col("event_id") / 4).cast("bigint").alias("call_id"), (F.col("event_id") % 4 + 1).alias("attempt"), (F.col("event_id") * 31 % 3 == 0).alias("ok"), F.concat(F.lit("r"), "event_id").alias("result"))
    return R.first_success(own)


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, counted by day into a table in memory; the result is what the sink has."""
    name = f"daily_{uuid.uuid4().hex}"
    counts = X.daily_counts(Z.event_stream(spark, sf_dir))
    counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", fresh_path(spark, "daily-counts-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("day_ms", "event_type", "n", F.round("value", 4).alias("value"))


def llm_calls_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).groupBy(F.col("event_type").alias("model"), (F.col("event_id") % 3).alias("prompt_version")).agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "model", "prompt_version")


def json_props_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return _jobs(spark, sf_dir).groupBy("event_type").agg(F.sum(k).alias("k"), F.count(k).alias("n"))


def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.items(spark, sf_dir).select("item_id", F.pow(F.lit(1.9), F.col("item_id") % 30).cast("bigint").alias("n"), "created_at")
    return own.select("item_id", TM.compact(F.col("n")).alias("n"), F.date_format(F.timestamp_millis("created_at"), "MMM d, yyyy").alias("day"))


def answer_relevancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the one with the next id."""
    own = D.raw(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    ahead = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("answer"))
    return own.join(ahead, "vec_id").select("vec_id", F.round(E.answer_relevancy(F.col("embedding"), F.col("answer")), 5).alias("relevancy"))


def day_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("event_id") % 5 == 0, F.lit("2024-02-30")).when(F.col("event_id") % 5 == 1, F.lit("24-1-1")).otherwise(F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd"))
    return _jobs(spark, sf_dir).select("event_id", TM.day_bound(said, False).alias("starts"), TM.day_bound(said, True).alias("ends"))


QUERIES = {f.__name__: f for f in (answer_relevancy, day_bounds, context_budget, rag_candidates, context_blocks, groundedness, citations_validate, refusal_flag, answer_decisions, history_last_n, cache_keys, eval_precision_recall, eval_overlap, eval_faithfulness, queue_health, backoff_schedule, eta_estimate, daily_budget_single_lane, daily_budget_lanes, fixed_window_limiter, token_bucket, job_states, stage_outcomes, claim_winners, domain_spacing, backfill_ticks, failover_results, stream_daily_counts, llm_calls_by_model, json_props_sum, number_formats)}

_I = with_views("items", sql="")[:-1]
_EV = "WITH event_log AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)"
DAY = 86_400_000
_REC = _EV.replace("WITH", "WITH RECURSIVE")
_NTH = "e AS (SELECT *, {0} AS k, row_number() OVER (PARTITION BY {0} ORDER BY ms, event_id) AS n FROM event_log)"
_CAND = f"""{_I}, cand AS (SELECT user_id * 100 + item_id % 37 AS query_id, item_id, title, kind, content, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens, item_id * 7919 % 10007 AS rank FROM items),
bud AS (SELECT *, CAST(sum(tokens) OVER w AS BIGINT) AS used, row_number() OVER w AS rn FROM cand WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
inc AS (SELECT *, rn = 1 AND used > {BUDGET} AS clipped, used <= {BUDGET} OR rn = 1 AS included FROM bud)"""
_L2 = "sqrt(list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
_ANS = "ans AS (SELECT conv_id * 100 + turn AS answer_id, text || ' [' || turn % 4 || '][2]' AS text, conv_id FROM conversations WHERE role = 'assistant')"
_TOK = f"list_distinct(regexp_extract_all(regexp_replace(translate(lower({{0}}), '{T.MARKED}', '{T.PLAIN}'), '[\\x{{{{300}}}}-\\x{{{{36F}}}}]+', '', 'g'), '[\\p{{{{L}}}}\\p{{{{N}}}}]+'))"

_REFUSED = "(" + " OR ".join(f"regexp_matches(text, '(?i){p}')".replace("'(?i)", "'(?i)") for p in (x.replace("'", "''") for x in T.REFUSALS)) + ")"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"
_UNIT = "CASE WHEN n >= {0} - {1} THEN regexp_replace(CAST(round(n / {0}::DECIMAL(38, 6), 1) AS DECIMAL(38, 1))::VARCHAR, '[.]0$', '') || '{2}'"

ORACLE = {
    "answer_relevancy": f"WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(greatest(0, least(1, {_DOT.format('x', 'y')} / (sqrt({_DOT.format('x', 'x')}) * sqrt({_DOT.format('y', 'y')})))), 5) AS relevancy FROM p",
    "day_bounds": f"{_EV} SELECT event_id, CASE WHEN event_id % 5 > 1 THEN ms // 86400000 * 86400000 END AS starts, CASE WHEN event_id % 5 > 1 THEN ms // 86400000 * 86400000 + 86399999 END AS ends FROM event_log",
    "number_formats": f"""{_I}, a AS (SELECT item_id, CAST(floor(power(1.9::DOUBLE, item_id % 30)) AS BIGINT) AS n, created_at FROM items)
SELECT item_id, {_UNIT.format(10**9, 50000, 'B')} ELSE {_UNIT.format(10**6, 50, 'M')} ELSE {_UNIT.format(1000, 0, 'K')} ELSE n::VARCHAR END END END AS n, strftime(make_timestamp(created_at * 1000), '%b %-d, %Y') AS day FROM a""",
    "context_budget": f"{_CAND} SELECT query_id, item_id, used, included, clipped, CASE WHEN included THEN rn END AS source FROM inc",
    "rag_candidates": f"WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1), c AS ({D.SQL_VIEWS['chunk_vectors']}), n AS (SELECT item_id, min({_L2}) AS d FROM c, q WHERE user_id = 3 GROUP BY item_id ORDER BY d, item_id LIMIT 6) SELECT item_id, chunk_id, round(d, 6) AS distance FROM c JOIN n USING (item_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY chunk_id) <= 2",
    "context_blocks": f"{_CAND} SELECT query_id, item_id, sha256('Source [' || rn || ']: \"' || title || '\" (' || kind || ')' || chr(10) || '<untrusted_content>' || chr(10) || content || chr(10) || '</untrusted_content>') AS block FROM inc WHERE included",
    "groundedness": f"SELECT vec_id, label > 0 AND (vec_id % 3 - 1 > 0 OR coalesce(CASE WHEN vec_id % 5 > 0 THEN 1.0 + label / 10.0 END <= {CEILING}, false)) AS grounded FROM embeddings",
    "citations_validate": f"WITH {_ANS}, c AS (SELECT *, CASE WHEN regexp_extract(text, '\\[(\\d)\\]\\[2\\]$', 1) = '2' THEN [2] ELSE [CAST(regexp_extract(text, '\\[(\\d)\\]\\[2\\]$', 1) AS INT), 2] END AS n FROM ans) SELECT answer_id, array_to_string(n, ',') AS cited, CASE WHEN conv_id % 4 = 0 THEN true ELSE len(list_filter(n, lambda x: x < 1 OR x > conv_id % 4)) = 0 END AS valid FROM c",
    "refusal_flag": "SELECT conv_id, turn, conv_id % 7 <> 5 AS refusal FROM conversations",
    "answer_decisions": "WITH n AS (SELECT *, conv_id * 7 + turn AS n FROM conversations) SELECT conv_id, turn, CASE WHEN n % 2 = 1 THEN 'grounded' WHEN n // 2 % 2 = 1 THEN 'ungrounded' WHEN n // 4 % 2 = 1 THEN 'grounded' WHEN n // 8 % 2 = 1 THEN 'ungrounded' ELSE 'failed' END AS decision FROM n",
    "history_last_n": "WITH l AS (SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role FROM l",
    "cache_keys": "SELECT conv_id, turn, CAST(64 AS BIGINT) AS n, sha256('1' || chr(1) || lower(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) || chr(1) || 'all') AS key FROM conversations WHERE role = 'user'",
    "eval_precision_recall": """WITH l AS (SELECT doc_id AS item_id, quality = 1 AS relevant, doc_id % 10 AS query_id FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY item_id * 7919 % 10007) AS rn FROM l QUALIFY rn <= 20),
p AS (SELECT *, sum(CAST(relevant AS INT)) OVER (PARTITION BY query_id ORDER BY rn) / rn AS p FROM r),
a AS (SELECT query_id, coalesce(avg(p) FILTER (relevant), 0) AS precision, count(*) FILTER (relevant) AS found FROM p GROUP BY 1),
t AS (SELECT query_id, count(*) AS total FROM l WHERE relevant GROUP BY 1)
SELECT query_id, round(precision, 6) AS precision, round(found / total, 6) AS recall FROM a JOIN t USING (query_id)""",
    "eval_overlap": f"SELECT doc_id AS item_id, item_id AS query_id, round(len(list_intersect({_TOK.format('b.text').replace('{{', '{').replace('}}', '}')}, {_TOK.format('d.text').replace('{{', '{').replace('}}', '}')})) / len({_TOK.format('b.text').replace('{{', '{').replace('}}', '}')}), 6) AS overlap FROM documents d JOIN benchmark b ON doc_id % (SELECT max(item_id) + 1 FROM benchmark) = item_id",
    "eval_faithfulness": f"""WITH ans AS (SELECT conv_id * 100 + turn AS answer_id, text || ' [' || turn % 4 || '][2]' AS text, conv_id, turn FROM conversations WHERE role = 'assistant'),
m AS (SELECT *, list_distinct(list_transform(regexp_extract_all(text, '\\[(\\d{{1,3}})\\]', 1), lambda x: CAST(x AS INT))) AS cited FROM ans),
s AS (SELECT answer_id, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS sentence, unnest(range(1, 1 + len(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))))) AS pos FROM ans),
c AS (SELECT DISTINCT answer_id, pos, sentence, CAST(unnest(regexp_extract_all(sentence, '\\[(\\d{{1,3}})\\]', 1)) AS INT) AS n FROM s WHERE trim(sentence, ' ') <> ''),
o AS (SELECT c.answer_id, pos, {_TOK.format("sentence").replace("{{", "{").replace("}}", "}")} AS a, {_TOK.format("coalesce(d.text, '')").replace("{{", "{").replace("}}", "}")} AS b FROM c LEFT JOIN documents d ON n BETWEEN 1 AND 3 AND doc_id = (c.answer_id * 7 + n) % {CITED}),
g AS (SELECT answer_id, avg(CAST(best > {OVERLAP} AS INT)) AS grounded FROM (SELECT answer_id, pos, max(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END) AS best FROM o GROUP BY ALL) GROUP BY answer_id),
v AS (SELECT *, len(cited) > 0 AS marked, len(cited) > 0 AND len(list_filter(cited, lambda x: x < 1 OR x > 3)) = 0 AS valid FROM m LEFT JOIN g USING (answer_id))
SELECT answer_id, round(CASE WHEN conv_id % 5 = 0 THEN CAST((turn % 3 = 0 OR {_REFUSED}) AND NOT (marked AND NOT valid) AS INT)
  ELSE (CAST(marked AS INT) + CAST(valid AS INT) + coalesce(grounded, 0) + (CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'de') AS INT)) / 2) / 4 END, 6) AS score FROM v""",
    "queue_health": f"{_EV} SELECT count(*) AS pending, min(ms) AS oldest, coalesce(greatest(0, {D.EPOCH + 40 * 86_400_000} - min(ms)), 0) AS age_ms FROM event_log WHERE event_type = 'signup'",
    "backoff_schedule": "SELECT event_id, CAST(least(900000, 1000 * power(2, greatest(0, event_id % 13 - 1))) AS BIGINT) AS wait_ms FROM events",
    "eta_estimate": f"""{_EV}, a AS (SELECT event_id, event_id % 4000 AS items, floor((event_id % 700) / 1.05) AS today, event_id % 9 * 100 AS daily, (ms // 86400000 + 1) * 86400000 - ms AS wait FROM event_log),
b AS (SELECT *, greatest(1, floor(daily / 1.05)) AS fd, floor((items - today) / greatest(1, floor(daily / 1.05))) AS days FROM a),
c AS (SELECT event_id, CAST(CASE WHEN items <= 0 THEN 0 WHEN daily <= 0 THEN NULL WHEN items <= today THEN ceil(items * (60000::DOUBLE / 18 * 1.05::DOUBLE)) ELSE ceil(wait + days * 86400000 + (items - today - days * fd) * (60000::DOUBLE / 18 * 1.05::DOUBLE)) END AS BIGINT) AS eta_ms FROM b),
d AS (SELECT *, list_filter([CASE WHEN eta_ms // 86400000 > 0 THEN eta_ms // 86400000 || 'd' END, CASE WHEN eta_ms % 86400000 // 3600000 > 0 THEN eta_ms % 86400000 // 3600000 || 'h' END, CASE WHEN eta_ms % 3600000 // 60000 > 0 THEN eta_ms % 3600000 // 60000 || 'm' END], lambda x: x IS NOT NULL) AS parts FROM c)
SELECT event_id, eta_ms, CASE WHEN eta_ms IS NULL THEN 'unknown' WHEN eta_ms <= 0 THEN 'done' WHEN eta_ms < 60000 THEN '<1m' ELSE array_to_string(parts[1:2], ' ') END AS human FROM d""",
    # one event after the other, from the state that the last one left
    "fixed_window_limiter": f"""{_REC}, {_NTH.format("user_id")}, f AS (
  SELECT k, n, ms, event_id, CAST(1 AS BIGINT) AS held, ms + {WINDOW_MS} AS until FROM e WHERE n = 1
  UNION ALL SELECT e.k, e.n, e.ms, e.event_id, CASE WHEN e.ms >= until THEN 1 ELSE held + 1 END, CASE WHEN e.ms >= until THEN e.ms + {WINDOW_MS} ELSE until END FROM f JOIN e ON e.k = f.k AND e.n = f.n + 1)
SELECT event_id, k AS user_id, held <= {PER_WINDOW} AS allowed, CAST(CASE WHEN held <= {PER_WINDOW} THEN 0 ELSE greatest(1, (until - ms + 999) // 1000) END AS BIGINT) AS retry_after_sec FROM f""",
    "token_bucket": f"""{_REC}, {_NTH.format("user_id")}, f AS (
  SELECT k, n, event_id, ms AS t, ms - {DAY} AS empty FROM e WHERE n = 1
  UNION ALL SELECT k, n, event_id, t, greatest(empty, t - 2 * {DAY}) + {DAY} FROM (
    SELECT e.k, e.n, e.event_id, greatest(e.ms, t, empty + {DAY}) AS t, empty FROM f JOIN e ON e.k = f.k AND e.n = f.n + 1))
SELECT event_id, k AS user_id, t AS "at", round((t - empty) / {DAY}, 6) AS tokens FROM f""",
    "job_states": f"""{_REC}, {_NTH.format("user_id")}, f AS (
  SELECT k, CAST(0 AS BIGINT) AS n, 'none' AS status, CAST(0 AS BIGINT) AS attempts, CAST(0 AS BIGINT) AS due FROM e WHERE n = 1
  UNION ALL SELECT k, n, CASE moved WHEN 'enqueue' THEN 'queued' WHEN 'claim' THEN 'active' WHEN 'done' THEN 'done' WHEN 'fail' THEN CASE WHEN attempts >= 5 THEN 'failed' ELSE 'queued' END ELSE status END,
    CASE moved WHEN 'enqueue' THEN 0 WHEN 'claim' THEN attempts + 1 ELSE attempts END,
    CASE WHEN moved = 'enqueue' THEN ms WHEN moved = 'fail' AND attempts < 5 THEN ms + least(900000, 1000 * CAST(power(2, greatest(0, attempts - 1)) AS BIGINT)) ELSE due END FROM (
    SELECT e.k, e.n, e.ms, status, attempts, due, CASE WHEN event_type = 'signup' AND status IN ('none', 'done', 'failed') THEN 'enqueue' WHEN event_type NOT IN ('signup', 'error', 'purchase') AND status = 'queued' AND e.ms >= due THEN 'claim'
      WHEN event_type = 'purchase' AND status = 'active' THEN 'done' WHEN event_type = 'error' AND status = 'active' THEN 'fail' END AS moved FROM f JOIN e ON e.k = f.k AND e.n = f.n + 1))
SELECT status, count(*) AS n, max(attempts) AS attempts FROM f WHERE n > 0 GROUP BY status""",
    "claim_winners": f"""{_REC}, {_NTH.format("event_type")}, f AS (
  SELECT k, n, event_id, true AS won, ms + {LEASE} AS until FROM e WHERE n = 1
  UNION ALL SELECT e.k, e.n, e.event_id, e.ms >= until, CASE WHEN e.ms >= until THEN e.ms + {LEASE} ELSE until END FROM f JOIN e ON e.k = f.k AND e.n = f.n + 1)
SELECT event_id, k AS event_type, won FROM f""",
    "stage_outcomes": f"""{_I}, i AS (SELECT item_id, created_at AS ms, length(coalesce(content, '')) AS n, length(coalesce(content, '')) % 7 AS k FROM items),
a AS (SELECT *, unnest(range(1, least(5, k + 1) + 1)) AS attempt FROM i WHERE n >= {SHORT})
SELECT item_id, 'extract' AS stage, CAST(1 AS INTEGER) AS attempt, ms, CASE WHEN n < {SHORT} THEN 'failed' ELSE 'done' END AS outcome, CASE WHEN n < {SHORT} THEN 'failed' ELSE 'processing' END AS status, CASE WHEN n < {SHORT} THEN 'too short' END AS reason FROM i
UNION ALL SELECT item_id, 'enrich', CAST(attempt AS INTEGER), ms + 1000 * (CAST(power(2, attempt - 1) AS BIGINT) - 1), CASE WHEN attempt > k THEN 'done' WHEN attempt = 5 THEN 'failed' ELSE 'retry' END,
  CASE WHEN attempt <= k AND attempt = 5 THEN 'failed' ELSE 'processing' END, CASE WHEN attempt > k THEN NULL WHEN attempt = 5 THEN 'no answer (gave up after 5 attempts)' ELSE 'no answer' END FROM a
UNION ALL SELECT item_id, 'index', CAST(1 AS INTEGER), ms + 1000 * (CAST(power(2, k) AS BIGINT) - 1), 'done', 'done', NULL FROM i WHERE n >= {SHORT} AND k < 5""",
    "daily_budget_lanes": f"""{_REC}, {_NTH.format(f"ms // {DAY}")}, f AS (
  SELECT k, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS used, false AS ok, CAST(0 AS BIGINT) AS remaining FROM e WHERE n = 1
  UNION ALL SELECT k, n, event_id, CASE WHEN used < most THEN used + 1 ELSE used END, used < most, CASE WHEN used < most THEN most - used - 1 ELSE 0 END FROM (
    SELECT e.k, e.n, e.event_id, used, CASE WHEN event_type = 'purchase' THEN {CAP} ELSE {CAP - RESERVE} END AS most FROM f JOIN e ON e.k = f.k AND e.n = f.n + 1))
SELECT event_id, ok, remaining FROM f WHERE n > 0""",
    "daily_budget_single_lane": f"{_EV} SELECT ms // 86400000 AS day, count(*) AS asked, least(count(*), {CAP - RESERVE}) AS admitted FROM event_log GROUP BY 1",
    "domain_spacing": f"{_EV}, n AS (SELECT *, row_number() OVER w * {GAP} AS n FROM event_log WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)) SELECT event_id, user_id, CAST(max(ms - n) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) + n AS BIGINT) AS start FROM n",
    "backfill_ticks": f"{_I} SELECT item_id, (row_number() OVER (PARTITION BY user_id ORDER BY created_at) - 1) // 20 AS tick FROM items",
    "failover_results": "WITH a AS (SELECT event_id // 4 AS call_id, event_id % 4 + 1 AS attempt, event_id * 31 % 3 = 0 AS ok, 'r' || event_id AS result FROM events) SELECT call_id, coalesce(min(attempt) FILTER (ok), max(attempt)) AS units, count(*) FILTER (ok) > 0 AS ok, arg_min(result, attempt) FILTER (ok) AS result FROM a GROUP BY 1",
    "stream_daily_counts": "SELECT epoch_ms(date_trunc('day', ts)) AS day_ms, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "llm_calls_by_model": "SELECT event_type AS model, event_id % 3 AS prompt_version, count(*) AS calls FROM events GROUP BY 1, 2",
    "json_props_sum": "SELECT event_type, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS k, count(props ->> '$.k') AS n FROM events GROUP BY 1",
}
