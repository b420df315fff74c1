"""Registered queries over keyword, vector and fused search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.functions import text as T
from lexilake.functions import vectors as V
from lexilake.operators import keyword_index as K
from lexilake.operators import search as S
from lexilake.operators import vector_index as I
from lexilake.sources import stored, tables
from lexilake.sources.tables import with_views

#: The registered queries' parameters: the benchmark row asked for, the user, and thresholds
#: that separate something on the 64-dimensional test vectors.
QUERY, USER = 0, 1
LABEL_DISTANCE = 0.75


def _asked(spark: SparkSession, sf_dir: str) -> list[str]:
    """The tokens of one query; the driver has it as a user typed it."""
    row = tables.queries(spark, sf_dir).where(F.col("query_id") == QUERY).select(T.query_tokens(F.col("query")).alias("t")).head()
    return row["t"] if row else []


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return tables.raw(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").head()["embedding"]


#: Where the index of a table stands, by session, files and their fingerprint.
_BUILT: dict[tuple, str] = {}


def _built(spark: SparkSession, path: str, name: str, build: Callable[[str], None]) -> str:
    """The stored index over a table, built by the first query that needs it and again when the table's files change."""
    key = (spark.sparkContext.applicationId, path, *stored.fingerprint(spark, path))
    if key not in _BUILT:
        where = stored.fresh_path(spark, name)
        build(where)
        _BUILT[key] = where
    return _BUILT[key]


def tokenized_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tokenized(tables.items(spark, sf_dir), "title", "lang", "source", "content")


def index_path(spark: SparkSession, sf_dir: str) -> str:
    return _built(spark, f"{sf_dir}/documents.parquet", "keyword-index", lambda where: K.build(tokenized_items(spark, sf_dir).select("item_id", "tokens"), where))


def vector_index(spark: SparkSession, sf_dir: str) -> I.VectorIndex:
    return I.read(spark, _built(spark, f"{sf_dir}/embeddings.parquet", "vector-index", lambda where: I.build(tables.chunk_vectors(spark, sf_dir), where)))


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return K.read(spark, index_path(spark, sf_dir))


def _hits(spark: SparkSession, sf_dir: str, *columns: str, keep: Column | None = None) -> DataFrame:
    """item_id, rank and ``columns`` of one user's items that the query finds."""
    scope = F.col("user_id") == USER
    own = tables.items(spark, sf_dir).where(scope if keep is None else scope & keep).select("item_id", *columns)
    return K.search(_index(spark, sf_dir), _asked(spark, sf_dir)).join(own, "item_id")


def fts_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("item_id", F.round("rank", 6).alias("rank")).orderBy("rank", "item_id").limit(20)


def fts_bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = F.col("kind").isin("article", "pdf") & F.col("status").isin("inbox", "testing", "tested", "archived")
    return _hits(spark, sf_dir, "kind", keep=keep).select("item_id", "kind", F.round("rank", 6).alias("rank")).orderBy("rank", "item_id").limit(20)


def fts_bm25_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tables.queries(spark, sf_dir).select("query_id", T.query_tokens(F.col("query")).alias("tokens"))
    return K.search_many(_index(spark, sf_dir), asked).groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.min("rank"), 6).alias("best"))


def fts_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tables.queries(spark, sf_dir).select("query_id", F.posexplode(T.query_tokens(F.col("query"))).alias("pos", "token"))
    return asked.select("query_id", F.col("pos").cast("bigint").alias("pos"), "token")


def fts_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "title", "content").select("item_id", S.keyword_snippet(["title", "content"], _asked(spark, sf_dir)).alias("snippet"))


def fts_index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _index(spark, sf_dir)
    return rows.groupBy("term").agg(F.count("*").alias("items"), F.sum("tf").alias("occurrences"))


def knn_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = tables.chunk_vectors(spark, sf_dir).select("chunk_id", "item_id", V.l2(F.col("embedding"), V.literal(query_vector(spark, sf_dir))).alias("distance"))
    return chunks.orderBy("distance", "chunk_id").limit(10).select("chunk_id", "item_id", F.round("distance", 6).alias("distance"))


def knn_dedupe_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, _ = I.nearest_items(vector_index(spark, sf_dir), query_vector(spark, sf_dir), USER, 10, lambda rows: rows.where("item_id <> 0"))
    return near.select("item_id", "chunk_id", F.round("distance", 6).alias("distance"))


def knn_prefetch_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, _ = I.nearest_chunks(vector_index(spark, sf_dir), query_vector(spark, sf_dir), USER, 20, lambda rows: rows.where("item_id <> 0"))
    return near.groupBy("item_id").agg(F.min("distance").alias("distance")).orderBy("distance", "item_id").limit(5).select("item_id", F.round("distance", 6).alias("distance"))


def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.literal(query_vector(spark, sf_dir))
    chunks = tables.chunk_vectors(spark, sf_dir).select("chunk_id", V.l2(F.col("embedding"), q).alias("d"), V.cosine_similarity(F.col("embedding"), q).alias("cosine"))
    return chunks.select("chunk_id", F.round(V.linear_score(F.col("d")), 6).alias("linear"), F.round(V.reciprocal_score(F.col("d")), 6).alias("reciprocal"), F.round("cosine", 6).alias("cosine"))


def mean_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = S.mean_vectors(tables.chunk_vectors(spark, sf_dir)).select("item_id", F.posexplode("mean").alias("pos", "x"))
    return own.select("item_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def cosine_nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tables.raw(spark, sf_dir, "embeddings")
    first = own.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    labels = own.drop("label").join(first, "vec_id").select(F.col("label"), F.col("embedding").alias("vector"))
    out = S.nearest_label(own.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), labels, LABEL_DISTANCE)
    return out.select("query_id", (F.round("distance", 6) + 0.0).alias("distance"), "label")


def _keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("item_id", F.round("rank", 9).alias("rank"))


def _rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    keyword = _keyword(spark, sf_dir)
    items = tables.items(spark, sf_dir).where(F.col("user_id") == USER).select("item_id")
    vector, _ = I.nearest_items(vector_index(spark, sf_dir), query_vector(spark, sf_dir), USER, S.POOL, lambda rows: rows.join(items, "item_id", "left_semi"))
    vector = vector.withColumn("distance", F.round("distance", 9))
    return keyword, vector


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyword, vector = _rankings(spark, sf_dir)
    both = S.fused(S.ranked(keyword.orderBy("rank", "item_id").limit(S.POOL), "fts", "rank", "item_id"), S.ranked(vector, "vector", "distance", "item_id"))
    return both.select("item_id", F.round("score", 9).alias("score"), F.col("ranks")["fts"].cast("bigint").alias("fts_rank"), F.col("ranks")["vector"].cast("bigint").alias("vector_rank"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = S.hybrid(*_rankings(spark, sf_dir), limit=S.PAGE).select("item_id", "score")
    items = tables.items(spark, sf_dir).select("item_id", "title", "kind", "status", T.snippet(F.col("content")).alias("snippet"))
    return items.join(page, "item_id").select("item_id", F.round("score", 9).alias("score"), "title", "kind", "status", "snippet")


def hybrid_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _rankings(spark, sf_dir)
    last = S.hybrid(*both, limit=S.PAGE).tail(1)  # the cursor of the page before
    cursor = S.decode_cursor(S.encode_cursor(score=last[0]["score"], id=last[0]["item_id"])) if last else None
    page = S.hybrid(*both, limit=S.PAGE, cursor=(cursor["score"], cursor["id"]) if cursor else None)
    return page.select("item_id", F.round("score", 9).alias("score"))


def fts_only_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyword = _keyword(spark, sf_dir)
    return S.page_after(S.fused(S.ranked(keyword.orderBy("rank", "item_id").limit(S.POOL), "fts", "rank", "item_id")), S.PAGE).select("item_id", F.round("score", 9).alias("score"))


_FOLD = f"regexp_replace(translate(lower({{0}}), '{T.MARKED}', '{T.PLAIN}'), '[\\x{{{{300}}}}-\\x{{{{36F}}}}]+', '', 'g')"
_TOKENS = "regexp_extract_all(" + _FOLD + ", '[\\p{{L}}\\p{{N}}]+')"
_TEXT = "coalesce(title, '') || ' ' || lang || ' ' || source || ' ' || coalesce(content, '')"
TEXT_TOKENS = _TOKENS.format(_TEXT)
#: DuckDB's list_distinct keeps no order, so first appearances are picked by position.
_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def _query_sql() -> str:
    return f"""q AS (SELECT unnest(ts[1:{T.MAX_QUERY_TOKENS}]) AS t FROM (SELECT {_DISTINCT.format("t")} AS ts FROM (SELECT {_TOKENS.format("text")} AS t FROM benchmark WHERE item_id = {QUERY})))"""


_BM25 = f"""tok AS (SELECT *, {_TOKENS.format(_TEXT)} AS tokens FROM items),
{_query_sql()},
st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
f AS (SELECT item_id, t, len(list_filter(tokens, lambda x: starts_with(x, t))) AS f, len(tokens) AS dl FROM tok, q),
df AS (SELECT t, count(*) FILTER (f > 0) AS df FROM f GROUP BY t),
hits AS (SELECT item_id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * {S.K1 + 1} / (f + {S.K1} * (1 - {S.B} + {S.B} * dl / avgdl))) AS rank
  FROM f JOIN df USING (t), st GROUP BY item_id HAVING sum(f) > 0)"""
_QV = "qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_L2 = "sqrt(list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
_COS = "list_dot_product(embedding, q) / (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product(q, q)))"
_FUSED = f"""{_BM25},
{_QV},
kw AS (SELECT item_id, row_number() OVER (ORDER BY r, item_id) AS rn FROM (SELECT item_id, round(rank, 9) AS r FROM hits JOIN items USING (item_id) WHERE user_id = {USER}) QUALIFY rn <= {S.POOL}),
vd AS (SELECT item_id, round(min({_L2}), 9) AS d, min({_L2}) AS d0 FROM chunk_vectors, qv WHERE user_id = {USER} AND item_id IN (SELECT item_id FROM items WHERE user_id = {USER}) GROUP BY item_id ORDER BY d0, item_id LIMIT {S.POOL}),
vc AS (SELECT item_id, row_number() OVER (ORDER BY d, item_id) AS rn FROM vd),
fu AS (SELECT item_id, coalesce(1 / ({S.RRF_K} + kw.rn), 0) + coalesce(1 / ({S.RRF_K} + vc.rn), 0) AS score, kw.rn AS fts_rank, vc.rn AS vector_rank FROM kw FULL JOIN vc USING (item_id))"""
_ITEMS = with_views("items", sql="")[:-1]
_BOTH = with_views("items", "chunk_vectors", sql="")[:-1]

QUERIES = {f.__name__: f for f in (fts_bm25_topk, fts_bm25_filtered, fts_bm25_many, fts_tokenize, fts_snippet, fts_index_postings, knn_l2_topk, knn_dedupe_items, knn_prefetch_neighbors, vector_scores, mean_embedding, cosine_nearest_label, rrf_fusion, hybrid_search, hybrid_page2, fts_only_page)}

ORACLE = {
    "fts_bm25_topk": f"{_ITEMS}, {_BM25} SELECT item_id, round(rank, 6) AS rank FROM hits JOIN items USING (item_id) WHERE user_id = {USER} ORDER BY 2, 1 LIMIT 20",
    "fts_bm25_filtered": f"{_ITEMS}, {_BM25} SELECT item_id, kind, round(rank, 6) AS rank FROM hits JOIN items USING (item_id) WHERE user_id = {USER} AND kind IN ('article', 'pdf') AND status IN ('inbox', 'testing', 'tested', 'archived') ORDER BY 3, 1 LIMIT 20",
    "fts_bm25_many": f"""{_ITEMS}, tok AS (SELECT item_id, {_TOKENS.format(_TEXT)} AS tokens FROM items),
q AS (SELECT query_id, unnest(ts[1:{T.MAX_QUERY_TOKENS}]) AS t FROM (SELECT query_id, {_DISTINCT.format("t")} AS ts FROM (SELECT item_id AS query_id, {_TOKENS.format("text")} AS t FROM benchmark))),
st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
p AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(tokens) AS term FROM tok) GROUP BY ALL),
f AS (SELECT t, item_id, sum(tf) AS f FROM p JOIN (SELECT DISTINCT t FROM q) ON starts_with(term, t) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM f GROUP BY t),
r AS (SELECT query_id, item_id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * {S.K1 + 1} / (f + {S.K1} * (1 - {S.B} + {S.B} * len(tokens) / avgdl))) AS rank
  FROM f JOIN df USING (t) JOIN tok USING (item_id) JOIN q USING (t), st GROUP BY ALL)
SELECT query_id, count(*) AS hits, round(min(rank), 6) AS best FROM r GROUP BY query_id""",
    "fts_snippet": f"""{_ITEMS}, {_BM25},
h AS (SELECT item_id, title, content FROM hits JOIN items USING (item_id) WHERE user_id = {USER}),
c AS (SELECT item_id, 0 AS o, title AS body FROM h UNION ALL SELECT item_id, 1, content FROM h),
p AS (SELECT item_id, o, regexp_extract_all(coalesce(body, ''), '[\\p{{L}}\\p{{N}}\\x{{300}}-\\x{{36F}}]+[^\\p{{L}}\\p{{N}}]*') AS pieces FROM c),
m AS (SELECT item_id, o, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS i FROM p),
hit AS (SELECT item_id, o, i, t FROM m JOIN q ON starts_with({_TOKENS.format("piece")}[1], t)),
win AS (SELECT a.item_id, a.o, a.i, count(DISTINCT b.t) AS n FROM (SELECT DISTINCT item_id, o, i FROM hit) a JOIN hit b ON a.item_id = b.item_id AND a.o = b.o AND b.i >= a.i AND b.i < a.i + 24 GROUP BY ALL),
b AS (SELECT item_id, pieces, i FROM (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, o, i) = 1) JOIN p USING (item_id, o))
SELECT item_id, snippet FROM h LEFT JOIN (SELECT item_id, CASE WHEN i > 1 THEN '…' ELSE '' END || regexp_replace(array_to_string(pieces[i:i + 23], ''), '\\s+$', '') || CASE WHEN i + 24 <= len(pieces) THEN '…' ELSE '' END AS snippet FROM b) USING (item_id)""",
    "fts_tokenize": f"SELECT query_id, CAST(unnest(range(0, len(ts[1:{T.MAX_QUERY_TOKENS}]))) AS BIGINT) AS pos, unnest(ts[1:{T.MAX_QUERY_TOKENS}]) AS token FROM (SELECT query_id, {_DISTINCT.format('t')} AS ts FROM (SELECT item_id AS query_id, {_TOKENS.format('text')} AS t FROM benchmark))",
    "fts_index_postings": f"{_ITEMS}, p AS (SELECT item_id, unnest({_TOKENS.format(_TEXT)}) AS term FROM items) SELECT term, count(DISTINCT item_id) AS items, count(*) AS occurrences FROM p GROUP BY term",
    "knn_l2_topk": f"WITH {_QV}, chunk_vectors AS ({tables.SQL_VIEWS['chunk_vectors']}) SELECT chunk_id, item_id, round({_L2}, 6) AS distance FROM chunk_vectors, qv ORDER BY {_L2}, chunk_id LIMIT 10",
    "knn_dedupe_items": f"{_BOTH}, {_QV}, d AS (SELECT item_id, chunk_id, {_L2} AS distance FROM chunk_vectors, qv WHERE user_id = {USER} AND item_id <> 0) SELECT item_id, arg_min(chunk_id, distance) AS chunk_id, round(min(distance), 6) AS distance FROM d GROUP BY item_id ORDER BY min(distance), item_id LIMIT 10",
    "knn_prefetch_neighbors": f"{_BOTH}, {_QV}, d AS (SELECT item_id, chunk_id, {_L2} AS distance FROM chunk_vectors, qv WHERE user_id = {USER} AND item_id <> 0 ORDER BY distance, chunk_id LIMIT 20) SELECT item_id, round(min(distance), 6) AS distance FROM d GROUP BY item_id ORDER BY min(distance), item_id LIMIT 5",
    "vector_scores": f"{_BOTH}, {_QV}, d AS (SELECT chunk_id, {_L2} AS d, {_COS} AS c FROM chunk_vectors, qv) SELECT chunk_id, round(greatest(0.0, least(1.0, 1 - d / 2)), 6) AS linear, round(1 / (1 + d), 6) AS reciprocal, round(c, 6) AS cosine FROM d",
    "mean_embedding": f"{_BOTH}, u AS (SELECT item_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM chunk_vectors) SELECT item_id, pos, round(avg(x), 6) AS x FROM u GROUP BY item_id, pos",
    "cosine_nearest_label": f"""WITH l AS (SELECT label, embedding::DOUBLE[] AS embedding FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
v AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings),
d AS (SELECT query_id, label, 1 - {_COS} AS distance FROM v, l),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, label) = 1)
SELECT query_id, round(distance, 6) + 0.0 AS distance, CASE WHEN distance <= {LABEL_DISTANCE} THEN label END AS label FROM b""",
    "rrf_fusion": f"{_BOTH}, {_FUSED} SELECT item_id, round(score, 9) AS score, fts_rank, vector_rank FROM fu",
    "hybrid_search": f"{_BOTH}, {_FUSED}, pg AS (SELECT * FROM fu ORDER BY score DESC, item_id LIMIT {S.PAGE}), tx AS (SELECT *, regexp_replace(content, '^[\\s\\x{{FEFF}}]+|[\\s\\x{{FEFF}}]+$', '', 'g') AS own FROM items) SELECT item_id, round(score, 9) AS score, title, kind, status, CASE WHEN length(own) <= 220 THEN own ELSE regexp_replace(left(own, 220), '^[\\s]+|[\\s]+$', '', 'g') || '…' END AS snippet FROM pg JOIN tx USING (item_id)",
    "hybrid_page2": f"{_BOTH}, {_FUSED} SELECT item_id, round(score, 9) AS score FROM fu ORDER BY fu.score DESC, item_id LIMIT {S.PAGE} OFFSET {S.PAGE}",
    "fts_only_page": f"{_BOTH}, {_FUSED} SELECT item_id, round(1 / ({S.RRF_K} + rn), 9) AS score FROM kw ORDER BY rn LIMIT {S.PAGE}",
}
