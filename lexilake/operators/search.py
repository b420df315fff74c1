"""Hybrid retrieval: keyword ranking, vector search, rank fusion, pages."""

from __future__ import annotations

import base64
import json
import logging
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexilake.functions import text as T
from lexilake.functions import vectors as V
from lexilake.operators.keyword_index import B, K1

logger = logging.getLogger(__name__)

#: A word of the source text with what follows it up to the next.
WORD_AND_GAP = r"[\p{L}\p{N}\x{300}-\x{36F}]+[^\p{L}\p{N}]*"
RRF_K, POOL, PAGE, PAGE_MAX = 60, 200, 20, 100
#: Topics of a block, and how many are few enough to be held by every executor.
LABEL_BLOCK, LABELS_HELD = 256, 4096


def clamped_limit(limit: float | None, default: int = PAGE, most: int = PAGE_MAX) -> int:
    """1 to ``most``; no number or not a number is the default."""
    if limit is None or limit != limit:
        return default
    return int(min(max(limit, 1), most))


def tokenized(items: DataFrame, *columns: str) -> DataFrame:
    """Add ``tokens`` of all the columns together: what the keyword index holds of an item."""
    return items.withColumn("tokens", T.index_tokens(F.concat_ws(" ", *columns)))


def bm25(items: DataFrame, tokens: list[str], keep: Column | None = None) -> DataFrame:
    """Score items (``item_id``, ``tokens``) that have no stored index for a query's tokens, each a prefix. Smaller is better.

    Statistics are of all ``items``, whatever ``keep`` leaves of them. For one query
    nothing is shuffled but one row of sums: a token's frequency is counted where
    the item is, and the row of statistics is joined back.
    """
    if not tokens:
        return items.select("item_id", F.lit(0.0).alias("rank")).where(F.lit(False))
    asked = F.array(*[F.lit(t) for t in tokens])
    counted = items.select("*", F.transform(asked, lambda q: F.size(F.filter("tokens", lambda t: t.startswith(q)))).alias("f"), F.size("tokens").alias("dl"))
    stats = counted.agg(
        F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.array(*[F.count_if(F.col("f")[k] > 0) for k in range(len(tokens))]).alias("df")
    )
    scored = counted.where(F.exists("f", lambda x: x > 0))
    if keep is not None:
        scored = scored.where(keep)
    scored = scored.crossJoin(F.broadcast(stats))  # one row
    idf = lambda k: F.greatest(F.log((F.col("n") - F.col("df")[k] + 0.5) / (F.col("df")[k] + 0.5)), F.lit(1e-6))
    part = lambda k: idf(k) * F.col("f")[k] * (K1 + 1) / (F.col("f")[k] + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.withColumn("rank", -reduce(Column.__add__, [part(k) for k in range(len(tokens))])).drop("n", "avgdl", "df", "f", "dl")


def keyword_snippet(columns: list[str], tokens: list[str], most: int = 24) -> Column:
    """The ``most`` words of the source text that hold the most of the tokens, each a prefix; null if no column has one.

    Of equal windows the first of the first column counts; a window begins with a word
    that is found. Only the words that are found are looked at, with those of the
    ``most`` behind each that lie in its window. Words keep their case, marks and what
    stands between them; an ellipsis says where the text goes on.
    """
    head = "^(?:" + "|".join(tokens) + ")" if tokens else "(?!)"  # tokens are letters and digits
    asked = F.array(*[F.lit(t) for t in tokens]).cast("array<string>")

    def cut(pieces: Column, first: Column) -> Column:
        own = F.regexp_replace(F.array_join(F.slice(pieces, first, most), ""), r"(?U)\s+$", "")
        return F.concat(F.when(first > 1, "…").otherwise(""), own, F.when(first + most <= F.size(pieces), "…").otherwise(""))

    def windows(hits: Column) -> Column:
        inside = lambda x, i: F.filter(F.slice(hits, i + 1, F.lit(most)), lambda y: y["at"] < x["at"] + most)
        seen = lambda x, i: F.size(F.array_distinct(F.flatten(F.transform(inside(x, i), lambda y: y["which"]))))
        return F.transform(hits, lambda x, i: F.struct(seen(x, i).alias("n"), (-x["at"]).alias("before")))

    def of(column: str, place: int) -> Column:
        # each step is a lambda's variable, so that no step is worked out twice
        pieces = F.array(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(WORD_AND_GAP), F.lit(0)))
        words = F.transform(pieces, lambda ps: F.struct(ps.alias("ps"), F.filter(F.transform(ps, lambda p, i: F.struct((i + 1).alias("at"), T.folded(p).alias("w"))), lambda x: x["w"].rlike(head)).alias("found")))
        hits = F.transform(words, lambda s: F.struct(s["ps"].alias("ps"), F.transform(s["found"], lambda x: F.struct(x["at"].alias("at"), F.filter(asked, lambda t: x["w"].startswith(t)).alias("which"))).alias("hits")))
        best = F.transform(hits, lambda s: F.struct(s["ps"].alias("ps"), F.array_max(windows(s["hits"])).alias("best")))
        return F.transform(best, lambda s: F.when(s["best"].isNotNull(), F.struct(s["best"]["n"].alias("n"), F.lit(-place).alias("place"), cut(s["ps"], -s["best"]["before"]).alias("text"))))[0]

    return F.array_max(F.array(*[of(c, k) for k, c in enumerate(columns)]))["text"]


def nearest_items(chunks: DataFrame, query: Column, limit: int) -> DataFrame:
    """The nearest items by their best chunk, without an index: item_id, chunk_id, distance.

    Exact over all (already scoped) ``chunks``; ties in distance go to the smaller chunk, then item.
    """
    near = chunks.select("item_id", F.struct(V.l2(F.col("embedding"), query).alias("distance"), "chunk_id").alias("best"))
    best = near.groupBy("item_id").agg(F.min("best").alias("best"))
    return best.select("item_id", "best.chunk_id", "best.distance").orderBy("distance", "item_id").limit(limit)


def nearest_prefetched(chunks: DataFrame, query: Column, top: int) -> DataFrame:
    """The nearest items among the ``max(4 * top, 20)`` nearest chunks; may be fewer than ``top``."""
    raw = chunks.select("item_id", "chunk_id", V.l2(F.col("embedding"), query).alias("distance")).orderBy("distance", "chunk_id").limit(max(4 * top, 20))
    return raw.groupBy("item_id").agg(F.min("distance").alias("distance")).orderBy("distance", "item_id").limit(top)


def mean_vectors(chunks: DataFrame) -> DataFrame:
    """Component-wise mean of each item's vectors: item_id, user_id, mean."""
    each = chunks.select("item_id", "user_id", F.posexplode("embedding").alias("pos", "x")).groupBy("item_id", "user_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy("item_id", "user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))


def nearest_label(queries: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Each query vector's nearest label by cosine distance, if within the threshold; else a new one.

    ``labels`` (label, vector) is a dimension of topics, packed into blocks: a query
    meets each block once and takes the best of it. The blocks are broadcast if they
    are counted to be few.
    """
    n = labels.count()
    blocks = max(1, math.ceil(n / LABEL_BLOCK))
    packed = labels.groupBy(F.pmod(F.xxhash64("label"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("label", "vector")).alias("labels"))
    asked = queries.select("query_id", "query_vector", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))
    near = asked.join(F.broadcast(packed) if n <= LABELS_HELD else packed, "block")
    each = F.transform("labels", lambda x: F.struct(V.cosine_distance(F.col("query_vector"), x["vector"]).alias("distance"), x["label"].alias("label")))
    best = near.select("query_id", F.array_min(each).alias("best")).groupBy("query_id").agg(F.min("best").alias("best"))
    return best.select("query_id", F.col("best.distance").alias("distance"), F.when(F.col("best.distance") <= threshold, F.col("best.label")).alias("label"))


def ranked(hits: DataFrame, source: str, *order: str) -> DataFrame:
    """Positions in a ranking, 1 upwards: item_id, source, rn. A ranking is a bounded pool."""
    return hits.select("item_id", F.lit(source).alias("source"), F.row_number().over(W.orderBy(*order)).alias("rn"))


def fused(*rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: item_id, score, ranks (source to position), best first."""
    every = reduce(DataFrame.unionByName, rankings)
    out = every.groupBy("item_id").agg(F.sum(1 / (k + F.col("rn"))).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "rn")))).alias("ranks"))
    return out.orderBy(F.desc("score"), "item_id")


def page_after(results: DataFrame, limit: int, cursor: tuple[float, int] | None = None) -> DataFrame:
    """The page strictly behind a cursor, best score first."""
    if cursor is not None:
        score, item = cursor
        results = results.where((F.col("score") < score) | ((F.col("score") == score) & (F.col("item_id") > item)))
    return results.orderBy(F.desc("score"), "item_id").limit(limit)


def encode_cursor(**values) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, on_bad: str = "first") -> dict | None:
    """The values of a cursor; a bad one is the first page or an error."""
    try:
        said = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        if isinstance(said, dict):
            return said
    except ValueError:
        pass
    if on_bad == "error":
        raise ValueError("the cursor is not valid")
    return None


def hybrid(keyword: DataFrame, vector: DataFrame, limit: int, cursor: tuple[float, int] | None = None) -> DataFrame:
    """Both rankings of at most POOL items, fused and cut to a page."""
    both = fused(ranked(keyword.orderBy("rank", "item_id").limit(POOL), "fts", "rank", "item_id"), ranked(vector, "vector", "distance", "item_id"))
    return page_after(both, limit, cursor)


def searched(keyword: DataFrame, embed: Callable[[], list[float]], vector: Callable[[list[float]], DataFrame], limit: int, cursor: tuple[float, int] | None = None) -> tuple[DataFrame, str]:
    """A page of both rankings, or of the keyword ranking alone where the query's vector cannot be had; and which tier it is.

    Whatever keeps the embedder from answering (no budget, no network, too slow), the
    answer is what keywords find, now, and a warning.
    """
    try:
        return hybrid(keyword, vector(embed()), limit, cursor), "hybrid"
    except Exception as e:  # noqa: BLE001  any failure of a provider is answered alike
        logger.warning("no query vector, keyword results only: %s", e)
        own = fused(ranked(keyword.orderBy("rank", "item_id").limit(POOL), "fts", "rank", "item_id"))
        return page_after(own, limit, cursor), "fts"


def groundedness(items: Column, keyword_hits: Column, best_distance: Column, ceiling: float = 1.1) -> Column:
    return (items > 0) & ((keyword_hits > 0) | F.coalesce(best_distance <= ceiling, F.lit(False)))
