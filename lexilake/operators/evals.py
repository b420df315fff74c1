"""Scores of retrieval and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexilake.functions import text as T
from lexilake.functions import vectors as V


def context_precision(ranked: DataFrame, group: str = "query_id") -> DataFrame:
    """Mean over the hits of hits so far by rank (``rn``, ``relevant``); 0 without a hit."""
    w = W.partitionBy(group).orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    scored = ranked.withColumn("p", F.sum(F.col("relevant").cast("int")).over(w) / F.col("rn"))
    return scored.groupBy(group).agg(F.coalesce(F.avg(F.when(F.col("relevant"), F.col("p"))), F.lit(0.0)).alias("precision"))


def recall(ranked: DataFrame, relevant: DataFrame, group: str = "query_id") -> DataFrame:
    """Share of the relevant (``group``, item_id) that was found, for each group of either; 1 for a group without any relevant."""
    found = relevant.join(ranked.select(group, "item_id").distinct().withColumn("hit", F.lit(1)), [group, "item_id"], "left")
    shares = found.groupBy(group).agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
    every = ranked.select(group).unionByName(relevant.select(group)).distinct()
    return every.join(shares, group, "left").select(group, F.coalesce("recall", F.lit(1.0)).alias("recall"))


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words of ``a`` that ``b`` has; 0 if there are none."""
    own, other = F.array_distinct(T.index_tokens(a)), F.array_distinct(T.index_tokens(b))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, other)) / F.size(own))


def grounded_share(answers: DataFrame, sources: DataFrame, least: float = 0.1) -> DataFrame:
    """Share of cited sentences that overlap one of their sources by more than ``least``: answer_id, grounded.

    answers: answer_id, text. sources: answer_id, n, body. Sentences are exploded
    with their citations and meet their sources by an equi-join.
    """
    said = answers.select("answer_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    cited = said.select("answer_id", "pos", "sentence", F.explode(T.citations(F.col("sentence"))).alias("n"))
    met = cited.join(sources, ["answer_id", "n"], "left")
    each = met.groupBy("answer_id", "pos").agg(F.max(F.coalesce(overlap(F.col("sentence"), F.col("body")), F.lit(0.0))).alias("best"))
    return each.groupBy("answer_id").agg(F.avg((F.col("best") > least).cast("double")).alias("grounded"))


def mention_coverage(text: Column, wanted: Column) -> Column:
    """Share of the wanted phrases in the text, whatever their case; 1 if nothing is wanted."""
    there = F.size(F.filter(wanted, lambda m: F.lower(text).contains(F.lower(m))))
    return F.when(F.size(wanted) == 0, 1.0).otherwise(there / F.size(wanted))


def answer_relevancy(query: Column, answer: Column) -> Column:
    """Cosine similarity of two vectors, held within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), V.cosine_similarity(query, answer)))


def faithfulness(has_marker: Column, valid: Column, grounded: Column, coverage: Column) -> Column:
    return (has_marker.cast("double") + valid.cast("double") + F.coalesce(grounded, F.lit(0.0)) + coverage) / 4


def declined_score(grounded: Column, refusal: Column, has_marker: Column, valid: Column) -> Column:
    """Where nothing that is stored answers the question: 1 for an answer that says so and cites nothing that is not there."""
    return ((~grounded | refusal) & ~(has_marker & ~valid)).cast("double")
