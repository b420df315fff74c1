"""Context for retrieval-augmented answers: candidates, token budget, citations, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexilake.functions import text as T

ITEMS, CHUNKS, BUDGET = 6, 8, 6000


def leading_chunks(chunks: DataFrame, most: int = CHUNKS) -> DataFrame:
    """The first chunks of each item by position."""
    return chunks.withColumn("rn", F.row_number().over(W.partitionBy("item_id").orderBy("ord"))).where(F.col("rn") <= most).drop("rn")


def joined_chunks(chunks: DataFrame, by: str = "item_id") -> DataFrame:
    """Each item's chunks in order, trimmed, with a blank line between."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: T.js_trim(x["text"])), "\n\n")
    return chunks.groupBy(by).agg(body.alias("body"))


def within_budget(candidates: DataFrame, budget: int = BUDGET, group: str = "query_id", order: str = "rank") -> DataFrame:
    """Which candidates (``group``, ``order``, ``tokens``) fit: adds used, included, clipped, source.

    The first that does not fit ends it, except that a first candidate is clipped
    instead. Tokens are not negative, so the running sum alone says it.
    """
    w = W.partitionBy(group).orderBy(order)
    used = F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, 0))
    first = F.row_number().over(w) == 1
    out = candidates.withColumn("used", used).withColumn("clipped", first & (F.col("used") > budget)).withColumn("included", F.col("clipped") | (F.col("used") <= budget))
    return out.withColumn("source", F.when(F.col("included"), F.row_number().over(w)))


def context_block(source: Column, title: Column, kind: Column, body: Column) -> Column:
    return F.concat(F.lit("Source ["), source.cast("string"), F.lit(']: "'), title, F.lit('" ('), kind, F.lit(")\n"), T.untrusted(body))


def prompt(scope: Column, blocks: Column, question: Column) -> Column:
    return F.array_join(F.filter(F.concat(F.array(scope), blocks, F.array(question)), lambda x: x.isNotNull() & (x != "")), "\n\n")


def last_turns(messages: DataFrame, most: int) -> DataFrame:
    """The last turns of each conversation, oldest first: adds pos."""
    back = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = messages.withColumn("rn", F.row_number().over(back)).where(F.col("rn") <= most)
    return kept.withColumn("pos", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("bigint")).drop("rn")


def answer_decision(valid1: Column, refusal1: Column, valid2: Column, refusal2: Column) -> Column:
    """grounded, ungrounded, or failed after one corrective attempt."""
    return F.when(valid1, "grounded").when(refusal1, "ungrounded").when(valid2, "grounded").when(refusal2, "ungrounded").otherwise("failed")


def strategy(supported: Column) -> Column:
    """How a model is asked for structured output."""
    return F.when(F.array_contains(supported, "structured_outputs"), "response_format").when(F.array_contains(supported, "tools"), "tool_call").otherwise("prompt_repair")


def routed(tokens: Column, reserve: int, context: Column) -> Column:
    return F.when(tokens + reserve <= context, "primary").otherwise("fallback")


def first_success(attempts: DataFrame, call: str = "call_id") -> DataFrame:
    """Ordered failover over recorded attempts (attempt, ok, result): the first that worked, and the units spent up to it."""
    won = attempts.groupBy(call).agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("won"), F.max("attempt").alias("tried"), F.min_by(F.when(F.col("ok"), F.col("result")), F.when(F.col("ok"), F.col("attempt"))).alias("result"))
    return won.select(call, F.coalesce("won", "tried").alias("units"), F.col("won").isNotNull().alias("ok"), "result")
