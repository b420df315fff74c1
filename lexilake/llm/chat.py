"""Chat formatting in budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens choose turn-aligned spans. A turn of more than half the
budget is a span of its own; the others go to the half budget in which their
prefix sum ends, so a span of theirs never exceeds the budget. A conversation with
a large part of all rows is summed in blocks of turns first, so no task needs more
than a block of it until its windows, which the budget bounds, are put together.

Every window starts with the conversation's leading system turn, then repeats
earlier turns up to the history limit, then has its own turns. Only the assistant
texts among its own turns are under the loss mask, so each is learned once.

The template marks turns with ``<|start|>role<|text|>text<|end|>``. A control
string inside a role or text, ``<``, any number of backslashes, ``|``, gets one
backslash more; taking one away gives the text back, and other texts are left as
they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexilake.llm.common import whole_number

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: Tokens of a window, of the history it repeats, and of the marks around a turn.
BUDGET, HISTORY, MARKS = 1024, 192, 4
#: Turns of one block of prefix sums.
BLOCK = 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def estimated_tokens(text: Column) -> Column:
    """Four bytes to a token, rounded up."""
    return F.ceil(F.octet_length(text) / 4)


def _numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, seq (0 upwards in order of turn; ties by role, then text; null turns first), role, text, tokens, before (tokens of earlier turns)."""
    own = turns.select(
        F.col(conv).alias("conv"), whole_number(turns, turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    own = own.withColumn("tokens", (estimated_tokens(F.col("text")) + MARKS).cast("bigint")).withColumn("block", F.floor(F.col("turn") / BLOCK))
    blocks = own.groupBy("conv", "block").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    earlier = W.partitionBy("conv").orderBy(F.col("block").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    base = blocks.select(
        F.col("conv").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
    )
    inside = W.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    counted = own.select(
        "*", (F.row_number().over(inside) - 1).alias("i"), (F.sum("tokens").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("tokens")).alias("t"),
    )
    same = F.col("conv").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b"))
    return counted.join(base, same).select("conv", (F.col("n0") + F.col("i")).alias("seq"), "role", "text", "tokens", (F.col("t0") + F.col("t")).alias("before"))


def chat_windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of each conversation: ``conv_col``, window, n_context, n_tokens, formatted, loss.

    ``window`` counts from 0 in order. The first ``n_context`` turns of a window
    repeat earlier ones; ``loss`` are the half-open spans of ``formatted``, in code
    points, that count for the loss. A window is within the budget, unless a single
    turn alone is longer than what the system turn and the history leave of it;
    such a turn is a window by itself, never cut. Null texts and roles are empty;
    null conversation ids are one conversation; repeated rows are turns of their
    own; other columns are not looked at.
    """
    known = _numbered(turns, conv_col, turn_col, role_col, text_col)
    lead = known.where((F.col("seq") == 0) & (F.col("role") == "system")).select(F.col("conv").alias("c"), F.struct("role", "text", "tokens").alias("lead"))
    known = known.join(lead, F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce(F.col("lead.tokens"), F.lit(0)))
    half, last = F.floor(room / 2), F.col("before") + F.col("tokens")
    long = F.col("tokens") > half
    # (half budget, start of a long turn or -1): rises with the turns, so spans are runs of turns
    keyed = known.withColumn("h", F.floor((last - 1) / F.greatest(F.lit(1), half))).withColumn("own", F.when(long, F.col("before")).otherwise(-1))
    spans = keyed.groupBy("conv", "h", "own").agg(
        F.min("before").alias("start"), F.min("seq").alias("first"), F.max("lead").alias("lead"), F.sum("tokens").alias("own_tokens"),
        F.array_sort(F.collect_list(F.struct("seq", "role", "text", "tokens"))).alias("turns"),
    )
    # a turn is history of the spans that start up to `history` tokens behind its start, at or behind its end
    starts = spans.select("conv", "start", "first", F.floor(F.col("start") / history).alias("q")).where("first > 0")
    older = known.select("conv", "seq", "role", "text", "tokens", "before", "lead").where(F.col("lead").isNull() | (F.col("seq") > 0)).where(F.col("tokens") <= history)
    older = older.select("*", F.explode(F.sequence(F.floor((F.col("before") + F.col("tokens")) / history), F.floor((F.col("before") + history) / history))).alias("q")).drop("lead")
    s, o = starts.alias("s"), older.alias("o")
    met = s.join(o, F.col("s.conv").eqNullSafe(F.col("o.conv")) & (F.col("s.q") == F.col("o.q")) & (F.col("o.before") + F.col("o.tokens") <= F.col("s.start")) & (F.col("o.before") + history >= F.col("s.start")))
    past = met.groupBy(F.col("s.conv").alias("pc"), F.col("s.first").alias("pf")).agg(F.array_sort(F.collect_list(F.struct("o.seq", "o.role", "o.text", "o.tokens"))).alias("past"))
    # a turn too long for the history breaks it: what is older than the break is left out
    both = spans.join(past, F.col("conv").eqNullSafe(F.col("pc")) & (F.col("first") == F.col("pf")), "left")
    whole = F.filter(F.coalesce("past", F.array().cast("array<struct<seq:bigint,role:string,text:string,tokens:bigint>>")), lambda t: t["seq"] + F.size("past") - F.array_position(F.transform("past", lambda p: p["seq"]), t["seq"]) + 1 == F.col("first"))
    strip = lambda a: F.transform(a, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens")))
    context = F.concat(F.when(F.col("lead").isNotNull() & (F.col("first") > 0), F.array("lead")).otherwise(F.array().cast("array<struct<role:string,text:string,tokens:bigint>>")), strip(whole))
    laid = both.select("conv", "first", context.alias("context"), strip(F.col("turns")).alias("own"))
    marked = lambda t: F.concat(F.lit(START), escaped(t["role"]), F.lit(TEXT), escaped(t["text"]), F.lit(END))
    every = F.concat(F.transform("context", lambda t: F.struct(marked(t).alias("m"), F.lit(0).alias("skip"), F.lit(-1).alias("size"))), F.transform("own", lambda t: F.struct(
        marked(t).alias("m"), F.length(F.concat(F.lit(START), escaped(t["role"]), F.lit(TEXT))).alias("skip"), F.when(t["role"] == "assistant", F.length(escaped(t["text"]))).otherwise(-1).alias("size"))))
    made = laid.select("conv", "first", F.size("context").alias("n_context"), F.aggregate(F.concat("context", "own"), F.lit(0).cast("bigint"), lambda a, t: a + t["tokens"]).alias("n_tokens"), every.alias("every"))
    loss = F.aggregate(
        "every",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["m"])).alias("at"),
            F.when(t["size"] >= 0, F.concat(a["spans"], F.array(F.struct((a["at"] + t["skip"]).alias("start"), (a["at"] + t["skip"] + t["size"]).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    order = W.partitionBy("conv").orderBy("first")
    return made.select(
        F.col("conv").alias(conv_col), (F.row_number().over(order) - 1).alias("window"), "n_context", "n_tokens",
        F.array_join(F.transform("every", lambda t: t["m"]), "").alias("formatted"), loss.alias("loss"),
    )


def turns_of(formatted: Column) -> Column:
    """Read a window back: its turns as (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda p: p != "")
    body = lambda p: F.substring(p, len(START) + 1, F.length(p))
    parts = F.transform(pieces, lambda p: F.split(body(p), r"<\|text\|>", 2))
    return F.transform(parts, lambda p: F.struct(unescaped(p[0]).alias("role"), unescaped(p[1]).alias("text")))


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of each conversation from its windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = F.slice(turns_of(F.col("formatted")), F.col("n_context") + 1, 1 << 30)
    learned = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    each = windows.select(
        conv_col, "window", F.size(turns).alias("n"), F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join(learned, "").alias("learned"), F.length("formatted").alias("chars"),
    )
    whole = each.groupBy(conv_col).agg(
        F.sum("n").cast("bigint").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "learned"))).alias("w"), F.sum("chars").cast("bigint").alias("formatted_chars"),
    )
    said, learned_all = F.array_join(F.transform("w", lambda x: x["turns"]), ""), F.array_join(F.transform("w", lambda x: x["learned"]), "")
    return whole.select(
        conv_col, "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(learned_all).cast("bigint").alias("loss_chars"),
        F.sha2(learned_all, 256).alias("loss_sha256"), "formatted_chars",
    )
