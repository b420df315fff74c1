"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every run of ``GRAM`` words has a hash; of each ``WINDOW - GRAM + 1`` neighbouring
ones the smallest is kept, so any ``WINDOW`` words that a document and an item
share give both the same fingerprint. Documents whose fingerprints meet an item's
are taken further: each of their windows is joined with the items' windows on the
fingerprint and on its words, and the hits are laid over each other.

Items shorter than a window have no such guarantee. Each of their lengths (nine at
most) is looked up by the hash of the whole run instead, which misses none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexilake.llm.common import unused, written

WINDOW, GRAM = 10, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed by the contract: a word is a run of digits, a-z and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; all-ASCII texts take the faster way to the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text; null and wordless texts have none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _starts(n: Column, size: int) -> Column:
    """0-based starts of the runs of ``size`` among ``n``."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def _runs(words: Column, n: Column, size: int) -> Column:
    """The words of each run of ``size``, joined by spaces."""
    return F.transform(_starts(n, size), lambda i: F.array_join(F.slice(words, i + 1, size), " "))


def _hashed(runs: Column, size: Column) -> Column:
    """The fingerprint of runs shorter than a window."""
    return F.transform(runs, lambda r: F.xxhash64(size, r))


def with_fingerprints(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Add ``n_words`` and ``fp``, the winnowed hash of each full window of ``words``, by start."""
    hashed = texts.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("words"))
    grams = hashed.withColumn("_g", F.transform(_starts(F.col("n_words"), gram), lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(gram)])))
    at = lambda i: F.least(*[F.get("_g", i + j) for j in range(window - gram + 1)])
    return grams.withColumn("fp", F.transform(_starts(F.col("n_words"), window), at)).drop("_h", "_g")


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Each distinct window of each item: item, size, fp, run (its words). A null item id is the empty string; items without words have none."""
    words = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("words"))
    known = with_fingerprints(words, window)
    full = known.where(F.col("n_words") >= window).select("item", F.lit(window).alias("size"), F.explode(F.arrays_zip("fp", _runs(F.col("words"), F.col("n_words"), window).alias("run"))).alias("w"))
    whole = F.array_join("words", " ")
    short = known.where(F.col("n_words").between(1, window - 1)).select("item", F.col("n_words").alias("size"), F.xxhash64("n_words", whole).alias("fp"), whole.alias("run"))
    return full.select("item", "size", "w.fp", "w.run").unionByName(short).distinct()


def _key(text_col: str) -> Column:
    """What tells distinct texts apart; null is the empty text."""
    return F.md5(F.coalesce(text_col, F.lit("")).cast("binary"))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """key (MD5 of the text), n_hit and the sorted items of each distinct text that has a hit."""
    items = written(item_windows(benchmark, item_col, item_text), "item-windows")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # ten at most
    keyed = docs.select(_key(text_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("said"))
    worded = keyed.select("key", words_of(F.col("said")).alias("words"))
    known = with_fingerprints(worded)
    marks = F.array_distinct(F.concat(F.col("fp"), *[_hashed(_runs(F.col("words"), F.col("n_words"), s), F.lit(s)) for s in sizes if s < WINDOW]))
    meets = items.select(F.col("fp").alias("mark")).distinct()
    suspects = written(known.select("key", F.explode(marks).alias("mark")).join(meets, "mark", "left_semi").select("key").distinct(), "suspects")

    texts = keyed.join(suspects, "key", "left_semi").groupBy("key").agg(F.first("said").alias("said"))
    near = with_fingerprints(texts.select("key", words_of(F.col("said")).alias("words")))
    n = F.col("n_words")

    def windows(size: int) -> DataFrame:
        run = _runs(F.col("words"), n, size)
        fp = F.col("fp") if size == WINDOW else _hashed(run, F.lit(size))
        found = near.select("key", F.posexplode(F.arrays_zip(fp.alias("fp"), run.alias("run"))).alias("at", "w"))
        return found.select("key", "at", F.lit(size).alias("size"), "w.fp", "w.run")

    if sizes:
        hits = reduce(DataFrame.unionByName, [windows(s) for s in sizes]).join(items, ["size", "fp", "run"])
        spans = F.array_sort(F.collect_set(F.struct("at", "size")))
        laid = F.aggregate(
            spans,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, s: F.struct(
                F.greatest(acc["end"], s["at"] + s["size"]).alias("end"),
                (acc["n"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(acc["end"], s["at"]))).alias("n"),
            ),
            lambda acc: acc["n"],
        )
        found = hits.groupBy("key").agg(laid.cast("bigint").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
        return written(found, "contaminated")
    return items.select(F.lit("").alias("key"), F.lit(0).cast("bigint").alias("n_hit"), F.array("item").alias("items"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit, all columns whatever their names; null texts have none.

    Repeated rows stay or go together; an empty benchmark takes nothing away.
    """
    found = contaminated_texts(docs, benchmark, text_col, item_col, item_text)
    own = unused(docs, "text_key")
    keyed = docs.withColumn(own, _key(text_col))
    return keyed.join(found, keyed[own] == found["key"], "left_anti").drop(own)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts and texts without words have no hits; ``items_sha256`` of no items is
    that of the empty string. The figures depend on the text alone, so copies are
    worked out once; repeated rows and null ids are each returned. Other columns of
    either table are not looked at; an empty benchmark contaminates nothing.
    """
    found = contaminated_texts(docs, benchmark, text_col, item_col, item_text)
    count = F.regexp_count(ascii_lower(F.coalesce(text_col, F.lit(""))), F.lit(WORD)).cast("bigint")
    out = docs.select(id_col, _key(text_col).alias("text_key"), count.alias("n_words"))
    out = out.join(found, F.col("key") == F.col("text_key"), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        id_col,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(items_of).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
