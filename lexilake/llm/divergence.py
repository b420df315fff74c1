"""Source divergence audit: how far the word shares of a language's sources lie apart.

Terms are counted once, in bytes, with tallies that leave a task already summed, and
meet in one shuffle by language and term. A kept term is a row that holds its sources
with their counts, at most as many as the language has sources. The distance of two
sources is worked out from their joint count histogram: which (count, count)
combinations occur in terms that both have, and in how many terms. What only one of
them has, or none, are implied cells: the histogram of the source's own counts, less
what the joint histogram holds, and the rest of the kept terms. So the function is
evaluated once for each combination, times its multiplicity, and no term that a pair
lacks is ever a row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexilake.llm.common import written

#: A term counts in a language if so many of its documents have it; terms reported for each group.
MIN_DOCUMENTS, TOP_TERMS = 30, 50
#: Shares are whole numbers of this unit, smoothed by so many occurrences a term.
UNIT, SMOOTH = 1_000_000_000, 5
#: Distinct entries that a task tallies, bytes of a text looked at together, pairs of cells looked at together, and parts
#: that the sources of a language are split into where they meet. They change no result.
TALLIED, PIECE, AT_ONCE, PARTS = 200_000, 1 << 20, 2_000_000, 16
#: A-Z to a-z; letters and all bytes beyond ASCII stay, everything else ends a term.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, in lists for about a megabyte each; a term is never cut."""
    text = text.translate(_LETTERS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by lang, source and term: of what the task has seen since it last gave rows."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            words = list(n)
            text = pa.array(words, pa.binary()).cast(pa.string())
            columns = [pa.array([lang] * len(words), pa.string()), pa.array([source] * len(words), pa.string()), text, pa.array(n.values(), pa.int64()), pa.array([docs[w] for w in words], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        lang, source = (batch.column(i).to_pylist() for i in (0, 1))
        for k, text in enumerate(batch.column(2)):
            n, docs = held.setdefault((lang[k], source[k]), (Counter(), Counter()))
            own: set[bytes] = set()
            for piece in terms(text.as_py()):
                n.update(piece)
                own.update(piece)
            docs.update(own)
            if k % 64 == 0 and sum(len(n) for n, _ in held.values()) > TALLIED:
                yield from out()
    yield from out()


def kept_terms(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``lang``, ``term``, occurrences ``n`` and ``held`` (source and its occurrences), for terms in enough documents of a language."""
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    tallied = clean.mapInArrow(_tallies, "lang string, source string, term string, n bigint, docs bigint")
    # one shuffle: both group-bys find their rows together
    counted = tallied.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    met = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("held"))
    return met.where(F.col("docs") >= min_documents).drop("docs")


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source a < source b, their counts, and the number of the batch's terms in which both have them."""
    for batch in batches:
        held = batch.column(1)
        size = np.diff(held.offsets.to_numpy())
        cells = held.flatten()
        langs, sources = batch.column(0).dictionary_encode(), cells.field("source").dictionary_encode()
        names, code = np.unique(np.array(sources.dictionary.to_pylist(), object), return_inverse=True)
        code, count = code[sources.indices.to_numpy()], cells.field("n").to_numpy()
        term = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((code, term))
        code, count = code[order], count[order]
        lang = langs.indices.to_numpy()[term]
        later = np.repeat(np.cumsum(size), size) - np.arange(len(term)) - 1  # cells of the same term behind this one
        done = np.concatenate([[0], np.cumsum(later)])
        at = 0
        while at < len(term):
            end = max(at + 1, int(np.searchsorted(done, done[at] + AT_ONCE, "right")) - 1)
            i = np.repeat(np.arange(at, end), later[at:end])
            j = i + 1 + np.arange(len(i)) - (done[at:end] - done[at])[i - at]
            keys = (count[j], count[i], code[j], code[i], lang[i])
            order = np.lexsort(keys)
            keys = [k[order] for k in keys]
            new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])) if len(i) else np.zeros(0, int)
            cb, ca, b, a, of = (k[new] for k in keys)
            many = np.diff(np.append(new, len(i)))
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(of)).cast(pa.string()), pa.array(names[a], pa.string()), pa.array(names[b], pa.string()), pa.array(ca), pa.array(cb), pa.array(many, pa.int64())],
                ["lang", "a", "b", "ca", "cb", "m"],
            )
            at = end


def _share(count: str, total: str) -> str:
    """SQL of a term's share: whole numbers throughout, decimals only where a long does not hold the product."""
    whole = f"greatest(1, {total} + {SMOOTH} * kept)"
    return f"(1 + if({count} < 9000000000, ({UNIT} * ({count} + {SMOOTH})) div {whole}, cast({UNIT} as decimal(10, 0)) * cast({count} + {SMOOTH} as decimal(20, 0)) div cast({whole} as decimal(20, 0))))"


def _f(ca: str, cb: str) -> str:
    return f"abs({_share(ca, 'a_total')} - {_share(cb, 'b_total')})"


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: sums of absolute differences to each other source, and the terms above the language's share.

    ``pair``: every other source of the language, value the distance over all kept
    terms, all ranks. ``term``: the ``top_terms`` terms of the group whose share is
    above the language's, value the difference. Ranks go by value downwards, then by
    item in byte order. Null lang, source and text count as empty; repeated rows are
    documents each; a group without terms has all its pairs; a language of one source
    has no pair; without kept terms values are 0; an empty table gives no rows. Other
    columns are not read.
    """
    found = written(kept_terms(docs, min_documents), "divergence-terms", batch_bytes=8 << 20)
    cells = found.select("lang", "term", F.col("n").alias("lang_n"), F.explode("held").alias("x")).select("lang", "term", "lang_n", "x.source", "x.n")
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    histogram = cells.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    own = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("total"), F.collect_list(F.struct("n", "m")).alias("counts"))
    of_lang = found.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("kept"))
    groups = occurring.join(own, ["lang", "source"], "left").join(of_lang, "lang", "left")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("total", "lang_total", "kept")]
    groups = written(groups.select("lang", "source", *zero, F.coalesce("counts", F.array().cast(groups.schema["counts"].dataType)).alias("counts")), "divergence-groups")

    above = cells.join(groups.drop("counts"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), F.expr(f"{_share('n', 'total')} - {_share('lang_n', 'lang_total')}").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    term = above.where("value > 0").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)

    joint = found.select("lang", "held").mapInArrow(_joint, "lang string, a string, b string, ca bigint, cb bigint, m bigint")
    joint = joint.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))
    totals = [groups.select("lang", F.col("source").alias(x), F.col("total").alias(f"{x}_total"), *["kept"] * (x == "a")) for x in "ab"]
    # a combination that both have is no implied cell of either, so these are taken back
    both = joint.join(totals[0], ["lang", "a"]).join(totals[1], ["lang", "b"])
    both = both.groupBy("lang", "a", "b").agg(F.sum(F.expr(f"m * ({_f('ca', 'cb')} - {_f('ca', '0L')} - {_f('0L', 'cb')} + {_f('0L', '0L')})")).alias("shared"))
    side = lambda x, *more: groups.select("lang", F.col("source").alias(x), F.col("total").alias(f"{x}_total"), *more)
    left = side("a", "kept", F.pmod(F.hash("source"), F.lit(PARTS)).alias("part"))
    right = side("b", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    pairs = left.join(right, ["lang", "part"]).where("a < b").select("lang", "a", "b", "a_total", "b_total", "kept")
    # a source's counts meet its pairs, and only sums go on
    for x, f in (("a", _f("c.n", "0L")), ("b", _f("0L", "c.n"))):
        own = groups.select("lang", F.col("source").alias(x), "counts")
        sums = [F.expr(f"aggregate(counts, 0L, (s, c) -> s + c.m * {f})").alias(f"{x}_alone"), F.expr("aggregate(counts, 0L, (s, c) -> s + c.m)").alias(f"{x}_terms")]
        pairs = pairs.join(own, ["lang", x]).select(*pairs.columns, *sums)
    pairs = pairs.join(both, ["lang", "a", "b"], "left")
    value = F.expr(f"coalesce(shared, 0) + a_alone + b_alone + (kept - a_terms - b_terms) * {_f('0L', '0L')}")
    pairs = pairs.select("lang", "a", "b", value.alias("value"))
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    pair = pairs.select("lang", "x.source", "x.item", "value").withColumn("rank", F.row_number().over(by_value))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("bigint").alias("value"), F.col("rank").cast("int").alias("rank"))
    return columns(pair, "pair").unionByName(columns(term, "term"))
