"""Quality rules with cross-document line frequency.

One pass over the texts hashes their normalised lines and writes these out. How
many distinct documents of a host carry a line is counted with partial aggregation,
first by document, so that no line or host is one task's work. A second pass judges
each text: its own figures, and the lines above the limit, which are removed from
every document of the host but its first; a document that lost most of its words is
rejected.

The lines above the limit are few: each is in more than a hundred documents. While
their number, which is looked at, is small, every task holds them and the texts are
not shuffled; beyond it each text is joined with its own lines. Both ways end in
the same function.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.llm.common import unused, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A document fails if more than this share of its words lies in repeated 3-word windows.
MAX_REPEAT_PERCENT = 50
#: A line is boilerplate if more distinct documents than this have it in one host.
MAX_DOCUMENTS_PER_LINE = 100
#: A document is depleted if it loses more than this share of its words.
MAX_REMOVED = 0.7
#: Up to so many lines above the limit are held by every task; beyond it the texts are joined with theirs.
HELD_LINES = 100_000
SEED = 42
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_drop_symbols = str.maketrans("", "", SYMBOLS)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def text_figures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    raw = text.encode()
    words = raw.split()  # bytes split and count as space exactly x20 and x09-x0D
    chars = len(text) - len(raw) + sum(map(len, words))
    n_symbols = len(text) - len(text.translate(_drop_symbols)) if any(c in text for c in SYMBOLS) else 0
    seen, n_dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            n_dup += 1
        elif line and not line.isspace():
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    n_repeat = 0
    if len(set(windows)) < len(windows):
        count = Counter(windows)
        end = 0
        for at, window in enumerate(windows):
            if count[window] > 1:
                n_repeat += at + 3 - max(at, end)
                end = at + 3
    return len(words), chars, n_symbols, n_dup, n_repeat




def fails(n_words: int, n_repeat_words: int) -> bool:
    """The base rules."""
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def normal_lines(raw: bytes) -> Iterator[tuple[bytes, int, int | None]]:
    """Each line of a text, the number of its words, and the hash of its normalised form (None without words)."""
    for line in raw.split(b"\n"):
        parts = line.lower().split()
        yield line, len(parts), _signed(xxhash.xxh64_intdigest(b" ".join(parts), SEED)) if parts else None


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each distinct normalised line with words: id, host, text_hash (``xxhash64`` of the text), line_hash."""
    kind, host = (docs.schema[c].dataType.simpleString() for c in (id_col, host_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts, lines = [], [], []
            for row, text in enumerate(batch.column(1)):
                raw = (text.as_py() or "").encode()
                own = {h for _, _, h in normal_lines(raw) if h is not None}
                at += [row] * len(own)
                texts += [_signed(xxhash.xxh64_intdigest(raw, SEED))] * len(own)
                lines += own
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(2).take(taken), pa.array(texts, pa.int64()), pa.array(lines, pa.int64())], ["id", "host", "text_hash", "line_hash"])

    return docs.select(id_col, text_col, host_col).mapInArrow(run, f"id {kind}, host {host}, text_hash bigint, line_hash bigint")


def frequent_lines(lines: DataFrame, most: int = MAX_DOCUMENTS_PER_LINE) -> DataFrame:
    """Lines above the limit: host, line_hash, first_id, n_documents.

    Documents are told apart by their ids; rows that repeat one, and a line that one
    has twice, count once, and rows without an id do not count. Null hosts are one
    host. ``first_id`` is the smallest id with the line; there the line stays.
    """
    each = lines.where(F.col("id").isNotNull()).groupBy("host", "line_hash", "id").agg(F.lit(1).alias("one"))
    return each.groupBy("host", "line_hash").agg(F.min("id").alias("first_id"), F.sum("one").alias("n_documents")).where(F.col("n_documents") > most)


def lost_lines(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """What each row of a document loses: id, host, text_hash, lost (hashes of lines). Null ids lose nothing."""
    named = frequent.select(F.col("host").alias("f_host"), F.col("line_hash").alias("f_line"), "first_id")
    hit = lines.join(named, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line_hash") == F.col("f_line"))).where(F.col("id") != F.col("first_id"))
    return hit.groupBy("id", "host", "text_hash").agg(F.collect_set("line_hash").alias("lost"))


def without_lines(text: str, gone: set[int]) -> tuple[str, int]:
    """The text without the lines whose hash is in ``gone``, and the number of words they had."""
    kept, n = [], 0
    for line, words, h in normal_lines(text.encode()):
        if h in gone:
            n += words
        else:
            kept.append(line)
    return b"\n".join(kept).decode() if n else text, n


Judge = Callable[[pa.RecordBatch, int], set[int]]


def _with_losses(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> tuple[DataFrame, Judge]:
    """``docs``, maybe with a last column more, and what tells the lines that a row of a batch of it loses."""
    lines = written(document_lines(docs, id_col, text_col, host_col), "lines")
    frequent = written(frequent_lines(lines), "frequent-lines")
    id_at, host_at = docs.columns.index(id_col), docs.columns.index(host_col)
    if frequent.count() <= HELD_LINES:
        of_host: dict = {}
        for r in frequent.collect():  # no more than HELD_LINES
            of_host.setdefault(r["host"], {})[r["line_hash"]] = r["first_id"]
        held = docs.sparkSession.sparkContext.broadcast(of_host)

        def by_table(batch: pa.RecordBatch, row: int) -> set[int]:
            own, id_ = held.value.get(batch.column(host_at)[row].as_py()), batch.column(id_at)[row].as_py()
            return {h for h, first in own.items() if first != id_} if own and id_ is not None else set()

        return docs, by_table

    names = {n: unused(docs, f"lost_{n}") for n in ("id", "host", "text_hash", "lost")}
    lost = lost_lines(lines, frequent).withColumnsRenamed(names)
    same = (docs[id_col] == lost[names["id"]]) & docs[host_col].eqNullSafe(lost[names["host"]]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == lost[names["text_hash"]])
    met = docs.join(lost, same, "left").select(*[docs[c] for c in docs.columns], lost[names["lost"]])
    return met, lambda batch, row: set(batch.column(batch.num_columns - 1)[row].as_py() or ())


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Each row's figures, ``base_failed``, ``n_removed`` (words of lines above the limit), ``depleted`` and ``kept``.

    Null text has no words and so fails. Rows that repeat an id are judged each by
    its own text. Other columns are not looked at. An empty table gives an empty
    result. A very long text costs time and memory of its task in proportion to its
    length.
    """
    own = docs.select(id_col, text_col, host_col)
    met, lost = _with_losses(own, id_col, text_col, host_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, text in enumerate(batch.column(1)):
                said = text.as_py() or ""
                figures = text_figures(said)
                n_removed = without_lines(said, gone)[1] if (gone := lost(batch, row)) else 0
                failed, depleted = fails(figures[0], figures[4]), n_removed > MAX_REMOVED * figures[0]
                rows.append((*figures, n_removed, failed, depleted, not failed and not depleted))
            columns = [pa.array(c, pa.bool_() if k > 5 else pa.int64()) for k, c in enumerate(zip(*rows))] if rows else [pa.array([], pa.bool_() if k > 5 else pa.int64()) for k in range(9)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, *FIGURES, "n_removed", "base_failed", "depleted", "kept"])

    return met.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} bigint" for n in (*FIGURES, "n_removed")) + ", base_failed boolean, depleted boolean, kept boolean")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, all columns, their texts without the lines above the limit.

    A line above the limit stays, with its repeats, in the first document of the
    host that has it. ``chars_col``, where there is one, follows the text. Rows
    with a null id lose no lines. Columns of other names go through as they are.
    """
    names = docs.columns
    text_at, chars_at = names.index(text_col), names.index(chars_col) if chars_col in names else None
    met, lost = _with_losses(docs, id_col, text_col, host_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts, sizes = [], [], []
            for row, text in enumerate(batch.column(text_at)):
                said = text.as_py() or ""
                figures = text_figures(said)
                keep.append(not fails(figures[0], figures[4]))
                if keep[-1]:
                    rest, n_removed = without_lines(said, gone) if (gone := lost(batch, row)) else (said, 0)
                    keep[-1] = n_removed <= MAX_REMOVED * figures[0]
                    if keep[-1]:
                        texts.append(rest)
                        sizes.append(len(rest) if n_removed else None)
            columns = batch.filter(pa.array(keep, pa.bool_())).columns[: len(names)]
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if chars_at is not None:
                columns[chars_at] = pa.array([n if n is not None else x.as_py() for n, x in zip(sizes, columns[chars_at])], columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return met.mapInArrow(run, docs.schema)
