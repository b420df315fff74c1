"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in order of rank, into gadgets. The gadget of a merge
``(a, b) -> c`` takes away the path ``a b`` and adds the arc ``c`` wherever that
path was: ``c`` can follow what ``a`` could follow, and can be followed by what
could follow ``b``. So a word has exactly one path of arcs, and so has each prefix
of it: its encoding.

Over bytes this is a deterministic automaton. Its state after a prefix is the
longest end of the prefix that begins some token, with the last tokens of the
prefixes that stop inside that end or at its start; with the next byte exactly one
token ends there that may follow the last token before it, by the gadgets. The
table is kept in two factors, as the product would have more states than any corpus
visits: by end and byte, the next end and the tokens that end there; by two tokens,
whether the gadgets leave the second behind the first. Entries are made when they are
first asked for, and their number is bounded. A word then costs a lookup or a few a
byte, and its arcs are read off backwards from its last state. Decoding emits the
labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed: the pre-splitting pattern of byte-level vocabularies of this family.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same split of a text that is all ASCII, for the faster of the two engines.
ASCII_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
#: Words whose encoding a worker keeps; beyond it the table starts anew.
CACHED_WORDS = 250_000
CACHED_CHARS = 200
#: Entries of each factor of the table that a worker keeps; beyond it that factor starts anew.
CACHED_ENTRIES = 400_000
ALIVE = 1 << 30
BYTES = [bytes((b,)) for b in range(256)]


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Read a tokenizer file on the driver into plain, small tables to ship. Any but a plain byte-level BPE is refused."""
    with open(path, "rb") as f:
        raw = f.read()
    said = json.loads(raw)
    split, model = said.get("pre_tokenizer") or {}, said["model"]
    known = said.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not known or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError(f"{path} is not a plain byte-level vocabulary, the only kind that is read")
    symbols, vocab = byte_symbols(), said["model"]["vocab"]
    labels: dict[int, bytes] = {i: bytes(symbols[c] for c in t) for t, i in vocab.items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
    return {
        "digest": hashlib.sha256(raw).hexdigest(),
        "labels": labels,
        "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges],
        "special": {t["content"]: t["id"] for t in said.get("added_tokens", [])},
    }


class Words(dict):
    """Encodings of the words met so far; long ones are not kept."""

    def __init__(self, walk):
        self.walk = walk

    def __missing__(self, word: str) -> tuple[int, ...]:
        path = self.walk(word.encode("utf-8"))
        if len(word) <= CACHED_CHARS:
            self[word] = path
        return path


class End(dict):
    """A row of the table: by byte the next end, and the tokens that end there (length and arc, the longest first)."""

    __slots__ = ("automaton", "text")

    def __init__(self, automaton: Automaton, text: bytes):
        self.automaton, self.text = automaton, text

    def __missing__(self, byte: int) -> tuple[End, list[tuple[int, int]]]:
        to = self[byte] = self.automaton.transition(self.text + BYTES[byte])
        return to


class Follows(dict):
    """By two arcs whether the gadgets leave the second behind the first."""

    def __init__(self, path):
        self.path = path

    def __missing__(self, arcs: tuple[int, int]) -> bool:
        if len(self) >= CACHED_ENTRIES:
            self.clear()
        good = self[arcs] = self.path(*arcs, ALIVE)
        return good


class Automaton:
    def __init__(self, tables: dict):
        labels = tables["labels"]
        self.special: dict[str, int] = tables["special"]
        self.label = {**labels, **{i: t.encode() for t, i in self.special.items()}}
        self.name = {i: str(i) for i in self.label}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {i: -1 for i in labels}
        self.gone: dict[tuple[int, int], int] = {}
        live = {i for i, b in labels.items() if len(b) == 1}
        for rank, (a, b, c) in enumerate(tables["merges"]):
            self.gone.setdefault((a, b), rank)
            if c in self.parts:
                continue
            self.parts[c], self.born[c] = (a, b), rank
            if a in live and b in live and self._path(a, b, rank):
                live.add(c)
        self.arc_of = {labels[i]: i for i in live}
        self.begins = {t[:k] for t in self.arc_of for k in range(len(t))}
        self.sizes = {i: len(b) for i, b in labels.items()}
        self.follows = Follows(self._path)
        self._clear()
        self.words = Words(self.walk)
        self.ascii_split = re.compile(ASCII_WORDS).findall
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.word_split = regex.compile(WORDS)

    def _path(self, x: int, y: int, rank: int) -> bool:
        """Whether y can follow x just before the merge of this rank."""
        while True:
            if self.gone.get((x, y), ALIVE) < rank:
                return False
            bx, by = self.born[x], self.born[y]
            if bx < 0 and by < 0:
                return True
            if by >= bx:  # the arc y copied the arcs into its left part, after their removal
                y, rank = self.parts[y][0], by + 1
            else:  # the state behind x copied the arcs out of its right part, before their removal
                x, rank = self.parts[x][1], bx

    def _clear(self) -> None:
        self.start, self.entries = End(self, b""), 0
        self.rows = {b"": self.start}

    def transition(self, grown: bytes) -> tuple[End, list[tuple[int, int]]]:
        """Behind what was read of a word: its longest end that begins some token, and the tokens that end there."""
        if self.entries >= CACHED_ENTRIES:  # inside a word too: what was read so far needs none of them
            self._clear()
        self.entries += 1
        ends = [(len(grown) - k, arc) for k in range(len(grown)) if (arc := self.arc_of.get(grown[k:])) is not None]
        cut = next(k for k in range(len(grown) + 1) if grown[k:] in self.begins)
        end = grown[cut:]
        to = self.rows.get(end)
        if to is None:
            to = self.rows[end] = End(self, end)
        return to, ends

    def walk(self, word: bytes) -> tuple[int, ...]:
        """The labels of the one path that spells the word."""
        row, follows, sizes = self.start, self.follows, self.sizes
        arcs, at = [-1], 0
        for byte in word:
            row, ends = row[byte]
            at += 1
            for size, arc in ends:
                last = arcs[at - size]
                if last < 0 or follows[last, arc]:
                    break
            else:
                raise ValueError("no path spells the word: the vocabulary lacks a byte of it")
            arcs.append(arc)
        path = []
        while at:
            arc = arcs[at]
            path.append(arc)
            at -= sizes[arc]
        path.reverse()
        return tuple(path)

    def encode(self, text: str) -> list[int]:
        words = self.words
        if len(words) > CACHED_WORDS:
            words.clear()
        split = self.ascii_split if text.isascii() else self.word_split.findall
        if not any(x in text for x in self.special):
            return list(chain.from_iterable(map(words.__getitem__, split(text))))
        ids: list[int] = []
        for k, piece in enumerate(self.special_split.split(text)):
            ids += [self.special[piece]] if k % 2 else chain.from_iterable(map(words.__getitem__, split(piece)))
        return ids

    def release(self) -> None:
        """Let go of the words and entries met, so that a worker does not hold them through the tasks of other stages."""
        self.words.clear()
        self.follows.clear()
        self._clear()

    def decode(self, ids: Iterable[int]) -> str:
        """Emit the arcs' labels; ids that name no arc are left out."""
        label = self.label
        return b"".join([label[i] for i in ids if i in label]).decode("utf-8", "replace")


_made: dict[str, Automaton] = {}


def _automaton(shipped) -> Automaton:
    """One automaton for each worker process and vocabulary."""
    tables = shipped.value
    if (key := tables["digest"]) not in _made:
        _made.clear()
        _made[key] = Automaton(tables)
    return _made[key]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode each whole text; one row for each row of ``docs``.

    Returns ``id_col``, ``ids`` (array, where ``with_ids``), ``n_tokens``,
    ``ids_sha256`` (of the decimal ids joined by commas) and ``decoded_sha256``
    (of the text decoded again from the ids). Null text is encoded as the empty
    text: no ids, digests of the empty string. A null id stays null; repeated
    rows are each encoded; other columns of ``docs`` are not looked at, so their
    names cannot clash. A very long text costs time in proportion; the table of
    known words is bounded.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _automaton(shipped)
        try:
            yield from encoded(made, batches)
        finally:
            made.release()

    def encoded(made: Automaton, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = made.name
        for batch in batches:
            out: dict[str, list] = {"ids": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in batch.column(1):
                ids = made.encode(text.as_py() or "")
                if with_ids:
                    out["ids"].append(pa.array(ids, pa.int32()))
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join([name[i] for i in ids]).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(made.decode(ids).encode("utf-8")).hexdigest())
            columns = [batch.column(0)]
            if with_ids:
                sizes = pa.array([0, *[len(x) for x in out["ids"]]], pa.int32())
                offsets = pa.compute.cumulative_sum(sizes)
                columns.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(out["ids"]) if out["ids"] else pa.array([], pa.int32())))
            columns += [pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"]), pa.array(out["decoded_sha256"])]
            names = [id_col, *["ids"] * with_ids, "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, " + "ids array<int>, " * with_ids + "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each row of ids: ``id_col``, ``text``. Null ids give a null text."""
    shipped = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _automaton(shipped)
        for batch in batches:
            texts = [None if ids is None else made.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
