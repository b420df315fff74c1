"""Exact removal of repeated passages with a logarithmic family of suffix arrays.

A byte goes if some string of ``SPAN`` bytes around it starts earlier too. Every
such string holds an anchor, its k-gram of smallest hash (the leftmost on ties), at
a place that depends on its bytes alone; strings with one anchor in a row are a
run. So equal strings meet under equal anchors, and the suffixes of the corpus can
be dealt out by anchor: each partition is an index family of its own.

1. Anchors are counted. One that occurs once cannot repeat anything; most do not.
2. The texts' other runs are sent to their anchors with the bytes they need. Of the
   equal ones in a task only the earliest is sent, so a passage with a third of all
   documents costs each task one row.
3. A partition takes its runs in order of document and place, batch by batch. Each
   new batch gets its suffix array (the suffixes at string starts, in the order of
   their first ``SPAN`` bytes), which is merge-scanned against every existing level
   for strings that are there already; then it becomes a level, and levels of
   about equal size are merged, so there are logarithmically many.
4. What is covered is laid over each other and cut out.

The texts are shuffled once, by document; all steps read that one exchange.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.llm.common import partition_keys, whole_number

SPAN, GRAM = 100, 40
#: Bytes of text that are looked at together, and that give their runs together.
CHUNK, GROUP = 1 << 19, 1 << 23
#: Runs that get a suffix array together.
BATCH = 2048
LAST_ID = (1 << 63) - 1
_rng = np.random.Generator(np.random.PCG64(20240229))
_byte = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_odd = _rng.integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _spread(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return v ^ (v >> np.uint64(29))


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on, put together from powers of two."""
    h, size, out, done, level = _byte[data], 1, None, 0, 0
    while True:
        if k & size:
            out = h[: len(data) - k + 1].copy() if out is None else out * _odd[level] + h[done : done + len(data) - k + 1]
            done += size
        size *= 2
        if size > k:
            return _spread(out)
        h = h[: len(h) - size // 2] * _odd[level] + h[size // 2 :]
        level += 1


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        v = np.minimum(v[: len(v) - size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if width > size else v


def runs(text: bytes, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first start and last start of each run of one text. Texts below ``span`` have none."""
    hashes, firsts, lasts = [], [], []
    for at in range(0, len(text) - span + 1, CHUNK):
        data = np.frombuffer(text[at : at + CHUNK + span - 1], np.uint8)
        h = _gram_hashes(data, gram)
        place = np.arange(len(h), dtype=np.uint64)
        low = _sliding_min((h >> np.uint64(20) << np.uint64(20)) | place, span - gram + 1)
        anchor = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        hashes.append(h[anchor[first]])
        firsts.append(first + at)
        lasts.append(np.append(first[1:], len(anchor)) - 1 + at)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def _delta_bytes(ids: np.ndarray) -> bytes:
    """64-bit differences, byte planes apart, so that the shuffle's compression shortens them."""
    return np.diff(ids, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_delta(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


class IndexFamily:
    """Suffix arrays of geometrically growing size over fixed-length prefixes of suffixes."""

    def __init__(self, span: int = SPAN):
        self.kind = np.dtype(f"S{span}")
        self.span = span
        self.levels: list[np.ndarray] = []

    def add(self, batch: list[bytes]) -> list[np.ndarray]:
        """For each text of the batch, in order: whether the string at each start was there before."""
        data = np.frombuffer(b"".join(batch), np.uint8)
        sizes = np.array([len(x) for x in batch])
        counts = sizes - self.span + 1
        base = np.repeat(np.cumsum(sizes) - sizes, counts)
        starts = base + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        every = np.lib.stride_tricks.as_strided(data, (len(data) - self.span + 1, self.span), (1, 1), writeable=False)
        strings = np.ascontiguousarray(every[starts]).view(self.kind).ravel()
        order = np.argsort(strings, kind="stable")  # the batch's suffix array
        ranked = strings[order]
        again = np.concatenate([[False], ranked[1:] == ranked[:-1]])
        own, back = ranked[~again], np.cumsum(~again) - 1
        there = np.zeros(len(own), bool)
        for level in self.levels:
            at = np.searchsorted(level, own)
            at[at == len(level)] = 0
            there |= level[at] == own
        known = np.empty(len(strings), bool)
        known[order] = again | there[back]
        if not there.all():
            self.levels.append(own[~there])
            while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
                self.levels.append(np.sort(np.concatenate([self.levels.pop(), self.levels.pop()]), kind="stable"))
        return np.split(known, np.cumsum(counts)[:-1])


def _true_runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    yield from zip(edges[::2].tolist(), (edges[1::2] - 1).tolist())


def _groups(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """The same rows in groups of about GROUP bytes of text."""
    for batch in batches:
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(text_at)], np.int64)
        group = (np.cumsum(sizes) - sizes) // GROUP
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            yield batch.slice(int(rows[0]), len(rows))


def repeated_passages(docs: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes left, with ``with_text``) of each row.

    A null text is empty; a text shorter than ``span`` loses nothing. Null ids are
    one document behind all others. Rows that repeat an id and a text get the same
    result, as one row would; texts that share an id come one behind the other, in
    order of a hash of the text. Ids of any but an integral type raise an error.
    Other columns are not looked at.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = np.array(partition_keys(spark, parts), np.int32)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(
        F.coalesce(whole_number(docs, id_col), F.lit(LAST_ID)).alias("rid"), F.col(id_col).alias("own_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data")
    ).repartition(parts, "rid")

    def deal(values: np.ndarray) -> np.ndarray:
        """The partition of each value."""
        return ((_spread(values) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)

    def count_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors by bucket. kind 0: seen once here; 1: more often here; 2: not to be counted, known to repeat."""
        for batch in _groups(batches, 2):
            found = [(rid, runs(x.as_buffer().to_pybytes(), span, gram)[0]) for rid, x in zip(batch.column(0).to_pylist(), batch.column(2))]
            rids = np.repeat(np.array([r for r, _ in found], np.int64), [len(h) for _, h in found])
            grams = np.concatenate([h for _, h in found]) if found else np.empty(0, np.uint64)
            values, back, count = np.unique(grams, return_inverse=True, return_counts=True)
            once = count[back] == 1
            several = values[count > 1]
            out = {"bucket": [], "kind": [], "grams": [], "rids": []}
            for k, own, of, bucket in ((0, grams[once], rids[once], deal(grams[once])), (1, several, None, deal(several)), (2, grams[~once], rids[~once], deal(rids[~once].view(np.uint64)))):
                order = np.lexsort((own if of is None else of, bucket))
                edges = np.searchsorted(bucket[order], np.arange(parts + 1))
                for b in np.flatnonzero(np.diff(edges)):
                    taken = order[edges[b] : edges[b + 1]]
                    out["bucket"].append(int(keys[b]))
                    out["kind"].append(k)
                    out["grams"].append(own[taken].tobytes())
                    out["rids"].append(b"" if of is None else _delta_bytes(of[taken]))
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array(out["kind"], pa.int32()), pa.array(out["grams"], pa.binary()), pa.array(out["rids"], pa.binary())], list(out))

    def count_reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for k, g, r in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                held[k].append((np.frombuffer(g, np.uint64), _from_delta(r) if k != 1 else None))
        empty = (np.empty(0, np.uint64), np.empty(0, np.int64))
        single, single_rid = (np.concatenate([x[i] for x in held[0]] or [empty[i]]) for i in (0, 1))
        several = np.unique(np.concatenate([x[0] for x in held[1]] or [empty[0]]))
        order = np.argsort(single, kind="stable")
        single, single_rid = single[order], single_rid[order]
        same = single[1:] == single[:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(single) else np.zeros(0, bool)
        if len(several):
            at = np.minimum(np.searchsorted(several, single), len(several) - 1)
            twice |= several[at] == single
        for g, r in [(single[twice], single_rid[twice]), *held[2]]:
            for at in range(0, len(g), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(r[at : at + 100_000]), pa.array(g[at : at + 100_000].view(np.int64))], ["rid", "gram"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs under anchors that repeat. Those equal to an earlier one here are settled; the others go with their bytes."""
        for batch in _groups(batches, 1):
            every = []
            for rid, data, tie, grams in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                text = data.as_buffer().to_pybytes()
                h, first, last = runs(text, span, gram)
                chosen = np.isin(h, np.asarray(grams.values).view(np.uint64))
                every += [(rid, tie, a, b, text[a : b + span], g) for g, a, b in zip(h[chosen].tolist(), first[chosen].tolist(), last[chosen].tolist())]
            every.sort(key=lambda r: r[:3])
            seen: dict[bytes, tuple[int, int, int]] = {}
            out = {"gram": [], "rid": [], "tie": [], "first": [], "last": [], "data": []}
            settled: dict[tuple[int, int], list[list[int]]] = {}
            for rid, tie, a, b, data, g in every:
                if seen.setdefault(data, (rid, tie, a)) < (rid, tie, a):
                    spans = settled.setdefault((rid, tie), [])
                    if spans and a <= spans[-1][1] + 1:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                else:
                    for name, value in zip(out, (g, rid, tie, a, b, data)):
                        out[name].append(value)
            for (rid, tie), spans in settled.items():
                g = int(_spread(np.array([rid & (1 << 64) - 1], np.uint64))[0])
                for a, b in spans:
                    for name, value in zip(out, (g, rid, tie, a, b, None)):
                        out[name].append(value)
            grams = np.array(out["gram"], np.uint64)
            columns = [pa.array(keys[deal(grams)], pa.int32()), pa.array(grams.view(np.int64)), *(pa.array(out[k], pa.int64()) for k in ("rid", "tie", "first", "last")), pa.array(out["data"], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "gram", "rid", "tie", "first", "last", "data"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The starts of strings that are there earlier, as (document, first start, last start)."""
        out: list[tuple[int, ...]] = []
        held = []
        for batch in batches:
            gram, rid, tie, first, last, data = (batch.column(i).to_pylist() for i in range(1, 7))
            for row in zip(rid, tie, first, last, gram, data):
                if row[5] is None:
                    out.append(row[:4])
                else:
                    held.append(row)
        held.sort(key=lambda r: r[:3])
        seen: dict[bytes, tuple[int, int, int]] = {}
        fresh = []
        for row in held:
            if row[5] not in seen:
                seen[row[5]] = row[:3]
                fresh.append(row)
            elif seen[row[5]] < row[:3]:  # equal for rows that repeat an id and a text
                out.append(row[:4])
        shared = Counter(row[4] for row in fresh)
        # alone under its anchor a run can only repeat itself, and then its anchor would repeat in it
        fresh = [row for row in fresh if shared[row[4]] > 1]
        family, at = IndexFamily(span), 0
        while at < len(fresh):
            part = fresh[at : at + BATCH]
            for (rid, tie, first, _last, _gram, _data), known in zip(part, family.add([row[5] for row in part])):
                out += [(rid, tie, first + a, first + b) for a, b in _true_runs(known)]
            at += BATCH
        for at in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out[at : at + 50_000])], ["rid", "tie", "first", "last"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for data, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                text = data.as_buffer().to_pybytes()
                kept, end, n = [], 0, 0
                at = 0
                for s in sorted((s["first"], s["last"] + span) for s in spans or ()):
                    if s[0] > end or n == 0:
                        kept.append(text[at : s[0]])
                        n += 1
                    end = max(end, s[1])
                    at = end
                kept.append(text[at:])
                left = b"".join(kept)
                for name, value in zip(rows, (len(text), len(text) - len(left), n, hashlib.sha256(left).hexdigest(), left)):
                    rows[name].append(value)
            columns = [batch.column(0), *(pa.array(rows[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(rows["kept_sha256"])]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(rows["kept"], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    counted = texts.mapInArrow(count_map, "bucket int, kind int, grams binary, rids binary").repartition(parts, "bucket")
    repeats = counted.mapInArrow(count_reduce, "rid bigint, gram bigint").groupBy("rid").agg(F.collect_set("gram").alias("grams"))
    tied = lambda: F.xxhash64("data")
    # own_id goes along unused, so that all three steps have the same exchange of the texts
    sent = texts.join(repeats, "rid").select("rid", "data", tied().alias("tie"), "grams", "own_id").mapInArrow(send, "bucket int, gram bigint, rid bigint, tie bigint, first bigint, last bigint, data binary")
    covered = sent.repartition(parts, "bucket").mapInArrow(scan, "rid bigint, tie bigint, first bigint, last bigint")
    spans = covered.groupBy("rid").agg(F.collect_list(F.struct("tie", "first", "last")).alias("spans"))
    of_text = F.filter("spans", lambda s: s["tie"] == F.col("tie"))
    joined = texts.join(spans, "rid", "left").withColumn("tie", tied()).select("own_id", "data", of_text.alias("spans"))
    return joined.mapInArrow(cut, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text)
