"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits the variants within half the radius of it; two
fingerprints within the radius share one. Half of radius 3 is not whole, so parity
decides who goes further: fingerprints with an odd number of ones also flip two
bits, those with an even number at most one (at distance 3 the parities differ).
Of the two-bit flips those inside one half of the word are enough, since two of
any three bits lie in one half. That is 561 variants on average, not 2081.

Variants go to buckets in packed blocks, not as rows. There are so many buckets
that each holds a bounded number of variants; a task gets its blocks sorted by
bucket (by Spark, which spills) and works off one bucket at a time. Members of a
variant are linked to one of them that is at most one bit away: all of these links
are within the radius by construction, so a group costs its size, never its square.
The bits are counted again before a link is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexilake.llm.common import partition_keys, written
from lexilake.llm.components import connected_components

SEED = 42
#: Bits of a fingerprint are summed over so many shingles at a time.
BLOCK = 1 << 15
#: Variants that one bucket is meant to hold, and nodes whose variants are packed together.
BUCKET, PACK = 1 << 18, 1024
#: Bytes of packed blocks that go to a Python worker at a time.
BATCH = 1 << 22
#: A set of shingles counts as so many rows of a table.
PER_SET = 32


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle of the whole text, repeats included.

    A-Z are lower-cased; words are split at x20 and x09-x0D. Fewer words than
    ``size``: the whole sequence is one shingle; none: no shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat, ends = b" ".join(words), []
    at = -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(flat, SEED)], np.uint64)
    return np.array([digest(flat[s:e], SEED) for s, e in zip(starts, ends[size - 1 :])], np.uint64)


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of hashes of the same shingle; the 0th is the hash itself."""
    if k == 0:
        return h
    h = (h ^ np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> list[int]:
    """``words`` 64-bit words; a bit is 1 if set in over half the hashes. No hashes: zero."""
    out = []
    for k in range(words):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), BLOCK):
            part = _mix(hashes[at : at + BLOCK], k).astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8))
        out.append(int(bits.view(">i8")[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp`` (array of ``words`` signed 64-bit words) of each row's whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), shingle), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.list_(pa.int64()))], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp array<bigint>")


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct hashes of ``shingle_hashes``, ascending."""
    return np.unique(shingle_hashes(text, size))


def set_digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes(), SEED)


def set_fingerprints(docs: DataFrame, shingle: int, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fp`` (as ``fingerprints``, but of the distinct shingles) and ``shingles`` (digest of their set)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, digests = [], []
            for t in batch.column(1):
                own = shingle_set(t.as_py(), shingle)
                fps.append(fingerprint(own, words))
                digests.append(set_digest(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.list_(pa.int64())), pa.array(digests, pa.binary())], [id_col, "fp", "shingles"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp array<bigint>, shingles binary")


def shingle_sets(docs: DataFrame, shingle: int, text_col: str = "text") -> DataFrame:
    """``shingles`` (digest) and ``held`` (the distinct hashes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                held = [shingle_set(t.as_py(), shingle) for t in batch.column(0).slice(at, 500)]
                yield pa.RecordBatch.from_arrays([pa.array([set_digest(h) for h in held], pa.binary()), pa.array([h.view(np.int64) for h in held], pa.list_(pa.int64()))], ["shingles", "held"])

    return docs.select(text_col).mapInArrow(run, "shingles binary, held array<bigint>")


def near_masks(bits: int) -> np.ndarray:
    return np.array([0, *[1 << i for i in range(bits)]], np.uint64)


def pair_masks(bits: int) -> np.ndarray:
    """Two-bit masks inside either half of the word."""
    half = bits // 2
    return np.array([1 << i | 1 << j for i in range(bits) for j in range(i) if (i < half) == (j < half)], np.uint64)


@cache
def masks(bits: int, radius: int) -> tuple[np.ndarray, int]:
    """All masks by number, those of at most one bit first, and how many these are."""
    if radius not in (0, 1, 2, 3):
        raise ValueError("the radius is 0 to 3")
    near = near_masks(bits) if radius else np.zeros(1, np.uint64)
    return (np.concatenate([near, pair_masks(bits)]) if radius == 3 else near), len(near)


def _spread(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return v ^ (v >> np.uint64(33))


def _ones(v: np.ndarray) -> np.ndarray:
    return np.bitwise_count(v)


def _dealt(v: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of each variant."""
    return ((_spread(v) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _bucket_count(nodes: int, variants: int, parts: int) -> int:
    """Buckets for so many variants a node, a multiple of the partitions."""
    return parts * max(1, math.ceil(nodes * variants / BUCKET / parts))


def _one_at_a_time(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[memoryview, ...]]]:
    """The packed blocks of each bucket; rows are (partition key, bucket, block columns), sorted by bucket."""
    at, held = None, []
    for batch in batches:
        columns = batch.columns[2:]
        for row, bucket in enumerate(batch.column(1).to_pylist()):
            if bucket != at and held:
                yield held
                held = []
            at = bucket
            held.append(tuple(memoryview(c[row].as_buffer()) for c in columns))
    if held:
        yield held


def _blocks(bucket: np.ndarray, columns: list[np.ndarray], n: int) -> Iterator[tuple[int, list[bytes]]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), [c[edges[b] : edges[b + 1]].tobytes() for c in columns]


def links_within(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``a``, ``b`` (64-bit words) that join all distinct words of ``fps.fp`` within ``radius`` of each other.

    Not every pair is returned, but every pair is joined by a chain of returned
    links, each of which is itself within the radius.
    """
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = partition_keys(fps.sparkSession, parts)
    buckets = _bucket_count(fps.count(), len(masks(64, radius)[0]), parts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, near = masks(64, radius)
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(own), PACK):
                some = own[at : at + PACK]
                far = some[_ones(some) % 2 == 1] if radius == 3 else some[:0]
                variants = np.concatenate([(some[:, None] ^ every[None, :near]).ravel(), (far[:, None] ^ every[None, near:]).ravel()])
                ids = np.concatenate([np.tile(np.arange(near, dtype=np.uint16), len(some)), np.tile(np.arange(near, len(every), dtype=np.uint16), len(far))])
                found = list(_blocks(_dealt(variants, buckets), [variants, ids], buckets))
                yield pa.RecordBatch.from_arrays([pa.array([keys[b % parts] for b, _ in found], pa.int32()), pa.array([b for b, _ in found], pa.int64()), *(pa.array([c[k] for _, c in found], pa.binary()) for k in (0, 1))], ["part", "bucket", "variants", "ids"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, near = masks(64, radius)
        for blocks in _one_at_a_time(batches):
            variants = np.frombuffer(b"".join(v for v, _ in blocks), np.uint64)
            ids = np.frombuffer(b"".join(i for _, i in blocks), np.uint16)
            order = np.argsort(variants, kind="stable")
            variants = variants[order]
            first = np.flatnonzero(np.concatenate([[True], variants[1:] != variants[:-1]]))
            size = np.diff(np.append(first, len(variants)))
            shared = np.repeat(size > 1, size)
            variants, ids, group = variants[shared], ids[order][shared], np.repeat(np.arange(len(first)), size)[shared]
            if not len(variants):
                continue
            inner = np.lexsort((ids, group))  # in each group one that is near, if any, comes first
            variants, ids, group = variants[inner], ids[inner], group[inner]
            own = variants ^ every[ids]
            head = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(group)), 0))
            a, b, good = own[head], own, ids[head] < near
            good &= (a != b) & (_ones(a ^ b) <= radius)
            pairs = np.unique(np.stack([np.minimum(a, b)[good], np.maximum(a, b)[good]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))], ["a", "b"])

    blocks = fps.repartition(parts, "fp").mapInArrow(emit, "part int, bucket bigint, variants binary, ids binary")
    return blocks.repartition(parts, "part").sortWithinPartitions("bucket").mapInArrow(meet, "a bigint, b bigint").distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` of each row.

    Rows with a null text or without words have fingerprint zero and are linked
    like any others. ``component_id`` is the smallest id reachable over links of at
    most ``radius`` bits; null ids are never smallest, and a component of null ids
    alone has a null one. Repeated rows are each returned.
    """
    own = written(fingerprints(docs, shingle, 1, id_col, text_col).select(id_col, F.col("fp")[0].alias("fp")), "fingerprints", BATCH)
    n = own.count()
    known = written(own.groupBy("fp").agg(F.min(id_col).alias("first_id")), "distinct-fingerprints", rows=n)
    label = connected_components(written(links_within(known.select("fp"), radius), "links", BATCH))
    member = label.join(known, F.col("node") == F.col("fp")).select("node", "label", "first_id")
    least = written(member.groupBy("label").agg(F.min("first_id").alias("least_id")), "least", rows=n)
    named = label.withColumnRenamed("label", "_label").join(least, F.col("_label") == F.col("label")).select("node", "least_id")
    of_fp = written(known.join(named, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("least_id", "first_id").alias("component_id")), "components", rows=n)
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(of_fp, F.col("fp") == F.col("_fp")).select(id_col, hex16.alias("fingerprint"), "component_id")


#: For similarity search by tables: words of a fingerprint and bits of a table's key. The
#: bits that may differ between candidates follow from the angle of two sets of shingles
#: at the Jaccard similarity; candidates are verified on the sets themselves.
WORDS, TABLE_BITS = 8, 30
#: Words of the fingerprints that the members of a crowded variant are compared by: their estimate is twice as sharp.
LONG = 32
NEAR = 0.8


def _planes(v: np.ndarray) -> bytes:
    return v.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


#: Standard errors that an estimate from bits may be off before a pair is given up unverified; None gives none up.
ERRORS = 3.0


def allowed_bits(similarity: float, bits: int, errors: float | None = ERRORS) -> int:
    """Bits that may differ between candidates for this Jaccard similarity, so many standard errors included."""
    if errors is None:
        return bits
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + errors * math.sqrt(bits * share * (1 - share)))


def loose_bits(similarity: float, bits: int, errors: float | None = ERRORS) -> int:
    """The same for few bits, rounded up: with three, 998 in 1000 pairs at this similarity do not exceed it."""
    if errors is None:
        return bits
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * share + errors * math.sqrt(bits * share * (1 - share)))


#: A variant with more members than this is crowded: its first round of pairs is not every pair.
CROWDED = 4
#: Nodes whose marks of crowded variants one task is meant to merge.
SHARE = 1 << 18
#: Where the number of the flip stands in a stored variant, above its table and key.
FLIP_AT = np.uint64(40)
#: Words of fingerprints that are compared at a time.
COMPARED = 1 << 21


def _table_bits(fps: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The bits of each fingerprint by table."""
    return np.unpackbits(fps.astype(">i8").view(np.uint8), axis=1)[:, : tables * bits].reshape(-1, tables, bits)


def table_pairs(nodes: DataFrame, similarity: float = NEAR, words: int = WORDS, bits: int = TABLE_BITS, flips: bool = True, whole: bool = False, errors: float | None = ERRORS) -> DataFrame:
    """Pairs ``a``, ``b`` of nodes (``node``, ``fp``, ``label``) that share a variant in some table and differ in their labels.

    A table's key is a stretch of ``bits`` bits of the fingerprint; its variants are
    those within one flip, so keys up to two bits apart meet (without ``flips`` only
    equal ones). With each goes a check word, 32 bits of another part of the
    fingerprint; chance meetings, whose number is a square of the nodes', end there.
    ``label`` is the smallest node of what is joined already: such pairs are not
    looked at again.

    Two keys share two variants or more; a pair is settled in one of them, the key
    itself for equal keys, else the smaller. Members of a variant are paired with the
    first of it, in small groups with their next three too, which is every pair of up
    to four. The other pairs of crowded variants are left for a round with ``whole``:
    members of crowded variants whose labels differ are marked, in rows that hold
    ``share`` and ``crowd`` (packed nodes, see ``crowded_nodes``) and no pair. That
    round returns every pair that shares a variant, differs in its labels and is near
    by the longer fingerprints ``long`` of such nodes, each from the first table that
    it meets in. These go once with each block, not with each variant. Rows may repeat
    a pair that meets in several tables.
    """
    check_limit, flip_masks = loose_bits(similarity, 32, errors), near_masks(bits)
    parts, tables = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), words * 64 // bits
    part_keys = np.array(partition_keys(nodes.sparkSession, parts), np.int32)
    n_variants = bits + 1 if flips else 1
    n_nodes = nodes.count()
    buckets, shares = _bucket_count(n_nodes, tables * n_variants, parts), max(1, math.ceil(n_nodes / SHARE))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = near_masks(bits)[:n_variants]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            fps = np.array(batch.column(1).to_pylist(), np.int64).reshape(-1, words)[order]
            labels = batch.column(2).to_numpy()[order]
            longs = np.array(batch.column(3).to_pylist(), np.int64).reshape(len(ids), -1)[order] if whole else None
            for at in range(0, len(ids), PACK):
                all_bits = _table_bits(fps[at : at + PACK], tables, bits).astype(np.uint64)
                keys = (all_bits << np.arange(bits, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
                variants = (keys[:, :, None] ^ every) | (np.arange(tables, dtype=np.uint64) << np.uint64(bits))[None, :, None]
                own = np.repeat(ids[at : at + PACK], tables * n_variants)
                check = fps[at : at + PACK][:, (np.arange(tables) * bits // 64 + words // 2) % words].astype(np.uint32)
                check = np.repeat(check.ravel(), n_variants)
                variants = variants.ravel()
                bucket = _dealt(variants + np.uint64(1), buckets)
                variants |= np.tile(np.arange(n_variants, dtype=np.uint64) << FLIP_AT, len(variants) // n_variants)
                rank = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[rank], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(edges))
                blocks = [rank[edges[b] : edges[b + 1]] for b in full]
                behind = np.repeat(ids[at : at + PACK] - labels[at : at + PACK], tables * n_variants)  # mostly zero
                yield pa.RecordBatch.from_arrays([pa.array(part_keys[full % parts]), pa.array(full), pa.array([_planes(variants[x]) for x in blocks], pa.binary()), pa.array([_planes(np.diff(own[x], prepend=0)) for x in blocks], pa.binary()), pa.array([longs[at : at + PACK][np.unique(x // (tables * n_variants))].tobytes() if whole else check[x].tobytes() for x in blocks], pa.binary()), pa.array([_planes(behind[x]) for x in blocks], pa.binary())], ["part", "bucket", "variants", "nodes", "checks", "labels"])

    def settled(variants: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether a pair that comes to a variant by these flips is settled there."""
        apart = flip_masks[one] ^ flip_masks[two]
        return np.where(apart == 0, one == 0, variants < variants ^ apart)

    def unjoined(starts: np.ndarray, size: np.ndarray, variants: np.ndarray, flips_of: np.ndarray, nodes_of: np.ndarray, long_of: np.ndarray, longs: np.ndarray, labels_of: np.ndarray) -> Iterator[np.ndarray]:
        """Every near pair of each group that differs in its labels and is settled there."""
        limit, step = allowed_bits(similarity, 64 * longs.shape[1], errors), COMPARED // longs.shape[1]

        def near(left: np.ndarray, right: np.ndarray) -> Iterator[np.ndarray]:
            for at in range(0, len(left), step):
                x, y = left[at : at + step], right[at : at + step]
                own = (labels_of[x] != labels_of[y]) & settled(variants[x], flips_of[x], flips_of[y])
                x, y = x[own], y[own]
                other = longs[long_of[x]] ^ longs[long_of[y]]
                good = _ones(other).sum(axis=1, dtype=np.int64) <= limit
                x, y = x[good], y[good]
                meets = _table_bits(other[good][:, :words].view(np.int64), tables, bits).sum(axis=2) <= 2
                first = meets.argmax(axis=1) == (variants[x] >> np.uint64(bits)).astype(np.int64)
                yield np.stack([nodes_of[x[first]], nodes_of[y[first]]])

        every = np.arange(len(variants))
        for k in range(1, 8):
            right = every[k:][(variants[k:] == variants[:-k]) & np.repeat(size <= 8, size)[k:]]
            yield from near(right - k, right)
        apart = np.minimum.reduceat(labels_of, starts) != np.maximum.reduceat(labels_of, starts)
        for start, n in zip(starts[apart & (size > 8)].tolist(), size[apart & (size > 8)].tolist()):
            label, rows = labels_of[start : start + n], max(1, step // n)
            for at in range(0, n, rows):
                i, j = np.nonzero(np.triu(label[at : at + rows, None] != label[None, at:], 1))
                yield from near(start + at + i, start + at + j)

    def rows(pairs: np.ndarray, marks: list[tuple[int, bytes]] = ()) -> pa.RecordBatch:
        n, m = pairs.shape[1], len(marks)
        a, b = (pa.concat_arrays([pa.array(x), pa.nulls(m, pa.int64())]) for x in pairs)
        share = pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([k for k, _ in marks], pa.int64())])
        crowd = pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([v for _, v in marks], pa.binary())])
        return pa.RecordBatch.from_arrays([a, b, share, crowd], ["a", "b", "share", "crowd"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _one_at_a_time(batches):
            variants = np.concatenate([_unplaned(v) for v, _, _, _ in blocks]).view(np.uint64)
            flips_of = (variants >> FLIP_AT).astype(np.uint8)
            variants &= (np.uint64(1) << FLIP_AT) - np.uint64(1)
            order = np.argsort(variants, kind="stable")
            variants = variants[order]
            same = variants[1:] == variants[:-1]
            shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])  # most variants are alone
            variants, order = variants[shared], order[shared]
            if not len(variants):
                continue
            nodes_of = np.concatenate([np.cumsum(_unplaned(i)) for _, i, _, _ in blocks])[order]
            labels_of = nodes_of - np.concatenate([_unplaned(x) for _, _, _, x in blocks])[order]
            inner = np.lexsort((nodes_of, variants))
            variants, nodes_of, labels_of, order = variants[inner], nodes_of[inner], labels_of[inner], order[inner]
            flips_of = flips_of[order]
            first = np.concatenate([[True], variants[1:] != variants[:-1]])
            starts = np.flatnonzero(first)
            size = np.diff(np.append(starts, len(variants)))
            if whole:
                # the members of a block come in the order of its nodes, and so do its long fingerprints (unsigned: bits of negative numbers count otherwise)
                steps = [np.flatnonzero(np.diff(np.cumsum(_unplaned(i)), prepend=-1)) for _, i, _, _ in blocks]
                sizes = [len(v) // 8 for v, _, _, _ in blocks]
                longs = np.frombuffer(b"".join(c for _, _, c, _ in blocks), np.uint64).reshape(sum(map(len, steps)), -1)
                bases = np.cumsum([0, *map(len, steps)])
                long_of = np.concatenate([b + np.searchsorted(s, np.arange(n), side="right") - 1 for b, s, n in zip(bases, steps, sizes)])[order]
                for some in unjoined(starts, size, variants, flips_of, nodes_of, long_of, longs, labels_of):
                    if some.shape[1]:
                        yield rows(some)
                continue
            checks = np.frombuffer(b"".join(c for _, _, c, _ in blocks), np.uint32)[order]
            apart = np.minimum.reduceat(labels_of, starts) != np.maximum.reduceat(labels_of, starts)
            crowd = np.unique(nodes_of[np.repeat(apart & (size > CROWDED), size)]) if flips else nodes_of[:0]  # equal keys meet again within a flip
            marks = [(k, v) for k, (v,) in _blocks(_dealt(crowd.view(np.uint64), shares), [crowd], shares)]
            small = np.repeat(size <= 8, size)
            every = np.arange(len(variants))
            left, right = [np.maximum.accumulate(np.where(first, every, 0))], [every]
            for step in (1, 2, 3):
                near = every[step:][(variants[step:] == variants[:-step]) & small[step:]]
                left.append(near - step)
                right.append(near)
            left, right = np.concatenate(left), np.concatenate(right)
            good = (_ones(checks[left] ^ checks[right]) <= check_limit) & (labels_of[left] != labels_of[right])
            left, right = left[good], right[good]
            own = settled(variants[left], flips_of[left], flips_of[right])
            yield rows(np.unique(np.stack([nodes_of[left[own]], nodes_of[right[own]]]), axis=1), marks)

    blocks = nodes.select("node", "fp", "label", *["long"] * whole).repartition(parts, "node").mapInArrow(emit, "part int, bucket bigint, variants binary, nodes binary, checks binary, labels binary")
    return blocks.repartition(parts, "part").sortWithinPartitions("bucket").mapInArrow(meet, "a bigint, b bigint, share bigint, crowd binary")


def crowded_nodes(met: DataFrame) -> DataFrame:
    """The distinct nodes ``node`` of the marks in ``table_pairs``; a share of them has a bounded number and is merged by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, more, n = None, np.empty(0, np.int64), [], 0
        merged = lambda: np.unique(np.concatenate([seen, *more]))
        packed = lambda nodes: pa.RecordBatch.from_arrays([pa.array(nodes)], ["node"])
        for batch in batches:
            for share, crowd in zip(batch.column(0).to_pylist(), batch.column(1)):
                if share != at:
                    yield packed(merged())
                    at, seen, more, n = share, seen[:0], [], 0
                more.append(np.frombuffer(crowd.as_buffer(), np.int64))
                n += len(more[-1])
                if n > 4 * SHARE:
                    seen, more, n = merged(), [], 0
        yield packed(merged())

    marks = met.where("crowd is not null").select("share", "crowd")
    return marks.repartition("share").sortWithinPartitions("share").mapInArrow(run, "node bigint")


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float, words: int, id_col: str, text_col: str, errors: float | None) -> DataFrame:
    """The ``pairs`` whose sets of shingles have the Jaccard similarity or more; the fingerprints spare the sets of most others."""
    n = pairs.count()
    one, two = (nodes.select(F.col("node").alias(f"n{x}"), F.col("fp").alias(f"f{x}"), F.col("shingles").alias(f"s{x}")) for x in "ab")
    met = pairs.where("a is not null").select("a", "b").distinct().join(one, F.col("a") == F.col("na")).select("b", "na", "fa", "sa").join(two, F.col("b") == F.col("nb"))
    apart = sum((F.bit_count(F.col("fa")[k].bitwiseXOR(F.col("fb")[k])) for k in range(words)), F.lit(0))
    near = written(met.where(apart <= allowed_bits(similarity, 64 * words, errors)).select("na", "sa", "nb", "sb"), "candidates", rows=n)
    asked = near.select(F.col("na").alias("n")).unionByName(near.select(F.col("nb").alias("n"))).distinct()
    ids = written(nodes.join(asked, F.col("node") == F.col("n"), "left_semi").select(F.col("first_id").alias("asked_id")), "asked", rows=2 * n)
    texts = docs.join(ids, docs[id_col] == ids["asked_id"], "left_semi")
    held = written(shingle_sets(texts, shingle, text_col).dropDuplicates(["shingles"]), "shingle-sets", BATCH, rows=2 * n * PER_SET)
    one, two = (held.select(F.col("shingles").alias(f"d{x}"), F.col("held").alias(f"h{x}")) for x in "ab")
    both = near.join(one, F.col("sa") == F.col("da")).select("na", "nb", "sb", "ha").join(two, F.col("sb") == F.col("db"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (z.values.to_numpy() for z in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9 else -1
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("na", "nb", "ha", "hb").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = NEAR, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", errors: float | None = ERRORS) -> DataFrame:
    """``id_col`` and ``group_id`` of each row: the smallest id of its group of near-duplicates.

    Two texts are linked if the sets of their shingles have a Jaccard similarity of
    ``similarity`` or more. Candidates are found by their fingerprints of
    ``64 * words`` bits; the ball hashing is over tables of shorter keys, as one word
    cannot hold so wide an angle. Before a candidate is verified on its set it is
    sifted by its bits; ``errors`` says how far these may be off, and None sifts
    nothing, which leaves only pairs out that meet in no table. Texts with the same set of shingles are one node;
    nodes are numbered in the order of their smallest ids, which may be of any type
    that has an order. Null texts and texts without words are alike. Rows with a
    null id have a null group unless their set of shingles is that of others. Rows
    that repeat an id are each returned; an empty table gives no rows; other columns
    are not looked at.
    """
    own = written(set_fingerprints(docs, shingle, words, id_col, text_col), "fingerprints", BATCH)
    n = own.count()
    sets = own.where(F.col(id_col).isNotNull()).groupBy("shingles").agg(F.first("fp").alias("fp"), F.min(id_col).alias("first_id"))
    nodes = written(sets.orderBy("first_id", "shingles").withColumn("node", F.monotonically_increasing_id()), "nodes", rows=n)
    linked = lambda pairs: written(_links(pairs, nodes, docs, shingle, similarity, words, id_col, text_col, errors), "links", BATCH, rows=pairs.count() * PER_SET)

    def labelled(some: DataFrame, label: DataFrame) -> DataFrame:
        joined = label.withColumnRenamed("node", "_node")
        return written(some.join(joined, F.col("node") == F.col("_node"), "left").select("node", "fp", F.coalesce("label", "node").alias("label")), "labelled", rows=n)

    # equal keys first: they join most of a group of near copies, whose other meetings then need no look
    links = linked(written(table_pairs(nodes.withColumn("label", F.col("node")), similarity, words, flips=False, errors=errors), "met", BATCH))
    met = written(table_pairs(labelled(nodes, connected_components(links)), similarity, words, errors=errors), "met", BATCH)
    links = links.unionByName(linked(met))
    label = connected_components(links)
    crowd = written(crowded_nodes(met).withColumnRenamed("node", "_crowd"), "crowd", rows=n)
    if not crowd.isEmpty():  # what is left of crowded variants are pairs of different labels
        few = written(nodes.join(crowd, F.col("node") == F.col("_crowd"), "left_semi"), "crowded", rows=n)
        asked = few.select(F.col("first_id").alias("asked_id"))
        texts = docs.join(asked, docs[id_col] == asked["asked_id"], "left_semi")
        longs = set_fingerprints(texts, shingle, LONG, id_col, text_col).select(F.col("shingles").alias("_shingles"), F.col("fp").alias("long")).dropDuplicates(["_shingles"])
        joined = label.withColumnRenamed("node", "_node")
        others = few.join(longs, F.col("shingles") == F.col("_shingles")).join(joined, F.col("node") == F.col("_node"), "left")
        others = written(others.select("node", "fp", F.coalesce("label", "node").alias("label"), "long"), "labelled", rows=n)
        label = connected_components(links.unionByName(linked(written(table_pairs(others, similarity, words, whole=True, errors=errors), "met", BATCH))))
    named = nodes.join(label.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("shingles", F.coalesce("label", "node").alias("_label"))
    heads = nodes.select(F.col("node").alias("_head"), F.col("first_id").alias("group_id"))
    of_set = written(named.join(heads, F.col("_label") == F.col("_head")).select(F.col("shingles").alias("_shingles"), "group_id"), "groups", rows=n)
    return own.join(of_set, F.col("shingles") == F.col("_shingles"), "left").select(id_col, "group_id")


def without_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one id of each group stays, the smallest. Rows with a null id stay, and so do all rows that repeat an id that stays."""
    groups = near_duplicates(docs, shingle, similarity, id_col=id_col, text_col=text_col)
    gone = groups.where(F.col(id_col) != F.col("group_id")).select(F.col(id_col).alias("gone_id")).distinct()
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")
