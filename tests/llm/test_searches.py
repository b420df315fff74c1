"""Source divergence, hard negatives and exact search against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexilake.llm import divergence, nearest, negatives
from lexilake.llm.vectors import Best

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, id string, `rank` int"


def _vectors(spark, n=700, dim=8, seed=3):
    """Clusters, many equal vectors, ties, repeated rows, short vectors, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = (centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)
    x[: n // 3] = x[0]  # one vector has a third of all rows
    x[n // 2 : n // 2 + 40] = np.round(x[n // 2 : n // 2 + 40])
    rows = [(int(i), [float(c) for c in v], int(i) % 4, 0.5, "x", 1) for i, v in enumerate(x)]
    rows += rows[5:9] + [(n, [1.0, 2.0], 1, None, None, None), (n + 1, [], 2, None, None, None)]
    rows += [(n + 2, None, 1, None, None, None), (n + 3, [1.0, None], 1, None, None, None), (n + 4, [math.nan] * dim, 1, None, None, None), (n + 5, [math.inf] + [0.0] * (dim - 1), 1, None, None, None)]
    rows += [(None, [9.0] * dim, 1, None, None, None), (n + 6, [0.5] * dim, None, None, None, None), (n + 8, [-3.0] * dim, 3, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def _whole(rows, scale, labelled=False):
    kept = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or (labelled and label is None) or any(c is None or not math.isfinite(c) for c in v):
            continue
        kept[i] = (label, [math.floor(scale * c) for c in v])
    return kept


def _product(a, b):
    return sum(x * y for x, y in zip(a, b))


@pytest.mark.parametrize("rounds,pivots,rings", [((1, 8), 16, 4), ((), 1, 1), ((1, 2, 4), 64, 8)])
def test_exact_search_equals_brute_force(spark, rounds, pivots, rings):
    df, rows = _vectors(spark)
    kept = _whole(rows, 1024)
    want = set()
    for q in (i for i in kept if i % 100 == 0):
        best = sorted((-_product(kept[q][1], v), i) for i, (_, v) in kept.items() if i != q)[:10]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    got = nearest.exact_top_k(df, df.where("vec_id % 100 = 0"), 10, rounds=rounds, pivots=pivots, rings=rings)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_exact_search_reads_few_cells_of_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centres = 4 * rng.normal(size=(20, 6))
    x = centres[np.arange(4000) % 20] + 0.05 * rng.normal(size=(4000, 6))
    v = np.floor(1024 * x).astype(np.int32)
    longest = float((v.astype(float) ** 2).sum(axis=1).max())
    fitted = nearest.Pivots(v, longest, 20, 4)
    cell, distance = fitted.keys(v)
    found = np.unique(cell)
    cells = {"cell": found, "lo": np.array([distance[cell == c].min() for c in found]), "hi": np.array([distance[cell == c].max() for c in found]), "slots": np.ones(len(found), int)}
    top = np.sort(v[:50].astype(float) @ v.T.astype(float), axis=1)[:, -10].astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(50)), pa.array(v[:50].tolist(), pa.list_(pa.int32())), pa.array(top)], ["id", "v", "last"])
    met = sum(len(b.column(2)[0].as_py()) // 8 for b in nearest._router(6, fitted, cells, 0, len(found))(iter([batch])))
    assert met < 0.3 * 50 * len(found)  # cells that queries read once they know their k-th score


def test_exact_search_of_nothing_few_and_wrong(spark):
    df, _ = _vectors(spark, n=30)
    assert nearest.exact_top_k(df.where("false"), df, 10).count() == 0
    assert nearest.exact_top_k(df, df.where("false"), 10).count() == 0
    few = nearest.exact_top_k(df.where("vec_id < 4"), df.where("vec_id = 2"), 10)
    assert [r["rank"] for r in few.orderBy("rank").collect()] == [1, 2, 3]
    with pytest.raises(ValueError, match="integral"):
        nearest.exact_top_k(df.withColumn("vec_id", F.col("vec_id").cast("string")), df, 10)
    long = spark.createDataFrame([(1, [3e9]), (2, [1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too long for whole products"):
        nearest.exact_top_k(long, long, 1).collect()


def test_products_beyond_doubles_are_exact(spark):
    rows = [(k, [1e6 + k / 1024, 7e5 - k / 1024]) for k in range(6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    kept = _whole([(*r, None) for r in rows], 1024)
    want = {(q, r + 1, i, -s) for q in kept for r, (s, i) in enumerate(sorted((-_product(kept[q][1], v), i) for i, (_, v) in kept.items() if i != q)[:2])}
    assert {tuple(r) for r in nearest.exact_top_k(df, df, 2).collect()} == want


def _negatives(kept, anchors, positives=5, negatives=3):
    out = set()
    for a in anchors:
        label, v = kept[a]
        scored = sorted((-_product(v, w), i) for i, (_, w) in kept.items() if i != a)
        for s, p in [(-s, i) for s, i in scored if kept[i][0] == label][:positives]:
            far = [(-t, i) for t, i in scored if kept[i][0] != label and 50 * s <= -100 * t <= 95 * s][:negatives]
            out |= {(a, p, r + 1, i, s, t) for r, (t, i) in enumerate(far)}
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_hard_negatives_equal_brute_force(spark, seed):
    df, rows = _vectors(spark, seed=seed)
    kept = _whole(rows, 256, labelled=True)
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert {tuple(r) for r in got.collect()} == _negatives(kept, [i for i in kept if i % 50 == 0])
    assert got.count() > 30


def test_hard_negatives_of_nothing_one_label_and_trees_of_many_levels(spark, monkeypatch):
    df, rows = _vectors(spark)
    assert negatives.hard_negatives(df.where("false"), F.lit(True)).count() == 0
    assert negatives.hard_negatives(df, F.lit(False)).count() == 0
    assert negatives.hard_negatives(df.withColumn("label", F.lit(1)), F.col("vec_id") % 50 == 0).count() == 0
    v = np.random.default_rng(1).normal(size=(2048, 5))
    order, centres, radii = negatives.ball_tree(v)
    assert sorted(order) == list(range(2048)) and len(radii) == 63
    for level in range(6):
        cuts = negatives._cuts(2048, level)
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            node = 2**level - 1 + k
            assert np.sqrt(((v[order[lo:hi]] - centres[node]) ** 2).sum(axis=1)).max() <= radii[node] + 1e-9
    assert radii[-32:].mean() < radii[0]


def test_best_keeps_ties_by_id():
    best = Best(2, 2)
    best.take(np.array([[5, 5, 5], [1, 2, 3]]), np.array([9, 8, 7]), np.array([0, 1]))
    best.take(np.array([[5]]), np.array([1]), np.array([0]))
    assert best.ids.tolist() == [[1, 7], [7, 8]] and best.scores.tolist() == [[5, 5], [3, 2]]


def _divergence(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", a or "", b or "") for t, a, b in rows):
        words = term.findall(text.translate(lower))
        groups[lang].add(source)
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * len(kept))
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(count[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(count[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources - {s}]
            above = [(t, p[s][t] - q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", above, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])}
    return out


def test_divergence_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    words = ["Alpha", "beta", "Gämma", "ÉTÉ", "d", "ee", "x-y", "don't", "日本 語", "Zeta9eta"]
    rows = [(" ".join(words[min(9, int(w))] for w in rng.geometric(0.3, rng.integers(0, 40)) - 1), ["en", "de", None, ""][rng.integers(0, 4)], ["a", "b", "C", None, "é"][rng.integers(0, 5)]) for _ in range(300)]
    rows += rows[:20] + [(None, "en", "empty"), ("", "fr", "only"), ("1 2 3 --", "es", "a"), ("lone", "es", "b"), ("word " * 50_000 + "Word", "en", "long")]
    df = spark.createDataFrame([(*r, 7, "y") for r in rows], "text string, lang string, source string, rank int, term string")
    got = {tuple(r) for r in divergence.source_divergence(df, min_documents=5, top_terms=4).collect()}
    assert got == _divergence(rows, 5, 4)


def test_tallies_and_joint_histograms_do_not_depend_on_their_pieces(monkeypatch):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{'abcdefgh'[int(w)]}" for w in rng.integers(0, 8, 30)).encode() for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array([["en", "de"][k % 2] for k in range(200)]), pa.array([f"s{k % 7}" for k in range(200)]), pa.array(texts)], ["lang", "source", "text"])
    held = [[{"source": f"s{s}", "n": int(n)} for s, n in zip(rng.permutation(9)[:k], rng.integers(1, 4, k))] for k in rng.integers(0, 9, 100)]
    kind = pa.list_(pa.struct({"source": pa.string(), "n": pa.int64()}))
    packed = pa.RecordBatch.from_arrays([pa.array([["en", "de"][k % 2] for k in range(100)]), pa.array(held, kind)], ["lang", "held"])

    def summed(batches):
        out = Counter()
        for b in batches:
            for *key, n in zip(*(c.to_pylist() for c in b.columns[: b.num_columns - (b.num_columns == 5)])):
                out[tuple(key)] += n
        return out

    whole = summed(divergence._tallies(iter([batch]))), summed(divergence._joint(iter([packed])))
    want = Counter()
    for k, row in enumerate(held):
        for x in row:
            for y in row:
                if x["source"] < y["source"]:
                    want[["en", "de"][k % 2], x["source"], y["source"], x["n"], y["n"]] += 1
    assert whole[1] == want
    monkeypatch.setattr(divergence, "AT_ONCE", 7)
    monkeypatch.setattr(divergence, "TALLIED", 3)
    assert (summed(divergence._tallies(iter([batch]))), summed(divergence._joint(iter([packed])))) == whole


def test_terms_are_never_cut(monkeypatch):
    text = ("Ab ÄB9c-" * 40 + "long" * 50).encode()
    whole = [w for piece in divergence.terms(text) for w in piece]
    monkeypatch.setattr(divergence, "PIECE", 3)
    assert [w for piece in divergence.terms(text) for w in piece] == whole == re.findall(rb"[a-z\x80-\xff]+", text.replace(b"A", b"a").replace(b"B", b"b"))


def test_divergence_of_nothing_and_shares_beyond_longs(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(empty).count() == 0
    got = spark.sql("SELECT 2 * 10000000000000L AS n, 30000000000000L AS total, 7L AS kept").select(F.expr(divergence._share("n", "total")).alias("p")).head()["p"]
    assert got == 1 + 10**9 * (2 * 10**13 + 5) // (3 * 10**13 + 35)
