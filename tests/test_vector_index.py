"""The stored vector index: searches against every pair worked out in numpy, what it reads, its upkeep."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lexilake.functions import vectors as V
from lexilake.operators import search as S
from lexilake.operators import vector_index as I
from lexilake.streaming import sources as Z

CHUNKS = "item_id bigint, user_id bigint, chunk_id bigint, embedding array<float>"


def _rows(n_items=40, dims=6, seed=5):
    rng = np.random.default_rng(seed)
    rows, chunk = [], 0
    for item in range(n_items):
        for _ in range(rng.choice([1, 2, 4])):  # so that means are exact
            vector = [float(np.float32(x)) for x in rng.integers(-2, 3, dims)]  # whole numbers: many ties
            rows.append((item, 1 if item < 30 else 2, chunk, vector))
            chunk += 1
    return rows


def _brute(rows, top, prefetch):
    items = sorted({(r[0], r[1]) for r in rows})
    out = set()
    for item, user in items:
        mean = np.mean([r[3] for r in rows if r[0] == item], axis=0)
        far = sorted((float(np.sqrt(((np.array(r[3]) - mean) ** 2).sum())), r[2], r[0]) for r in rows if r[1] == user and r[0] != item)
        best = {}
        for distance, _, other in far[:prefetch] if prefetch else far:
            best[other] = min(best.get(other, np.inf), distance)
        for rn, (other, distance) in enumerate(sorted(best.items(), key=lambda x: (x[1], x[0]))[:top], 1):
            out.add((item, other, round(distance, 6), rn))
    return out


@pytest.fixture
def indexed(spark, tmp_path):
    def made(rows, cells=I.CELLS):
        path = str(tmp_path / f"index{len(list(tmp_path.iterdir()))}")
        I.build(spark.createDataFrame(rows, CHUNKS), path, cells)
        return I.read(spark, path)

    return made


def _near(df):
    return {(r["item_a"], r["item_b"], round(r["distance"], 6), r["rn"]) for r in df.collect()}


@pytest.mark.parametrize("prefetch", [None, 9])
@pytest.mark.parametrize("block,cells", [(7, 64), (4096, 1), (11, 3)])
def test_neighbours_equal_every_pair(indexed, monkeypatch, prefetch, block, cells):
    monkeypatch.setattr(I, "BLOCK", block)
    monkeypatch.setattr(I, "AHEAD", 1)
    rows = _rows()
    index = indexed(rows, cells)
    got = I.neighbours(index, S.mean_vectors(index.rows), 4, prefetch)
    assert _near(got) == _brute(rows, 4, prefetch)
    within = I.neighbours(index, S.mean_vectors(index.rows), 4, prefetch, within=2.0).where("distance <= 2.0")
    assert _near(within) == {x for x in _brute(rows, 4, prefetch) if x[2] <= 2.0}


def test_nulls_a_lone_item_and_an_empty_table(indexed):
    rows = [(1, 1, 1, [1.0, 0.0]), (2, 2, 2, [1.0, 0.0]), (3, None, 3, [1.0, 0.0]), (4, 1, 4, None), (5, 1, 5, [None, 1.0]), (6, 1, 6, [float("nan"), 1.0])]
    for some, n in ((rows, 2), ([], 0)):
        index = indexed(some)
        assert index.rows.count() == n
        assert I.neighbours(index, S.mean_vectors(index.rows), 3).collect() == []
        near, reading = I.nearest_items(index, [0.0, 0.0], 1, 3)
        assert [r["item_id"] for r in near.collect()] == [1][:n] and reading.read <= reading.cells <= 1
    with pytest.raises(Exception, match="one width"):
        indexed([(1, 1, 1, [1.0]), (2, 1, 2, [1.0, 2.0])])


def test_pairs_of_rows_are_never_joined(indexed):
    index = indexed(_rows(6))
    plan = I.neighbours(index, S.mean_vectors(index.rows), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join Cross" not in plan


def _clustered(n=3000, dims=8):
    rng = np.random.default_rng(6)
    centres = 5 * rng.normal(size=(24, dims))
    x = centres[np.arange(n) % 24] + 0.05 * rng.normal(size=(n, dims))
    return [(k // 2, 1 + k // 2 % 2, k, [float(c) for c in np.float32(v)]) for k, v in enumerate(x)]


def test_one_query_reads_few_cells_and_keeps_ties_and_filters(spark, indexed):
    rows = _clustered()
    index = indexed(rows)
    chunks = spark.createDataFrame(rows, CHUNKS).where("user_id = 2")
    for k in (1, 500):
        query = rows[k][3]
        near, reading = I.nearest_items(index, query, 2, 5)
        assert near.collect() == S.nearest_items(chunks, V.literal(query), 5).collect()
        assert reading.read <= 0.3 * reading.cells
        odd, _ = I.nearest_items(index, query, 2, 5, lambda rows: rows.where("item_id % 7 = 1"))
        assert odd.collect() == S.nearest_items(chunks.where("item_id % 7 = 1"), V.literal(query), 5).collect()
        few, _ = I.nearest_chunks(index, query, 2, 9)
        assert [r["chunk_id"] for r in few.collect()] == [r["chunk_id"] for r in chunks.withColumn("d", V.l2(F.col("embedding"), V.literal(query))).orderBy("d", "chunk_id").limit(9).collect()]
        every, reading = I.nearest_items(index, query, 2, 10_000)
        assert every.count() == 750 and reading.read == reading.cells
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = I.nearest_items(index, query, 2, 5)[0]._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", before)
    assert "GreaterThanOrEqual(distance" in plan and "EqualTo(user_id,2)" in plan


def test_all_items_read_few_cells(indexed):
    rows = _clustered()
    index = indexed(rows)
    means = S.mean_vectors(index.rows).where("item_id < 60")
    seen = Observation(), Observation()
    out = I.neighbours(index, means, 3, readings=seen)
    got = {(r["item_a"], r["item_b"], r["rn"]) for r in out.collect()}
    x, ids, users = np.array([r[3] for r in rows]), np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for item in range(60):
        away = np.sqrt(((x - x[ids == item].mean(axis=0)) ** 2).sum(axis=1))
        away[(users != users[ids == item][0]) | (ids == item)] = np.inf
        best = list(dict.fromkeys(ids[np.argsort(away, kind="stable")]))[:3]
        assert {(item, b, k + 1) for k, b in enumerate(best)} <= got
    read = sum(s.get["n"] for s in seen)
    assert 60 <= read < 0.2 * 60 * len(index.centres)  # (item, cell) pairs


def test_upkeep_is_a_search_over_what_there_is(spark, tmp_path):
    rows = _rows(30)
    path, small = str(tmp_path / "index"), str(tmp_path / "small")
    I.build(spark.createDataFrame(rows, CHUNKS), path, 4)
    now = {r[2]: r for r in rows}
    batches = [([3, 4], [(3, 1, 900, [9.0] * 6), (77, 1, 901, [0.0] * 6)]), ([77, 5], [(77, 2, 902, [1.0] * 6)]), ([3], [])]
    for k, (gone, after) in enumerate(batches):
        now = {c: r for c, r in now.items() if r[0] not in gone} | {r[2]: r for r in after}
        for _ in range(2):  # a batch that comes twice changes nothing
            I.apply_batch(spark, path, spark.createDataFrame([(i,) for i in gone], "item_id bigint"), spark.createDataFrame(after, CHUNKS), k)
    I._write_vectors(spark.createDataFrame([(99, 1, 999, [0.0] * 6)], CHUNKS), I._centres(spark, path), path, 4)  # a generation that was not finished
    I.compact(spark, path, small)
    for where in (path, small):
        index = I.read(spark, where)
        assert {r["chunk_id"] for r in index.rows.collect()} == set(now)
        means = spark.createDataFrame([(1, 1, [0.5] * 6), (2, 2, [0.5] * 6)], "item_id bigint, user_id bigint, mean array<double>")
        want = set()
        for item, user in ((1, 1), (2, 2)):
            far = {}
            for other, u, _, v in now.values():
                if u == user and other != item:
                    far[other] = min(far.get(other, 1e9), float(np.sqrt(((np.array(v) - 0.5) ** 2).sum())))
            want |= {(item, o, round(d, 6), k + 1) for k, (o, d) in enumerate(sorted(far.items(), key=lambda x: (x[1], x[0]))[:5])}
        assert _near(I.neighbours(index, means, 5)) == want
        assert [r["item_id"] for r in I.nearest_items(index, [0.5] * 6, 2, 5)[0].collect()] == [o for _, o, _, _ in sorted((x for x in want if x[0] == 2), key=lambda x: x[3])]


def test_upkeep_from_a_stream_into_an_empty_index(spark, tmp_path):
    path, src = str(tmp_path / "index"), str(tmp_path / "src")
    I.build(spark.createDataFrame([], CHUNKS), path)
    spark.createDataFrame(_rows(12), CHUNKS).write.parquet(src)
    stream = spark.readStream.schema(CHUNKS).parquet(src)
    Z.run_once(stream, lambda batch, number: I.apply_batch(spark, path, batch.select("item_id"), batch, number), str(tmp_path / "state"))
    index = I.read(spark, path)
    assert _near(I.neighbours(index, S.mean_vectors(index.rows), 3)) == _brute(_rows(12), 3, None)


def test_nearest_label_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "LABEL_BLOCK", 2)
    monkeypatch.setattr(S, "LABELS_HELD", 3)
    labels = [(f"l{k}", [float(k == d) for d in range(5)]) for k in range(5)]
    queries = [(k, labels[k][1]) for k in range(5)] + [(9, [1.0, 1.0, 0.0, 0.0, 0.0])]
    q = spark.createDataFrame(queries, "query_id bigint, query_vector array<double>")
    got = S.nearest_label(q, spark.createDataFrame(labels, "label string, vector array<double>"), 0.5)
    assert {r["query_id"]: r["label"] for r in got.collect()} == {0: "l0", 1: "l1", 2: "l2", 3: "l3", 4: "l4", 9: "l0"}
