"""The stored keyword index: against scores without it, its plan, its upkeep in a stream."""

import math

import pytest
from pyspark.sql import functions as F

from lexilake.functions import text as T
from lexilake.operators import keyword_index as K
from lexilake.operators import search as S
from lexilake.plans import search_queries
from lexilake.sources import tables as D
from lexilake.streaming import sources as Z


def _items(spark, rows):
    return S.tokenized(spark.createDataFrame(rows, "item_id int, text string"), "text").select("item_id", "tokens")


def _ranks(df):
    return {r["item_id"]: r["rank"] for r in df.collect()}


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    items = S.tokenized(D.items(spark, sf), "title", "content").select("item_id", "tokens")
    path = str(tmp_path_factory.mktemp("index"))
    K.build(items, path)
    return items, path


def test_scores_are_those_without_an_index(spark, stored):
    items, path = stored
    index = K.read(spark, path)
    asked = spark.createDataFrame([(1, ["the", "th"]), (2, ["der"]), (3, ["nowhere"]), (4, [])], "query_id int, tokens array<string>")
    many = {(r["query_id"], r["item_id"]): r["rank"] for r in K.search_many(index, asked).collect()}
    for query, tokens in ((1, ["the", "th"]), (2, ["der"]), (3, ["nowhere"]), (4, [])):
        own, one = _ranks(S.bm25(items, tokens)), _ranks(K.search(index, tokens))
        assert own == pytest.approx(one)
        assert own == pytest.approx({i: x for (q, i), x in many.items() if q == query})


def test_rank_by_hand(spark, tmp_path):
    K.build(_items(spark, [(1, "apple pie"), (2, "Äpple apples and pears"), (3, ""), (4, None), (5, "plum")]), str(tmp_path))
    got = _ranks(K.search(K.read(spark, str(tmp_path)), ["apple"]))
    idf, avgdl = math.log((5 - 2 + 0.5) / (2 + 0.5)), 7 / 5  # items without tokens count as items
    want = {i: -idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) for i, f, dl in ((1, 1, 2), (2, 2, 4))}
    assert got == pytest.approx(want)


def test_prefixes_reach_the_scan(spark, stored):
    plan = K.search(K.read(spark, stored[1]), ["data", "lake"])._jdf.queryExecution().toString()
    assert "StringStartsWith(term,data)" in plan and "CartesianProduct" not in plan


def test_an_empty_table(spark, tmp_path):
    K.build(_items(spark, []), str(tmp_path))
    index = K.read(spark, str(tmp_path))
    assert K.search(index, ["a"]).count() == 0
    assert index[1].head()["n"] == 0


def test_upkeep_is_a_new_build(spark, tmp_path):
    path, then, fresh, small = (str(tmp_path / d) for d in ("index", "then", "fresh", "small"))
    old = {k: f"word{k % 3} apple{k}" for k in range(8)}
    K.build(_items(spark, list(old.items())), path)
    batches = [({2: "pear word1", 9: "new apple"}, [5]), ({9: "newer", 5: "back again"}, [0])]
    for k, (changed, removed) in enumerate(batches):
        before = [(i, old[i]) for i in [*changed, *removed] if i in old]
        for i in removed:
            del old[i]
        old |= changed
        for _ in range(2):  # a batch that comes twice changes nothing
            K.apply_batch(spark, path, _items(spark, before), _items(spark, list(changed.items())), k)
    K.build(_items(spark, list(old.items())), fresh)
    K.compact(spark, path, small)
    for where in (path, small):
        rows, stats = K.read(spark, where)
        want, sizes = K.read(spark, fresh)
        assert rows.select(*want.columns).exceptAll(want).count() == want.exceptAll(rows.select(*want.columns)).count() == 0
        assert stats.head() == sizes.head()
    K._write_postings(_items(spark, [(77, "apple")]), path, 3)  # a generation that was not finished
    assert K.read(spark, path)[0].where("item_id = 77").count() == 0


def test_upkeep_from_a_stream(spark, tmp_path):
    path, src = str(tmp_path / "index"), str(tmp_path / "src")
    K.build(_items(spark, [(1, "old words"), (2, "kept")]), path)
    known = _items(spark, [(1, "old words"), (2, "kept")])
    spark.createDataFrame([(1, "fresh words"), (3, "third")], "item_id int, text string").write.parquet(src)
    stream = spark.readStream.schema("item_id int, text string").parquet(src)

    def keep_up(batch, number):
        after = S.tokenized(batch, "text").select("item_id", "tokens")
        K.apply_batch(spark, path, known.join(batch.select("item_id"), "item_id", "left_semi"), after, number)

    Z.run_once(stream, keep_up, str(tmp_path / "state"))
    rows, stats = K.read(spark, path)
    assert {(r["item_id"], r["term"]) for r in rows.collect()} == {(1, "fresh"), (1, "words"), (2, "kept"), (3, "third")}
    assert (stats.head()["n"], stats.head()["avgdl"]) == (3, pytest.approx(4 / 3))


def test_folding(spark):
    said = "Ünïcode čšž ĄĆ été ŐŰ ș İstanbul ά 日本 x2"
    got = spark.range(1).select(T.index_tokens(F.lit(said)).alias("t")).head()["t"]
    assert got == ["unicode", "csz", "ac", "ete", "ou", "s", "istanbul", "ά", "日本", "x2"]


def test_snippet_is_source_text(spark):
    rows = [(1, "A title", "One, Twó; three (four) five."), (2, "Two!", "nothing"), (3, None, None), (4, "", "zero one")]
    df = spark.createDataFrame(rows, "item_id int, title string, content string")
    got = {r["item_id"]: r["s"] for r in df.select("item_id", S.keyword_snippet(["title", "content"], ["tw", "four"], 3).alias("s")).collect()}
    assert got == {1: "…Twó; three (four)…", 2: "Two!", 3: None, 4: None}


def test_postings_are_counted_without_a_shuffle(spark):
    items = _items(spark, [(1, "b a b ab a b"), (2, ""), (3, None), (4, "x")])
    rows = K.postings(items)
    assert "Exchange" not in rows._jdf.queryExecution().toString()
    assert sorted(map(tuple, rows.select("term", "item_id", "tf", "dl").collect())) == [("a", 1, 2, 6), ("ab", 1, 1, 6), ("b", 1, 3, 6), ("x", 4, 1, 1)]


def test_many_queries_shuffle_the_longest_prefix_of_a_posting(spark, tmp_path):
    texts = ["abcd abce abx", "ab a b", "abc abcd", "zz", None]
    K.build(_items(spark, list(enumerate(texts))), str(tmp_path))
    index = K.read(spark, str(tmp_path))
    asked = {1: ["a", "ab", "abc", "abcd"], 2: ["abc", "z"], 3: ["a"], 4: []}
    many = {(r["query_id"], r["item_id"]): r["rank"] for r in K.search_many(index, spark.createDataFrame(list(asked.items()), "query_id int, tokens array<string>")).collect()}
    want = {(q, i): x for q, tokens in asked.items() for i, x in _ranks(S.bm25(_items(spark, list(enumerate(texts))), tokens)).items()}
    assert many == pytest.approx(want)
    plan = K.search_many(index, spark.createDataFrame(list(asked.items()), "query_id int, tokens array<string>"))._jdf.queryExecution().toString()
    assert "hashpartitioning(query_id" not in plan


def test_a_page_by_keywords_alone_reads_no_vectors(spark, sf, monkeypatch):
    def refused(*_):
        raise AssertionError("the vector index was asked")

    monkeypatch.setattr(search_queries, "vector_index", refused)
    assert search_queries.fts_only_page(spark, sf).count() > 0


def test_postings_are_counted_some_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(K, "TOKENS", 3)
    rows = [(9, ["b", "é", "b"]), (2, []), (7, None), (5, ["b"]), (1, ["z", "\U0001f600", "￿", "b"]), (3, ["b", "a", "a", "a", "a"])]
    items = spark.createDataFrame(rows, "item_id int, tokens array<string>").coalesce(1)
    own = K.postings(items)
    want = sorted((t, i, ts.count(t), len(ts)) for i, ts in rows if ts for t in set(ts))
    assert sorted(map(tuple, own.collect())) == want
    assert "ArrayTransform" not in own._jdf.queryExecution().toString() and "transform(" not in own._jdf.queryExecution().toString()  # no token goes through a lambda
    batches = list(K._counted(iter([items.toArrow().to_batches()[0]])))
    assert len(batches) > 1
    for b in batches:
        keys = [(t.encode(), i) for t, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert keys == sorted(keys)


def test_a_search_reads_its_postings_once(spark, sf, stored):
    own = D.items(spark, sf).where("user_id = 1").select("item_id")
    found = K.search(K.read(spark, stored[1]), ["the", "th", "der"]).join(own, "item_id").select("item_id", "rank")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = [line for line in plan.split("\n") if "parquet" in line and "term#" in line]
    assert len(scans) == 1 and "ReusedExchange" in plan
    assert set(_ranks(found)) == set(_ranks(S.bm25(stored[0], ["the", "th", "der"]).join(own, "item_id")))
