import json

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lexilake.functions import fields as P
from lexilake.functions import text as T
from lexilake.functions import times as TM
from lexilake.operators import decisions as X
from lexilake.operators import evals as E
from lexilake.operators import ingest as G
from lexilake.operators import library as L
from lexilake.operators import rag as R
from lexilake.operators import search as S
from lexilake.plans import answer_queries, decision_queries
from lexilake.sources import tables as D


def test_keyword_search_does_not_shuffle_the_items(spark, sf):
    items = S.tokenized(D.items(spark, sf), "title", "content")
    plan = S.bm25(items, ["the", "of"], F.col("user_id") == 1).orderBy("rank", "item_id").limit(5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "CartesianProduct" not in plan


def test_no_tokens_no_hits(spark, sf):
    assert S.bm25(S.tokenized(D.items(spark, sf), "content"), []).count() == 0


def test_fusion_by_hand(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "a", 2)], "item_id int, source string, rn int")
    b = spark.createDataFrame([(2, "b", 1), (3, "b", 2)], "item_id int, source string, rn int")
    got = S.fused(a, b).collect()
    assert [r["item_id"] for r in got] == [2, 1, 3]
    assert got[0]["score"] == pytest.approx(1 / 62 + 1 / 61)
    assert got[0]["ranks"] == {"a": 2, "b": 1}


def test_pages_neither_skip_nor_repeat(spark):
    results = spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "item_id int, score double")
    seen, cursor = [], None
    while page := S.page_after(results, 8, cursor).collect():
        seen += [r["item_id"] for r in page]
        cursor = (page[-1]["score"], page[-1]["item_id"])
    assert len(seen) == len(set(seen)) == 50


def test_cursors(spark):
    assert S.decode_cursor(S.encode_cursor(score=0.5, id=3)) == {"score": 0.5, "id": 3}
    assert S.decode_cursor("%%%") is None
    with pytest.raises(ValueError):
        S.decode_cursor("%%%", on_bad="error")
    assert [S.clamped_limit(x) for x in (None, float("nan"), 0, 7.9, 1000)] == [20, 20, 1, 7, 100]


def test_budget_stops_at_the_first_overflow_but_clips_a_first(spark):
    rows = [(1, 1, 50), (1, 2, 60), (1, 3, 10), (2, 1, 500), (2, 2, 1), (3, 1, 100)]
    out = R.within_budget(spark.createDataFrame(rows, "query_id int, rank int, tokens int"), 100).orderBy("query_id", "rank").collect()
    assert [r["included"] for r in out] == [True, False, False, True, False, True]
    assert [r["clipped"] for r in out] == [False, False, False, True, False, False]


def test_scope(spark, sf):
    for bad in (0, -1, True, "1", None):
        with pytest.raises(ValueError):
            L.require_user_id(bad)
    assert {r["user_id"] for r in L.scoped(D.items(spark, sf), 2, None).select("user_id").distinct().collect()} == {2}


def test_filters_count():
    assert L.Filters(kinds=("a", "b"), created_from=1, created_to=2, tags=("x",)).active() == 4


def test_writes(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    patch = spark.createDataFrame([(2, "c", 1), (3, "d", 0)], "k int, v string, t int")
    assert {(r["k"], r["v"]) for r in L.upserted(base, patch, ["k"], "t").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {(r["k"], r["v"]) for r in L.inserted_if_absent(base, patch, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}
    assert {r["k"] for r in L.deleted(base, patch, ["k"]).collect()} == {1}


def test_precision_and_recall_by_hand(spark):
    ranked = spark.createDataFrame([(1, 1, True, 10), (1, 2, False, 11), (1, 3, True, 12), (2, 1, False, 13)], "query_id int, rn int, relevant boolean, item_id int")
    got = {r["query_id"]: r["precision"] for r in E.context_precision(ranked).collect()}
    assert got == {1: pytest.approx((1 + 2 / 3) / 2), 2: 0.0}
    relevant = spark.createDataFrame([(1, 10), (1, 12), (1, 99)], "query_id int, item_id int")
    assert {r["query_id"]: r["recall"] for r in E.recall(ranked, relevant).collect()} == {1: pytest.approx(2 / 3), 2: 1.0}


def test_free_slugs_by_hand(spark):
    wanted = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 1, "a"), (4, 1, "a-2"), (5, 1, "b"), (6, 1, "c-1"), (7, 2, "a"), (8, 2, "b"), (9, 1, "a")], "id int, user_id int, slug string")
    taken = spark.createDataFrame([(1, "b"), (1, "b-3"), (1, "a-3"), (2, "b"), (2, "b-2"), (2, "b-3"), (2, "b-4"), (2, "b-5")], "user_id int, slug string")
    got = {r["id"]: r["free"] for r in L.free_slugs(wanted, taken).collect()}
    assert got == {1: "a", 2: "a-4", 3: "a-5", 4: "a-2", 5: "b-2", 6: "c-1", 7: "a", 8: None, 9: None}  # five numbers, each user's own
    assert {r["id"]: r["free"] for r in L.free_slugs(wanted, taken, None).collect()} == got | {8: "b-6", 9: "a-6"}
    assert L.free_slugs(wanted, taken.limit(0)).where("id = 5").head()["free"] == "b"


def test_retry_codes_and_enrichment_by_hand(spark):
    codes = {"rate_limited": True, "blocked": True, "network_error": True, "unsupported_url": False, "not_found": False, "invalid_pdf": False}
    asked = spark.createDataFrame([(c,) for c in codes], "code string")
    assert {r["code"]: r["ok"] for r in asked.select("code", X.may_retry(F.col("code")).alias("ok")).collect()} == codes
    fine = {"tldr": "t", "bullets": ["a", "b", "c"], "tags": ["x", "y", "z"], "topic": "q", "confidence": 0.5}
    repo = {"kindFields": {"what_it_does": "w", "primary_use_case": "u"}}
    cases = [
        (fine, "article", True), (fine, "github", False), (fine | repo, "github", True), (fine | {"language": "c", "license": "mit"}, "github", False), (fine | {"bullets": ["a", "", "c"]}, "article", False),
        (fine | {"bullets": ["a", "b" * 401, "c"]}, "article", False), (fine | {"tags": ["x", "y", "z" * 41]}, "article", False), (fine | {"topic": ""}, "article", False), (fine | {"kindFields": {"what_it_does": "w" * 301, "primary_use_case": "u"}}, "github", False), ({"tldr": "t"}, "article", False),
    ]
    asked = spark.createDataFrame([(k, json.dumps(c), kind) for k, (c, kind, _) in enumerate(cases)], "k int, said string, kind string")
    assert [r["ok"] for r in asked.orderBy("k").select(P.enrichment_ok(F.col("said"), F.col("kind")).alias("ok")).collect()] == [ok for _, _, ok in cases]


def test_compact_numbers_and_cuts_by_hand(spark):
    said = {999: "999", 1000: "1K", 91_557: "91.6K", 999_949: "999.9K", 999_950: "1M", 1_250_000: "1.3M", 999_950_000: "1B", 2_500_000_000: "2.5B", 7_000_000_000_000: "7T"}
    asked = spark.createDataFrame([(n,) for n in said], "n bigint")
    assert {r["n"]: r["c"] for r in asked.select("n", TM.compact(F.col("n")).alias("c")).collect()} == said
    cut = spark.createDataFrame([("a\U0001f642b\U0001f642c",)], "t string").select(*[T.utf16_left(F.col("t"), F.lit(k)).alias(f"l{k}") for k in range(1, 8)], *[T.utf16_right(F.col("t"), F.lit(k)).alias(f"r{k}") for k in (1, 2, 3, 4)]).head()
    assert tuple(cut) == ("a", "a", "a\U0001f642", "a\U0001f642b", "a\U0001f642b", "a\U0001f642b\U0001f642", "a\U0001f642b\U0001f642c", "c", "c", "\U0001f642c", "b\U0001f642c")


def test_chunks_overlap_and_keep_sentences():
    text = " ".join(f"Sentence number {i} says a few plain words about nothing much at all." for i in range(120))
    windows = G.windows_of(text)
    assert len(windows) > 2
    assert all(w.split(". ")[-1].rstrip(".") in windows[k + 1] for k, w in enumerate(windows[:-1]))
    assert G.windows_of("  ") == [] and G.windows_of("short. One.") == ["short. One."]


CHAT = """﻿before anything
[13/09/2026, 4:35:12 PM] Ann: hello
and more

[13/09/2026, 4:36:00 PM] Ann joined
[31/02/2026, 4:36:00 PM] Bob: never
lost line
45/45/2026, nonsense
[13/09/2026, 12:01:00 AM] Bob: see: this"""


def test_chat_export(spark):
    files = spark.createDataFrame([("f", CHAT)], "file string, text string")
    messages, skipped = G.chat_parsed(G.chat_lines(files))
    got = [(r["line"], r["author"], r["text"], r["is_system"]) for r in messages.orderBy("line").collect()]
    assert got == [(2, "Ann", "hello\nand more", False), (5, None, "Ann joined", True), (9, "Bob", "see: this", False)]
    assert messages.where("line = 2").head()["ms"] == 1789317312000
    assert [(r["line"], r["reason"]) for r in skipped.orderBy("line").collect()] == [
        (1, "before any message"), (6, "invalid date or time"), (7, "no message to attach to"), (8, "unknown header"),
    ]


def test_month_first_dates_are_told_by_one_line(spark):
    files = spark.createDataFrame([("f", "01/02/2026, 10:00 - A: x\n01/25/2026, 10:00 - A: y")], "file string, text string")
    messages, _ = G.chat_parsed(G.chat_lines(files))
    assert [r["ms"] for r in messages.orderBy("line").collect()] == [1767348000000, 1769335200000]


def test_zipped_export(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("x/_chat.txt", "zipped")
    (tmp_path / "a.zip").write_bytes(data.getvalue())
    (tmp_path / "b.txt").write_text("plain")
    assert {r["text"] for r in G.chat_exports(spark, str(tmp_path)).collect()} == {"zipped", "plain"}


def test_page_meta_and_ladder(spark):
    page = '<html><head><title>T &amp; U</title><meta property="og:description" content="about"></head><body><script>var t="</p>";</script><p>few words</p></body></html>'
    row = G.extracted(spark.createDataFrame([(1, "http://a.org/x-y.html", page)], "page_id int, url string, html string")).head()
    assert (row["title"], row["tier"], row["text"]) == ("T & U", "partial", "about")
    row = G.extracted(spark.createDataFrame([(1, "http://a.org/x-y.html", "<p>few</p>")], "page_id int, url string, html string")).head()
    assert (row["title"], row["tier"], row["text"]) == ("x y", "metadata_only", None)


def test_a_cut_reference_counts_as_it_stands(spark):
    page = f"<article><h1>cut &amp</h1><p>{'word ' * 100}</p></article>"
    row = G.extracted(spark.createDataFrame([(1, "http://a.org/x", page)], "page_id int, url string, html string")).head()
    assert (row["tier"], row["text"]) == ("full", f"cut &amp {'word ' * 100}".strip())


def test_short_links_resolve_once(spark):
    links = [(1, "https://bit.ly/a"), (2, "https://bit.ly/b"), (3, "https://ex.org/x"), (4, "https://ex.org/x"), (5, None), (6, "https://bit.ly/a")]
    targets = [("https://bit.ly/a", "https://to.org/2"), ("https://bit.ly/a", "https://to.org/1"), ("https://ex.org/x", "https://to.org/3"), ("https://ex.org/x", "https://to.org/4"), (None, "https://to.org/5")]
    out = X.unshortened(spark.createDataFrame(links, "id int, url string"), spark.createDataFrame(targets, "url string, target string"))
    assert sorted((r["id"], r["resolved"]) for r in out.collect()) == [(1, "https://to.org/1"), (2, "https://bit.ly/b"), (3, "https://ex.org/x"), (4, "https://ex.org/x"), (5, None), (6, "https://to.org/1")]


def test_precision_does_not_hang_on_the_order_of_rows(spark, tmp_path):
    rows = [(i + k * 100_070, 1 - k, 0) for k in (0, 1) for i in range(200)]  # pairs that share a query and a sort key
    got = []
    for name, own in (("a", rows), ("b", rows[::-1])):
        spark.createDataFrame(own, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / name / "labels.parquet"))
        got.append(sorted(map(tuple, answer_queries.eval_precision_recall(spark, str(tmp_path / name)).collect())))
    # of each pair the smaller id comes first: hits at 1, 3, 5, ...
    want = round(sum((k + 1) / (2 * k + 1) for k in range(10)) / 10, 6)
    assert got[0] == got[1] == [(q, want, 0.5) for q in range(10)]


def test_indexes_are_compared_in_parts(spark, monkeypatch):
    columns = "term string, item_id int, tf bigint, dl int"
    stored = spark.createDataFrame([("a", 1, 1, 9), ("a", 1, 1, 9), ("a", 2, 1, 9), ("b", 1, 2, 9), ("c", 5, 1, 9), ("c", 5, 1, 9)], columns)
    fresh = spark.createDataFrame([("a", 1, 1, 9), ("a", 2, 1, 9), ("b", 1, 3, 9), ("c", 5, 1, 9), ("c", 5, 1, 9), ("d", 4, 1, None), ("d", 4, 1, None)], columns)
    want = [("a", 1, 1, 9, "stored"), ("b", 1, 2, 9, "stored"), ("b", 1, 3, 9, "fresh"), ("d", 4, 1, None, "fresh"), ("d", 4, 1, None, "fresh")]
    for parts in (1, 65_536):
        monkeypatch.setattr(X, "SYNC_PARTS", parts)
        got = X.index_in_sync(stored, fresh)
        assert sorted(map(tuple, got.select("term", "item_id", "tf", "dl", "side").collect()), key=str) == sorted(want, key=str)
        assert X.index_in_sync(stored, stored).count() == 0


def test_index_and_embeddings_cover_all_items(spark, sf):
    items = D.items(spark, sf)
    tokens = S.tokenized(items, "title", "lang", "source", "content")
    # the stored index lacks one term; every item that has it is out of sync
    got = [tuple(r) for r in decision_queries.index_sync(spark, sf).select("side", "term", "n").collect()]
    assert got == [("fresh", "the", tokens.where(F.array_contains("tokens", "the")).count())]
    made = decision_queries.embedded_chunks(spark, sf).agg(F.sum("n")).head()[0]
    assert made == G.chunked(items).count() > G.chunked(items.where("item_id < 100")).count()
