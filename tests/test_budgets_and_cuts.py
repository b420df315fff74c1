"""Byte caps over fields, keyword snippets and budgeted requests against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexilake.functions import fields as P
from lexilake.functions import urls as U
from lexilake.operators import decisions as X
from lexilake.operators import evals as E
from lexilake.operators import search as S


def _cut(text, most):
    return max((text[:k] for k in range(len(text) + 1) if len(text[:k].encode()) <= max(0, most)), key=len)


def test_fields_within_a_cap_by_brute_force(spark):
    rng = random.Random(3)
    some = lambda: rng.choice([None, "", "".join(rng.choice("aé日🙂\n") for _ in range(rng.randrange(90)))])
    rows = [(k, some(), some(), some()) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, html string, transcript string, caption string")
    marker = "…cut"
    got = {r["id"]: tuple(r["x"]) for r in df.select("id", P.byte_capped({c: F.col(c) for c in df.columns[1:]}, 120, marker).alias("x")).collect()}
    for k, *own in rows:
        total = sum(len((t or "").encode()) for t in own)
        want = []
        for t in own:
            if t is None or total <= 120:
                want.append(t)
                continue
            kept = _cut(t, int(120 * (len(t.encode()) / total)) - len(marker.encode()))
            want.append(kept + marker if len(kept) < len(t) else kept)
        assert got[k] == (*want, total > 120)
    assert sum(x[3] for x in got.values()) > 20


def _snippet(columns, tokens, most):
    best = None
    for place, text in enumerate(columns):
        pieces = re.findall(r"[\ẁ-ͯ]+[^\w]*", text or "")
        words = [re.match(r"\w+", p)[0].lower() for p in pieces]
        which = [{t for t in tokens if w.startswith(t)} for w in words]
        for at in range(len(words)):
            if which[at]:
                n = len(set().union(*which[at : at + most]))
                if best is None or (-n, place, at) < best[:3]:
                    text = ("…" if at else "") + "".join(pieces[at : at + most]).rstrip() + ("…" if at + most < len(pieces) else "")
                    best = (-n, place, at, text)
    return best and best[3]


@pytest.mark.parametrize("most", [3, 7, 24])
def test_snippets_by_brute_force(spark, most):
    rng = random.Random(most)
    words = ["data", "Lake", "dates", "laker", "x", "yy", "Zed,", "spark.", "(river)", "n1"]
    text = lambda n: rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randrange(n)))])
    rows = [(k, text(6), text(60)) for k in range(150)]
    df = spark.createDataFrame(rows, "id int, title string, content string")
    tokens = ["dat", "lake", "spar", "river"]
    got = {r["id"]: r["s"] for r in df.select("id", S.keyword_snippet(["title", "content"], tokens, most).alias("s")).collect()}
    assert got == {k: _snippet(own, tokens, most) for k, *own in rows}
    assert df.select(S.keyword_snippet(["title"], [], most).alias("s")).where("s is not null").count() == 0


def test_all_punctuation_behind_a_url_goes(spark):
    said = ["https://a.org/x!!!!!!!!!", "https://a.org/x" + ".,;:" * 50, "https://a.org/(x)", "(https://a.org/x))))", "https://a.org/x", ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "id int, t string")
    got = [r["u"] for r in df.select("id", U.trimmed_url(F.col("t")).alias("u")).orderBy("id").collect()]
    assert got == ["https://a.org/x", "https://a.org/x", "https://a.org/(x)", "(https://a.org/x)", "https://a.org/x", ""]


def counted(where):
    """An embedder that notes each call in a shared folder."""

    class Counted(X.HashEmbedder):
        def embed(self, texts):
            with open(f"{where}/{random.getrandbits(60)}", "w") as f:
                f.write(str(len(texts)))
            return X.HashEmbedder.embed(self, texts)

    return Counted(8)


@pytest.mark.parametrize("left,calls", [(0, 0), (3, 3), (100, 6)])
def test_no_more_requests_than_are_left(spark, tmp_path, left, calls):
    chunks = spark.createDataFrame([(k, None if k == 4 else f"text {k}") for k in np.random.default_rng(1).permutation(53).tolist()], "chunk_id bigint, text string")
    made, refused = X.embedded_within(chunks, counted(str(tmp_path)), ("chunk_id",), left, batch=10, block=7)
    kept = made.collect()
    assert sorted(r["chunk_id"] for r in kept) == list(range(min(53, 10 * calls)))
    assert all(r["batch"] == r["chunk_id"] // 10 and len(r["embedding"]) == 8 for r in kept)
    assert sorted(r["chunk_id"] for r in refused.collect()) == list(range(min(53, 10 * calls), 53))
    assert sorted(int(p.read_text()) for p in tmp_path.iterdir()) == sorted([10, 10, 10, 10, 10, 3][:calls])
    assert X.embedded_within(chunks.limit(0), counted(str(tmp_path)), ("chunk_id",), 5)[0].count() == 0
    assert (X.requests_left(30, 5, 4, "background"), X.requests_left(30, 5, 4, "interactive"), X.requests_left(30, 5, 40, "interactive")) == (21, 26, 0)


def test_declining_where_nothing_is_stored(spark):
    rows = [(1, False, False, False, False), (2, True, True, False, False), (3, True, False, True, True), (4, False, True, True, False), (5, True, True, True, True)]
    df = spark.createDataFrame(rows, "id int, grounded boolean, refusal boolean, marked boolean, valid boolean")
    got = {r["id"]: r["s"] for r in df.select("id", E.declined_score(F.col("grounded"), F.col("refusal"), F.col("marked"), F.col("valid")).alias("s")).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 1.0}
