"""What stands in for what is not there: titles, query vectors, transcript lines."""

import pytest
from pyspark.sql import functions as F

from lexilake.functions import fields as P
from lexilake.functions import urls as U
from lexilake.operators import search as S


def test_fallback_titles_by_hand(spark):
    said = {
        "https://a.org/x/My%20file%C3%A9.pdf?q=1/2#z/y": "My fileé.pdf", "https://a.org/x//": "x", "https://a.org/a+b": "a+b", "https://a.org": "https://a.org", "https://a.org/?q=/x": "https://a.org/?q=/x",
        "no url": "no url", "https://a.org/50%": "https://a.org/50%", "https://a.org/%FF": "https://a.org/%FF", "": "",
    }
    df = spark.createDataFrame([(u,) for u in [*said, None]], "u string")
    assert {r["u"]: r["t"] for r in df.select("u", U.fallback_title(F.col("u")).alias("t")).collect()} == {**said, None: None}


def test_transcript_lines(spark):
    df = spark.createDataFrame([([("0:18 ", " first\n"), ("0:20", "  "), ("1:02:03", "then"), (None, "x"), ("9", None)],), ([],), (None,)], "s array<struct<timestamp: string, text: string>>")
    assert [r["t"] for r in df.select(P.transcript_lines(F.col("s")).alias("t")).collect()] == ["[0:18] first\n[1:02:03] then\n[] x", "", None]


def test_search_without_an_embedder_is_keyword_search(spark, caplog):
    keyword = spark.createDataFrame([(1, -3.0), (2, -2.0)], "item_id int, rank double")
    vector = lambda q: spark.createDataFrame([(3, q[0]), (2, 0.5)], "item_id int, distance double")
    page, tier = S.searched(keyword, lambda: [0.1], vector, 5)
    assert tier == "hybrid" and [r["item_id"] for r in page.collect()] == [2, 1, 3]

    def broken():
        raise TimeoutError("no answer")

    page, tier = S.searched(keyword, broken, vector, 5)
    assert tier == "fts" and [r["item_id"] for r in page.collect()] == [1, 2]
    assert "no answer" in caplog.text
    page, _ = S.searched(keyword, broken, vector, 5, cursor=(pytest.approx(1 / 61).expected, 1))
    assert [r["item_id"] for r in page.collect()] == [2]
