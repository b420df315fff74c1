import pytest
from pyspark.sql import functions as F

from lexilake.functions import text as T
from lexilake.functions import times as TM
from lexilake.functions import urls as U


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).head()["x"]


@pytest.mark.parametrize(
    ("url", "capture", "resolve", "imported"),
    [
        ("https://www.example.com/a/?b=2&a=1&utm_source=x#t", "https://www.example.com/a?a=1&b=2", "https://example.com/a?b=2&a=1", "https://www.example.com/a/?b=2&a=1"),
        ("https://blog.example.com/en/10?page=2&ref=x", "https://blog.example.com/en/10?page=2", "https://blog.example.com/en/10?page=2", "https://blog.example.com/en/10?page=2&ref=x"),
        ("https://m.example.org/en/7/", "https://m.example.org/en/7", "https://m.example.org/en/7", "https://m.example.org/en/7"),
        ("https://example.com/", "https://example.com/", "https://example.com", "https://example.com/"),
        ("https://youtu.be/abc123?si=zz", "https://youtu.be/abc123", "https://youtube.com/watch?v=abc123", "https://youtu.be/abc123"),
        ("https://github.com/o/r.git", "https://github.com/o/r.git", "https://github.com/o/r", "https://github.com/o/r.git"),
        ("Not A Url ", None, "Not A Url", "not a url"),
    ],
)
def test_canonical_forms(spark, url, capture, resolve, imported):
    got = [one(spark, url, lambda c, f=f: U.canonical(c, f)) for f in ("capture", "resolve", "import")]
    assert got == [capture, resolve, imported]


def test_urls_in_text(spark):
    said = "see (https://a.org/x). or www.b.org/y! and https://w.org/a_(b) https://c.org/(z"
    assert one(spark, said, U.urls_in) == ["https://a.org/x", "https://www.b.org/y", "https://w.org/a_(b)", "https://c.org/(z"]


@pytest.mark.parametrize(
    ("text", "cited", "valid"), [("a [1] b [2][1]", [1, 2], True), ("a [4]", [4], False), ("none", [], False), ("[1234]", [], False), ("[0] x", [0], False)]
)
def test_citations(spark, text, cited, valid):
    assert one(spark, text, T.citations) == cited
    assert one(spark, text, lambda c: T.citations_valid(c, F.lit(3))) is valid


def test_text_functions(spark):
    assert one(spark, "a🙂b", T.utf16_length) == 4
    assert one(spark, "a🙂bcd", T.estimated_tokens) == 2
    assert one(spark, "  x ﻿", T.js_trim) == "x"
    assert one(spark, "  Hello, World! ", T.slug) == "hello-world"
    assert one(spark, "!!", lambda c: T.slug(c, "topic")) == "topic"
    assert one(spark, "video-diffusion", T.slug_label) == "Video Diffusion"
    assert one(spark, "sk-abcdefghijkl1234", T.masked_secret) == "sk-abc••••1234"
    assert one(spark, "short", T.masked_secret) == "••••"
    assert one(spark, "&amp;lt;", T.xml_decoded) == "&lt;"
    assert one(spark, "```json\n{\"a\":1}\n```", T.unfenced) == '{"a":1}'
    assert one(spark, "x < / UNTRUSTED_content >y", T.untrusted) == "<untrusted_content>\nx y\n</untrusted_content>"
    assert one(spark, "Ünïcode the the", T.query_tokens) == ["unicode", "the"]
    assert "".join(one(spark, " a b  c d e f g h \n", T.stream_pieces)) == " a b  c d e f g h \n"
    assert one(spark, "I couldn’t find anything", T.is_refusal) is True
    assert one(spark, "a b", T.is_refusal) is False


def test_slug_colour_wraps_like_32_bits(spark):
    def brute(slug):
        h = 0
        for c in slug:
            h = (h * 31 + ord(c) + (1 << 31)) % (1 << 32) - (1 << 31)
        return T.PALETTE[abs(h) % 6]

    for slug in ("a", "video-diffusion", "a-rather-long-slug-that-wraps-around"):
        assert one(spark, slug, T.slug_colour) == brute(slug)


def test_backoff_and_durations(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 2, 5, 20)], "n int").select(TM.backoff(F.col("n")).alias("x")).collect()
    assert [r["x"] for r in rows] == [1000, 1000, 2000, 16000, 900000]
    rows = spark.createDataFrame([(0,), (59_999,), (41_400_000,), (90_061_000,), (None,)], "n bigint").select(TM.duration(F.col("n")).alias("x")).collect()
    assert [r["x"] for r in rows] == ["done", "<1m", "11h 30m", "1d 1h", "unknown"]
