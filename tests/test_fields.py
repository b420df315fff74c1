import pytest
from pyspark.sql import functions as F

from lexilake.functions import fields as P
from lexilake.operators import decisions as X


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).head()["x"]


def test_repository_payload(spark):
    said = '{"full_name":"o/r","description":null,"language":"C","stargazers_count":7,"license":{"name":"MIT"},"owner":{"login":"o"}}'
    assert tuple(one(spark, said, P.repository)) == ("o/r", None, "C", 7, "MIT")
    assert one(spark, '{"title":"t","author_name":"a"}', P.embedded)["author_name"] == "a"


def test_transcript(spark):
    said = '{"events":[{"segs":[{"utf8":"a\\n"},{"utf8":"b"}]},{"tStartMs":3},{"segs":[{"utf8":"\\n"}]},{"segs":[{"utf8":"c"}]}]}'
    assert one(spark, said, P.transcript) == "a b c"


def test_atom_entry(spark):
    xml = '<feed><title>no</title><entry><title>A &amp;\n B</title><summary> s </summary><published>2024-01-02</published><author><name>X</name></author><author><name>Y</name></author><category term="cs.DB"/></entry></feed>'
    got = one(spark, xml, P.atom_entry)
    assert (got["title"], got["summary"], got["authors"], got["categories"]) == ("A & B", "s", ["X", "Y"], ["cs.DB"])


def test_thread(spark):
    html = '<a href="/ann/status/12">x</a><article><p>one</p></article><article></article><article>two &lt;3</article>'
    assert tuple(one(spark, html, P.thread)) == ("one\n\n---\n\ntwo <3", "ann", 2)


def test_byte_cut_never_halves_a_character(spark):
    for most in range(1, 14):
        text = "aé🙂bc日本"
        got = one(spark, text, lambda c, m=most: P.byte_cut(c, m))
        want = max((text[:k] for k in range(len(text) + 1) if len(text[:k].encode()) <= most), key=len)
        assert got == want


def test_ids_captions_versions(spark):
    assert [one(spark, s, lambda c: P.parsed_wire_id("itm", c)) for s in ("itm_7", "itm_07", "itm_-1", "cnv_7", "itm_9007199254740993")] == [7, None, None, None, None]
    assert one(spark, "prompt.v12.md", P.file_version) == 12
    assert one(spark, "x", lambda c: P.caption(F.lit(""), c)) == "x"
    assert one(spark, "x", lambda c: P.caption(F.lit("a"), c)) == "a: x"


def test_widths_and_models_are_guarded(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, None)], "chunk_id int, text string")
    out = X.embedded(chunks, X.HashEmbedder(8))
    X.one_model(out, "hash")
    with pytest.raises(ValueError):
        X.one_model(out, "other")

    class Wrong(X.HashEmbedder):
        def embed(self, texts):
            return [[0.0]] * len(texts)

    with pytest.raises(Exception, match="another width"):
        X.embedded(chunks, Wrong(8)).collect()


def test_stages_run_in_order(spark):
    add = lambda c: lambda df: df.withColumn("log", F.concat("log", F.lit(c)))
    out = X.staged(spark.createDataFrame([("",)], "log string"), {"embed": add("e"), "extract": add("x"), "resolve": add("r")})
    assert out.head()["log"] == "rxe"
