"""Operators that look at one row at a time: BPE, PII, quality figures, statistics, URLs."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexilake.llm import bpe, pii, qda, quality, urls

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "Ünï 🙂 ǅ ½ \u2028x", "aaaa" * 5000, "x" * 3000 + " y" * 3000, "<|endoftext|> <|endoftext|>", "it's we'll  \t 12345 ٣٤ \u00a0\u3000.", "same", "same"]


def frame(spark, texts, extra="ids"):
    """Rows with null and repeated ids and a column whose name clashes with an output's."""
    rows = [(None if k == 1 else k - k % 2 if k > 9 else k, t, "x", "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, source string, {extra} string")


def test_bpe_is_the_library(spark):
    rng = random.Random(1)
    texts = [*ODD, *("".join(rng.choice("abcdeth ,.'19\n") for _ in range(80)) for _ in range(50)), *("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(40)) for _ in range(50))]
    known = Tokenizer.from_file(VOCABULARY)
    got = bpe.encode_documents(frame(spark, texts), VOCABULARY).collect()
    assert len(got) == len(texts)
    want = sorted(known.encode(t or "", add_special_tokens=False).ids for t in texts)
    assert sorted(r["ids"] for r in got) == want
    for r in got:
        assert r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(known.decode(r["ids"], skip_special_tokens=False).encode()).hexdigest()


def test_bpe_table_starts_anew(monkeypatch, tmp_path):
    monkeypatch.setattr(bpe, "CACHED_ENTRIES", 50)
    made, known, rng = bpe.Automaton(bpe.load_vocabulary(VOCABULARY)), Tokenizer.from_file(VOCABULARY), random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice("abcdefgh ionset\u00e9\U0001f642") for _ in range(30))
        assert made.encode(text) == known.encode(text, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        bpe.load_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_table_is_bounded_inside_a_word(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_ENTRIES", 500)
    made, known, rng = bpe.Automaton(bpe.load_vocabulary(VOCABULARY)), Tokenizer.from_file(VOCABULARY), random.Random(8)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    assert made.encode(word) == known.encode(word, add_special_tokens=False).ids
    assert sum(map(len, made.rows.values())) <= 500 and len(made.follows) <= 500
    made.release()
    assert len(made.rows) == 1 and not made.words and not made.follows


def test_bpe_round_trip(spark):
    docs = frame(spark, ODD).where("doc_id is not null")
    back = bpe.decode_documents(bpe.encode_documents(docs, VOCABULARY), VOCABULARY)
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] or "" for r in docs.collect())
    assert bpe.encode_documents(docs.limit(0), VOCABULARY).count() == 0


def test_quality_figures_by_brute_force():
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)

    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b ", "c", " ", "\n", "\t", "é", "#", "|", "\x1c", "\u00a0", "a b c\n"]) for _ in range(rng.randrange(60)))
        assert quality.text_figures(text) == brute(text)


@pytest.mark.parametrize("held", [quality.HELD_LINES, 0])
def test_quality_rules_remove_frequent_lines(spark, held, monkeypatch):
    monkeypatch.setattr(quality, "HELD_LINES", held)
    own = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(130)]
    shared = " ".join(f"s{i}" for i in range(200))
    rows = [(k, f"{shared}\n{own[k]}", "h") for k in range(120)] + [(k, own[k], "h") for k in range(120, 130)] + [(200, f"{shared}\n{own[0]}", "other"), (300, None, "h"), (None, own[1], None), (301, own[120], "h"), (301, own[120], "h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs).collect()}
    assert got[0] and not any(got[k] for k in range(1, 120))
    assert all(got[k] for k in range(120, 130)) and got[200] and not got[300] and got[None]
    kept = sorted((r["doc_id"] for r in quality.kept_documents(docs).collect()), key=str)
    assert kept == sorted([0, *range(120, 130), 200, None, 301, 301], key=str)
    assert quality.quality_rules(docs.limit(0)).count() == 0


@pytest.mark.parametrize("held", [quality.HELD_LINES, 0])
def test_kept_documents_lose_frequent_lines(spark, held, monkeypatch):
    monkeypatch.setattr(quality, "HELD_LINES", held)
    own = [[" ".join(f"w{k}x{i}é{j}" for i in range(30)) for j in range(2)] for k in range(120)]
    text = lambda k, said: f"{own[k][0]}\n\n{said}\n{own[k][1]}\n{said}"
    rows = [(k, text(k, "Subscribe  to\tOUR letter" if k % 2 else "subscribe to our letter "), "h", "c", 1) for k in range(120)]
    rows += [(500, text(0, "subscribe to our letter"), "other", "c", 1), (501, text(1, "Read more"), "h", None, 1), (None, text(2, "subscribe to our letter"), "h", "c", 1), (7, text(7, "subscribe to our letter"), "other", "c", 1)]
    docs = spark.createDataFrame([(*r[:4], len(r[1])) for r in rows], "doc_id bigint, text string, source string, lang string, n_chars bigint")
    want = []
    for d, t, host, lang, _ in rows:
        if host == "h" and d not in (None, 0, 501):
            t = f"{own[d][0]}\n\n{own[d][1]}"
        want.append((d, t, host, lang, len(t)))
    got = quality.kept_documents(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_copies_are_documents_towards_a_line(spark):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(10)) for i in range(10))
    docs = spark.createDataFrame([(k, text, "h") for k in range(150)] + [(k, text, "few") for k in range(900, 1000)] + [(999, text, "few")] * 9, "doc_id bigint, text string, source string")
    kept = [r[0] for r in quality.quality_rules(docs).where("kept").select("doc_id").collect()]
    assert sorted(kept) == sorted([0, *range(900, 1000), *[999] * 9])  # the first of 150; all of a host's 100


def luhn(s):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(s))) % 10 == 0


def iban(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def pseudonyms(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: r for r in pii.pseudonymised(docs, key).collect()}


def test_pseudonyms_keep_format_and_links(spark):
    texts = ["card 4041894974608795.", "again 4041-8949-7460-8795 ok", "bad 4041894974608796", "ip 53.121.55.90, 300.1.1.1", "born 1984-03-09 or 31.12.1999 not 2024-02-30", "iban DE89370400440532013000 GB82 WEST 1234 5698 7654 32", 'a@b.org A@B.org token = "24be64439e3e49cf46b2d7c9"', "+1 (988) 555-2485", None, "", "nothing 12 34"]
    got = pseudonyms(spark, texts)
    one, two = re.search(r"\d{16}", got[0]["text"])[0], re.search(r"[\d-]{19}", got[1]["text"])[0]
    assert luhn(one) and one != "4041894974608795" and two.replace("-", "") == one
    assert got[2]["text"] == texts[2] and got[2]["pii"] == []
    assert re.fullmatch(r"ip \d+\.\d+\.\d+\.\d+, 300\.1\.1\.1", got[3]["text"]) and "53.121.55.90" not in got[3]["text"]
    assert re.fullmatch(r"born \d{4}-\d\d-\d\d or \d\d\.\d\d\.\d{4} not 2024-02-30", got[4]["text"]) and got[4]["pii"] == ["date", "date"]
    de, gb = re.search(r"DE\w{20}", got[5]["text"])[0], re.search(r"GB.*$", got[5]["text"])[0]
    assert iban(de) and iban(gb) and de != "DE89370400440532013000"
    a, b = re.findall(r"u\w+@mail\.invalid", got[6]["text"])
    assert a == b and "24be64439e3e49cf46b2d7c9" not in got[6]["text"]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[7]["text"])
    assert got[8]["text"] is None and got[9]["text"] == "" and got[10]["text"] == texts[10]
    assert pseudonyms(spark, texts, "other")[0]["text"] != got[0]["text"]


def test_feistel_is_a_permutation(spark):
    ids = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    moved = ids.select("s", pii.permuted_digits("k", "card", F.col("s")).alias("m"))
    assert moved.select("m").distinct().count() == 1000
    assert moved.where(pii.permuted_digits("k", "card", F.col("m"), back=True) != F.col("s")).count() == 0


def test_dates_are_permuted_within_the_calendar(spark):
    days = spark.sql("select cast(d as string) as d from (select explode(sequence(date'2000-01-01', date'2002-12-31')) as d)").select("d", pii._date("k", F.col("d")).alias("m"))
    assert days.select("m").distinct().count() == days.count() == 1096
    assert days.where(F.try_to_date("m", "yyyy-MM-dd").isNull()).count() == 0


def test_trees_by_brute_force(spark):
    """The same trees from plain Python over the collected features."""
    rng = random.Random(9)
    rows = [(f"http://{'-'.join(rng.choices(['a', 'bb', 'c9'], k=rng.randrange(1, 5)))}.x/{'y/' * rng.randrange(4)}", rng.randrange(2)) for _ in range(60)]
    labelled = spark.createDataFrame(sorted(set(rows)), "url string, label int")
    model = urls.train(labelled, trees=3)
    feats = [r.asDict() for r in urls.with_features(labelled, model.suffixes).collect()]
    value = lambda tree, r: tree if isinstance(tree, float) else value(tree[2] if r[f"f_{tree[0]}"] <= tree[1] else tree[3], r)

    def grow(rows, depth):
        g, h = sum(r["g"] for r in rows), sum(r["h"] for r in rows)
        best = None
        for f in urls.FEATURES:
            for at in sorted({r[f"f_{f}"] for r in rows})[:-1]:
                left = [r for r in rows if r[f"f_{f}"] <= at]
                gl, hl = sum(r["g"] for r in left), sum(r["h"] for r in left)
                gain = round(gl**2 / (hl + urls.LAMBDA) + (g - gl) ** 2 / (h - hl + urls.LAMBDA) - g**2 / (h + urls.LAMBDA), 9)
                if gain > 1e-6 and (best is None or gain > best[0]):
                    best = gain, f, at
        if best is None or not depth:
            return urls.RATE * g / (h + urls.LAMBDA)
        _, f, at = best
        return f, at, grow([r for r in rows if r[f"f_{f}"] <= at], depth - 1), grow([r for r in rows if r[f"f_{f}"] > at], depth - 1)

    for k, tree in enumerate(model.trees):
        for r in feats:
            p = 1 / (1 + math.exp(-model.prior - sum(value(t, r) for t in model.trees[:k])))
            r["g"], r["h"] = r["label"] - p, p * (1 - p)
        want = grow(feats, urls.DEPTH)
        assert all(abs(value(want, r) - value(tree, r)) < 1e-6 for r in feats)


def test_discriminant_by_brute_force(spark):
    """Scores from numpy's covariances over the collected statistics."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["a", "bb", "CC", "d4", "e.", "#"], [1, 2, 3, 1, 2, 4 * (k % 2)], k=rng.randrange(1, 60))) for k in range(80)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["score"] for r in qda.quality_scores(docs, labels, train=F.col("doc_id") < 60).collect()}
    x = np.array([qda.statistics(t) for t in texts])
    of = [x[k:60:2] for k in (0, 1)]
    covs = [np.cov(v.T, bias=True) for v in of]
    pooled = sum(c * len(v) for c, v in zip(covs, of)) / 60
    logs = []
    for v, c in zip(of, covs):
        s = qda.SHRINK[0] * c + qda.SHRINK[1] * pooled + qda.SHRINK[2] * np.diag(np.diag(c)) + qda.RIDGE * np.eye(len(c))
        d = x - v.mean(axis=0)
        logs.append(math.log((len(v) + 1) / 62) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (d @ np.linalg.inv(s) * d).sum(axis=1))
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))
    assert max(abs(got[k] - want[k]) for k in range(80)) < 1e-6
    assert qda.quality_scores(docs.limit(0), labels, train=F.lit(True)).count() == 0


def test_classifier_tells_prose_from_junk(spark):
    rng = random.Random(3)
    words = ["river", "stone", "walks", "under", "the", "old", "bridge", "where", "people", "wait", "quietly", "and", "talk"]
    good = [". ".join(" ".join(rng.choices(words, k=rng.randrange(5, 12))).capitalize() for _ in range(12)) for _ in range(60)]
    junk = [" ".join(rng.choice(words) + rng.choice(["$$$", "###", "|||"]) for _ in range(80)) for _ in range(60)]
    texts = [x for pair in zip(good, junk) for x in pair]
    docs = spark.createDataFrame([(k, t, "q", 0) for k, t in enumerate(texts)] + [(999, None, "q", 0), (None, "", "q", 0)], "doc_id bigint, text string, source string, score int")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(120)] + [(5, None), (6, 1), (6, 1)], "doc_id bigint, quality int")
    got = qda.quality_scores(docs, labels, train=F.col("doc_id") % 3 != 1).collect()
    assert len(got) == 122 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 120 and r["doc_id"] % 3 == 1]
    assert sum(r["predicted"] == 1 - r["doc_id"] % 2 for r in held) / len(held) > 0.95
    none = qda.quality_scores(docs, labels.limit(0), train=F.lit(True)).collect()
    assert {round(r["score"], 9) for r in none} == {0.5}


def test_url_rules_by_brute_force(spark):
    rules = dict(urls.RULES)

    def brute(url):
        m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[2]), m[3]) if m else ("", "")
        fits = [r for r in rules if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
        best = max(fits, key=len, default=None)
        return host, path, best, rules.get(best)

    said = [None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "http://example.net/de/", "http://b.example.net/en", "http://xnet/", "http://x.net", "http://x.net?/", "http://example.com/de/", "http://badexample.com/de/", "http://q.org/fr/1", "ftp://q.org/fr", "http://É.net/", "a://b://c.net/", "http://e.net/" + "a" * 50_000]
    model = urls.train(urls.default_labelled(spark), trees=2)
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(said)] + [(3, said[3], "x"), (None, None, "x")], "page_id bigint, url string, host string")
    got = urls.filter_urls(pages, model).collect()
    assert len(got) == len(said) + 2
    for r in got:
        if r["page_id"] is not None:
            host, path, rule, verdict = brute(said[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert r["verdict"] == (verdict or ("block" if r["probability"] > 0.5 else "allow"))


def test_url_trees_learn(spark):
    model = urls.train(urls.default_labelled(spark))
    pages = spark.createDataFrame([(1, "https://free-casino-bonus.example.com/en/1"), (2, "https://council.example.com/en/1")], "page_id bigint, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.filter_urls(pages, model).collect()} == {1: "block", 2: "allow"}
    # held out by name: a third of the names trains nothing
    known = urls.default_labelled(spark).withColumn("apart", F.crc32(F.regexp_extract("url", r"([a-z0-9-]+)\.example", 1).cast("binary")) % 3 == 1)
    model = urls.train(known.where("not apart"))
    judged = urls.filter_urls(known.where("apart").withColumn("page_id", F.col("label")), model, rules=()).collect()
    assert len(judged) > 60 and sum((r["verdict"] == "block") == (r["page_id"] == 1) for r in judged) / len(judged) >= 0.85
    assert urls.train(urls.default_labelled(spark).limit(0)).trees == ()


@pytest.mark.parametrize("name", ["op1_chat_windows", "op5_pii_pseudonyms", "op9_url_filter", "op10_decontamination"])
def test_native_operators_run_no_python(spark, sf, name):
    from lexilake.llm import registry

    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pseudonyms_of_awkward_texts(spark):
    long = ["a@" + "b." * 20_000 + "1", "a@" + "b." * 20_000 + "org", "+" + "1" * 1_000_000, "x" * 1_000_000 + " a@b.org", "9.9.9." * 200_000, "token" * 200_000, "AB12 " * 100_000, "4-" * 300_000]
    got = pseudonyms(spark, long)
    assert all(got[k]["text"] == long[k] for k in (0, 2)) and got[3]["text"].startswith("x" * 1_000_000 + " u")
    docs = spark.createDataFrame([(None, "a@b.org", "f", "n"), (None, "a@b.org", "f", "n"), (1, None, None, None)], "doc_id bigint, text string, found_pii string, new_pii string")
    made = pii.pseudonymised(docs, "k")
    assert made.columns == [*docs.columns, "pii"] and made.where("found_pii = 'f' and new_pii = 'n' and pii = array('email')").select("text").distinct().count() == 1
    assert pii.pseudonymised(docs.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymised(docs, "")


def test_pseudonyms_by_brute_force(spark):
    """Every planted value is found whatever stands around it, and nothing else is touched."""
    rng = random.Random(4)
    values = {
        "email": ["a.b+c@mail.example.org", "x@y.co"], "iban": ["BE68 5390 0754 7034", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "NO93 8601 1117 947"],
        "card": ["4041894974608795", "4041-8949-7460-8795"], "ip": ["53.121.55.90"], "date": ["1984-03-09", "31.12.1999"], "ssn": ["123-45-6789"], "phone": ["+1 (988) 555-2485", "212-555-0100", "212 555 0100"],
        "secret": ["AKIA" + "Z9" * 8, "ghp_" + "aB3" * 12, "password is tr0ub4dor3", "token = 24be64439e3e"],
    }
    plain = ["BE68 5390 0754 7035", "EUR", "password is incorrect", "4041894974608796", "300.1.1.1", "2024-02-30", "000-12-3456", "order 12", "2125550100", "DE8937040044053201300"]
    texts, want = [], []
    for _ in range(120):
        chosen = [rng.choice([(k, rng.choice(v)) for k, v in values.items()] + [(None, p) for p in plain]) for _ in range(6)]
        texts.append(" EUR; ".join(v for _, v in chosen) + " EUR")
        want.append(chosen)
    got = pseudonyms(spark, texts)
    seen = {}
    for k, chosen in enumerate(want):
        assert got[k]["pii"] == [kind for kind, _ in chosen if kind]
        parts = got[k]["text"].removesuffix(" EUR").split(" EUR; ")
        for (kind, value), part in zip(chosen, parts, strict=True):
            assert (part == value) == (kind is None)
            assert seen.setdefault((kind, value), part) == part
            if kind in ("iban", "card", "ip", "date", "ssn", "phone"):
                shape = lambda s: re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s))
                assert kind == "ip" or shape(part) == shape(value)
                assert kind != "iban" or (iban(part) and part[:2] == value[:2])
                assert kind != "card" or luhn(re.sub(r"\D", "", part))
    assert len(set(seen.values())) == len(seen)  # different values stay different


def test_helper_columns_do_not_clash(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([("b", text, "h", 1, "x", "y", "z", "k", "s")], "doc_id string, text string, source string, n_chars bigint, lost_id string, is_depleted string, lost_lines string, key string, rejected_id string")
    assert [tuple(r) for r in quality.kept_documents(docs).collect()] == [tuple(docs.first())]
    assert quality.quality_rules(docs).first()["kept"]
    bench = spark.createDataFrame([("i", "another thing"), (None, None)], "item_id string, text string")
    from lexilake.llm import decontaminate, simhash

    odd = docs.withColumnsRenamed({"lost_id": "text_key", "is_depleted": "n_hit", "lost_lines": "gone_id", "rejected_id": "items"})
    assert [tuple(r) for r in decontaminate.clean_documents(odd, bench).collect()] == [tuple(odd.first())]
    assert decontaminate.clean_documents(odd.limit(0), bench).count() == 0
    both = odd.unionByName(odd.withColumn("doc_id", F.lit("a")))
    assert [r["doc_id"] for r in simhash.without_near_duplicates(both).collect()] == ["a"]
    assert simhash.without_near_duplicates(both.limit(0)).columns == odd.columns
