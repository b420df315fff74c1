"""Operators that compare rows: SimHash, suffixes, decontamination, WARC, chat windows, the pipeline."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from lexilake.llm import chat, decontaminate, simhash, suffixes, warc
from lexilake.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups_of(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_components_by_brute_force(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + k, 201 + k) for k in range(40)] + [(300, 300 + k) for k in range(50)]
    label = groups_of(400, edges)
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame([*edges, (None, 3), (7, None)], "a bigint, b bigint")).collect()}
    assert got == {n: label[n] for e in edges if e[0] != e[1] for n in e}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_links_join_all_words_within_the_radius(spark):
    rng = random.Random(2)
    words = [rng.getrandbits(64) for _ in range(60)]
    words += [w ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for w in words for _ in range(4)]
    words = sorted(set(words))
    near = [(i, j) for i in range(len(words)) for j in range(i) if (words[i] ^ words[j]).bit_count() <= 3]
    signed = np.array(words, np.uint64).view(np.int64).tolist()
    got = [(r["a"], r["b"]) for r in simhash.links_within(spark.createDataFrame([(w,) for w in signed], "fp bigint"), 3).collect()]
    at = {w: k for k, w in enumerate(signed)}
    assert all((words[at[a]] ^ words[at[b]]).bit_count() <= 3 for a, b in got)
    assert groups_of(len(words), [(at[a], at[b]) for a, b in got]) == groups_of(len(words), near)


def test_two_flips_inside_a_half_are_enough():
    pairs = set(simhash.pair_masks(64).tolist())
    rng = random.Random(3)
    for _ in range(2000):
        a, b, c = rng.sample(range(64), 3)
        assert any(1 << x | 1 << y in pairs for x, y in ((a, b), (a, c), (b, c)))


def test_simhash_by_brute_force(spark):
    rng = random.Random(4)
    base = [[rng.choice("alpha beta gamma delta Epsilon zeta eta theta iota".split()) + str(rng.randrange(9)) for _ in range(80)] for _ in range(8)]
    texts = [" ".join(w if rng.random() > 0.004 else "edit" for w in b) for b in base for _ in range(12)] + [None, "", " \n", "one", "ONE", "one two", "É é"]
    fps = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    ids = rng.sample(range(1000), len(texts))
    order = sorted(range(len(ids)), key=ids.__getitem__)
    label = groups_of(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[order[i]] ^ fps[order[j]]).bit_count() <= 3])
    want = {ids[k]: (f"{fps[k]:016x}", ids[order[label[i]]]) for i, k in enumerate(order)}
    rows = [(i, t, "c") for i, t in zip(ids, texts)]
    docs = spark.createDataFrame([*rows, rows[0], (None, texts[0], "c")], "doc_id bigint, text string, component_id string")
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(rows) + 2
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_near_duplicates_at_similarity(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(4000)]
    rows, want = [], {}
    for k in range(30):
        own = rng.choices(words, k=300)
        edited = list(own)
        edited[rng.randrange(300)] = "edit"
        other = own[:100] + rng.choices(words, k=200)
        for j, w in enumerate((own, own, edited, other)):
            rows.append((10 * k + j, " ".join(w)))
        want |= {10 * k: 10 * k, 10 * k + 1: 10 * k, 10 * k + 2: 10 * k, 10 * k + 3: 10 * k + 3}
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (5000, None), (5001, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == {**want, None: 0, 5000: 5000, 5001: 5000}
    kept = {r["doc_id"] for r in simhash.without_near_duplicates(docs).collect()}
    assert kept == {*want.values(), None, 5000}


def passages(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [suffixes.CHUNK, 500])
def test_suffixes_by_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rng = random.Random(6)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randrange(50, 300))) for _ in range(6)]
    make = lambda: rng.choice([None, "", "a" * rng.randrange(400), "ab" * rng.randrange(300), "".join(rng.choice(base)[rng.randrange(40) :] for _ in range(rng.randrange(6))), "abc" * 40 + "".join(rng.choice("xyz") for _ in range(200))])
    rows = [(3 * k, make()) for k in range(150)]
    docs = spark.createDataFrame([(*r, "c") for r in [*rows, rows[7]]], "doc_id bigint, text string, n_bytes string").repartition(3)
    got = suffixes.repeated_passages(docs, with_text=True).collect()
    assert len(got) == 151
    assert {r["doc_id"]: tuple(r)[1:5] for r in got} == passages(rows)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)
    assert suffixes.repeated_passages(docs.limit(0)).count() == 0


def test_index_family_keeps_few_levels():
    rng = random.Random(7)
    family = suffixes.IndexFamily()
    for _ in range(32):
        family.add([bytes(rng.randrange(256) for _ in range(300))])
    assert len(family.levels) <= 6
    text = bytes(rng.randrange(256) for _ in range(150))
    assert not family.add([text])[0].any() and family.add([text])[0].all()


def test_decontamination_by_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(40)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, some(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for k in range(30)]
    glue = lambda ws: "".join(rng.choice(["", ""]) + (w.upper() if rng.random() < 0.2 else w) + rng.choice([" ", ", ", "\n", " - "]) for w in ws)
    bench = [(k, glue(w)) for k, w in items] + [(30, None), (31, "!!")]
    texts = [glue(some(rng.randrange(30)) + (rng.choice(items)[1][: rng.choice([5, 10, 30])] if rng.random() < 0.7 else []) + some(rng.randrange(30))) for _ in range(80)] + [None, "", "É É", "w1"]
    own = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for k, t in bench:
        w = own(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(str(k))
    want = {}
    for d, t in enumerate(texts):
        w, hit, found = own(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    docs = spark.createDataFrame([(d, t, "c") for d, t in enumerate(texts)] + [(0, texts[0], "c"), (None, None, "c")], "doc_id bigint, text string, items string")
    marks = spark.createDataFrame([(k, t, "c") for k, t in bench], "item_id bigint, text string, key string")
    got = decontaminate.contamination(docs, marks).collect()
    assert len(got) == len(texts) + 2
    assert {r["doc_id"]: tuple(r)[1:] for r in got if r["doc_id"] is not None} == want
    clean = sorted((r["doc_id"] for r in decontaminate.clean_documents(docs, marks).collect()), key=str)
    again = [0] if not want[0][4] else []
    assert clean == sorted([*[d for d in want if not want[d][4]], *again, None], key=str)
    assert decontaminate.contamination(docs, marks.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), marks).count() == 0


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n"


def archive_rows(rng):
    junk = lambda: "".join(rng.choice(["x" * rng.randrange(3000), FAKE % (rng.randrange(99), rng.randrange(5000)), "é\r\n\r\n", "WARC/1.1\r\n", "\r\n\r\n" + FAKE % (5, 0)]) for _ in range(rng.randrange(20)))
    rows = [(k, rng.choice([None, "http://a/\r\nb", "http://x/é"]), junk()) for k in range(120)]
    return rows + [(1000 + k, None, rng.choice([None, "", "same"])) for k in range(20)]


@pytest.mark.parametrize("split", ["134217728", "30000"])
def test_archives_by_brute_force(spark, split):
    rows = archive_rows(random.Random(9))
    by = collections.defaultdict(list)
    for p, _, h in rows:
        by[(h or "").encode()].append(p)
    want = {}
    for p, _, h in rows:
        b = (h or "").encode()
        top = max(by[b])
        want[p] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if p == top else "revisit", None if p == top else top)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id bigint, url string, html string, file string").coalesce(2)
        assert {r["page_id"]: tuple(r)[1:] for r in warc.archived_pages(pages).collect()} == want
        path = warc.fresh_path(spark, "archive")
        warc.write_pages(pages, path)
        records = warc.verified_records(spark, path)
        held = {(r["file"], r["offset"]): bytes(r["payload"]) for r in warc.payloads(spark, path, records).collect()}
        text = {p: (h or "").encode() for p, _, h in rows}
        found = records.collect()
        assert len(found) == len(rows)
        assert all(held[r["file"], r["offset"]] == (text[r["page_id"]] if r["record_type"] == "response" else b"") for r in found)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_archives_of_others(spark, tmp_path):
    def record(k, version=b"1.1", extra=b"", body=b"hello"):
        return b"WARC/" + version + b"\r\nWARC-Type: response\r\n" + extra + b"WARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n" % (k, len(body)) + body + b"\r\n\r\n"

    whole = [record(1), record(2, extra=b"X_Custom: v\r\n"), record(3, b"1.0", b"X-Folded: a\r\n\tb\r\n"), record(4, extra=b"WARC-Target-URI: " + b"u" * 2_000_000 + b"\r\n"), record(5, body=record(9) + b"WARC/1.1\r\n" * 3000), record(6, body=b"")]
    for name, data in (("ok", whole), ("cut", [*whole[:5], whole[0][:-9]]), ("odd", [whole[0], b"what is this", whole[1]])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(b"".join(data))
    ids = lambda df: sorted(r["page_id"] for r in df.collect())
    assert ids(warc.verified_records(spark, str(tmp_path / "ok"))) == [1, 2, 3, 4, 5, 6]
    for name, left in (("cut", [1, 2, 3, 4, 5]), ("odd", [1])):
        with pytest.raises(warc.BrokenArchive, match="^1 files"):
            warc.verified_records(spark, str(tmp_path / name))
        assert ids(warc.verified_records(spark, str(tmp_path / name), strict=False)) == left
    pages = spark.createDataFrame([(1, None, "x"), (2, "u", "WARC/1.1\r\n")], "page_id bigint, url string, html string")
    warc.write_pages(pages, str(tmp_path / "zipped"), compression="gzip")
    assert ids(warc.verified_records(spark, str(tmp_path / "zipped"))) == [1, 2]


def turns_digest(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    out = {}
    for c, v in by.items():
        v.sort()
        said, learned = "".join(f"{r}\n{x}\n" for _, r, x in v), "".join(x for _, r, x in v if r == "assistant")
        out[c] = (len(v), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_chat_windows_by_brute_force(spark):
    rng = random.Random(10)
    bits = ["<|end|>", "<\\|end|>", "<|text|>", "<\\\\|start|>", "\\", "<", "|", "word ", "é", "🙂", "\n"]
    say = lambda: rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(60))) * rng.choice([1, 1, 4, 30])])
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<|x|>", None]), say()) for c, n in ((1, 400), (2, 300), (3, 1), (None, 30)) for t in range(n)]
    rows = [r if r[:2] != (2, 0) else (2, 0, "system", "be brief") for r in rows] + [(9, 0, "user", "x")] * 2
    turns = spark.createDataFrame([(*r, "c") for r in rows], "conv_id bigint, turn bigint, role string, text string, window string")
    windows = chat.chat_windows(turns, budget=300, history=60)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(windows).collect()}
    assert got == turns_digest(rows)
    made = windows.collect()
    alone = [r for r in made if r["n_tokens"] > 300]
    assert all(r["formatted"].count("<|start|>") - r["n_context"] == 1 for r in alone)
    assert max(r["n_context"] for r in made) > 1
    later = [r for r in made if r["conv_id"] == 2 and r["window"] > 0]
    assert later and all(r["formatted"].startswith("<|start|>system<|text|>be brief<|end|>") for r in later)
    assert chat.chat_windows(turns.limit(0)).count() == 0


def test_pipeline_stages(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "personal data", "token ids"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= before and (name != "personal data" or now == before)
        before = now
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == before


def test_crowded_variants_are_compared_whole(spark):
    # a template family: pairs at about 100 bits, twins of distant ids among them at about 70
    rng = np.random.default_rng(11)
    flip = lambda bits, share: bits ^ (rng.random(512) < share)
    centre = rng.random(512) < 0.5
    rows = [flip(centre, 0.09) for _ in range(300)]
    rows = np.array([rng.random(512) < 0.5, *rows, *(flip(x, 0.12) for x in rows)])
    fps = np.packbits(rows, axis=1).view(">i8").astype(np.int64)
    keys = rows[:, :510].reshape(-1, 17, 30)
    want = set()
    for j in range(len(rows)):
        meet = (keys[:j] != keys[j]).sum(axis=2) <= 2
        words = (np.arange(17) * 30 // 64 + 4) % 8
        check = np.bitwise_count((fps[:j, words] ^ fps[j, words]).astype(np.uint32)) <= simhash.loose_bits(0.8, 32)
        near = (rows[:j] != rows[j]).sum(axis=1) <= 81
        want |= {(int(i), j) for i in np.flatnonzero((meet & check).any(axis=1) & near)}
    nodes = spark.createDataFrame([(k, f, k) for k, f in enumerate(fps.tolist())], "node bigint, fp array<bigint>, label bigint")
    met = simhash.table_pairs(nodes)
    first = [tuple(r) for r in met.where("a is not null").select("a", "b").collect()]
    crowd = {r["node"] for r in simhash.crowded_nodes(met).collect()}
    alone = nodes.where(nodes.node.isin(sorted(crowd))).selectExpr("node", "fp", "node as label", "fp as long")
    second = {(r["a"], r["b"]) for r in simhash.table_pairs(alone, whole=True).collect()}
    assert len(want - set(first)) > 10  # the first round alone leaves some out
    assert want <= set(first) | second
    joined = alone.selectExpr("node", "fp", "node % 2 as label", "long")
    assert {(r["a"], r["b"]) for r in simhash.table_pairs(joined, whole=True).collect()} == {(a, b) for a, b in second if a % 2 != b % 2}
    assert simhash.table_pairs(alone.selectExpr("node", "fp", "0l as label", "long"), whole=True).count() == 0
    assert simhash.table_pairs(alone.selectExpr("node", "fp", "0l as label")).count() == 0


def test_near_duplicates_by_exact_jaccard(spark):
    # a refrain that fills half of unlike texts, and a large template family with twins inside
    rng = random.Random(12)
    fresh = lambda n: [f"u{rng.getrandbits(40)}" for _ in range(n)]
    refrain = fresh(20)
    texts = [" ".join(w for _ in range(20) for w in refrain + fresh(20)) for _ in range(6)]
    template = fresh(172)
    for _ in range(150):
        own = template + fresh(28)
        texts.append(" ".join(own))
    texts += [" ".join(t.split()[:-6] + fresh(6)) for t in texts[6:]]
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    jaccard = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    want = groups_of(len(texts), [(i, j) for j in range(len(texts)) for i in range(j) if jaccard(i, j) >= 0.8])
    assert want == [*range(156), *range(6, 156)]  # only twins are alike
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == dict(enumerate(want))


def _jaccard_groups(texts, size=5, least=0.8):
    sets = [set(zip(*(t.split()[k:] for k in range(size)))) if len(t.split()) > size else {tuple(t.split())} for t in texts]
    return lambda i, j: len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) >= least


def test_recall_of_planted_near_duplicates(spark):
    rng = random.Random(13)
    word = lambda: f"w{rng.getrandbits(30)}"
    texts = []
    for n in (90, 200, 500, 900):
        for _ in range(60):
            own = [word() for _ in range(n)]
            other = list(own)
            for k in rng.sample(range(n), max(1, round(n * rng.uniform(0.018, 0.0235)))):  # a changed word takes five shingles
                other[k] = word()
            texts += [" ".join(own), " ".join(other)]
    near = _jaccard_groups(texts)
    pairs = [k for k in range(0, len(texts), 2) if near(k, k + 1)]
    assert len(pairs) > 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for errors in (simhash.ERRORS, None):
        of = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(docs, errors=errors).collect()}
        assert sum(of[k] == of[k + 1] for k in pairs) >= 0.9 * len(pairs)
        assert not any(of[k] == of[k + 1] for k in range(0, len(texts), 2) if k not in pairs)


def test_recall_on_the_documents(spark, sf):
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().decode()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    near = _jaccard_groups([" ".join(t.encode().split() and [w.decode() for w in t.encode().split()]) for _, t in rows])
    links = [(i, j) for j in range(len(rows)) for i in range(j) if near(i, j)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    of = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(docs).collect()}
    found = sum(of[rows[i][0]] == of[rows[j][0]] for i, j in links)
    assert links and found >= 0.9 * len(links)


def test_ids_that_are_no_numbers_are_refused_by_name(spark):
    docs = spark.createDataFrame([("a", "u", "x", 1)], "doc_id string, url string, text string, n int")
    for call in (lambda: suffixes.repeated_passages(docs), lambda: warc.write_pages(docs, "nowhere", id_col="doc_id", payload_col="text"), lambda: chat.chat_windows(docs, "n", "doc_id", "url", "text")):
        with pytest.raises(ValueError, match="doc_id must be of an integral type"):
            call()
