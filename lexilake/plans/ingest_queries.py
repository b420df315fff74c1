"""Registered queries over URLs, pages, chunks and chat exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.functions import text as T
from lexilake.functions import urls as U
from lexilake.operators import ingest as G
from lexilake.operators import library as L
from lexilake.sources import tables as D
from lexilake.sources.tables import with_views

#: URLs of hosts that the test pages lack; the oracle has the same.
EXTRA = (
    "https://github.com/o/r.git", "https://gist.github.com/a/b", "https://youtu.be/abc123?si=zz", "https://m.youtube.com/watch?v=q1&ref=x", "https://vimeo.com/12", "https://x.com/a/status/1",
    "https://twitter.com/a/status/2?s=20", "https://www.reddit.com/r/x/", "https://arxiv.org/abs/2401.01234v2", "https://ex.org/a/paper.pdf", "https://open.spotify.com/e/1", "https://ex.org/a.b/sound.mp3",
    "https://www.tiktok.com/@a", "http://example.com:80/", "https://example.com/?b=2&a=1&utm_source=q", "https://EXAMPLE.com:8443/Path//?gclid=1", "not a url", "ftp://example.com/x",
)


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.raw(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    return own.unionByName(spark.createDataFrame([(-1 - k, u) for k, u in enumerate(EXTRA)], "id bigint, url string"))


def url_canonical_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("id", U.canonical(F.col("url"), "capture").alias("canonical"))


def url_canonical_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("id", U.canonical(F.col("url"), "resolve").alias("canonical"))


def url_canonical_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("id", U.canonical(F.col("url"), "import").alias("canonical"))


def url_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _urls(spark, sf_dir).select("id", U.url_hash(U.canonical(F.concat(U.scheme_of(F.col("url")), F.lit("://"), U.host_of(F.col("url")), F.lit("/"), (F.col("id") % 3).cast("string")), "import")).alias("url_hash"))
    return G.first_seen(own, order="id").select("id", "url_hash", "duplicates")


def url_kind_by_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("id", *[U.kind(F.col("url"), p).alias(p) for p in ("capture", "resolve", "import")])


def url_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return _urls(spark, sf_dir).select("id", U.github_repo(u).alias("repo"), U.video_id(u).alias("video"), U.arxiv_id(u).alias("paper"), U.path_extension(U.path_of(u)).alias("extension"))


def fallback_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.raw(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 > 0, F.col("url")).otherwise(F.concat("url", F.lit("/a%20b+c%C3%A9//?q=/x#/y"))).alias("url"))
    return own.select("page_id", U.fallback_title(F.col("url")).alias("title"))


def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.raw(spark, sf_dir, "pages").select("page_id", G.title(F.col("html")).alias("title"), G.meta(F.col("html"), "og:description").alias("description"))


def extraction_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.extracted(D.raw(spark, sf_dir, "pages"), least=LADDER)
    return out.select("page_id", "tier", F.length("text").cast("bigint").alias("chars"))


def page_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.raw(spark, sf_dir, "pages").select("page_id", G.readable(F.col("html")).alias("text"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a link in them, as the tables have none."""
    said = D.chat_messages(spark, sf_dir).select("conv_id", "turn", F.col("text").alias("said"))
    pages = D.raw(spark, sf_dir, "pages").select("page_id", "url")
    many = pages.select((F.max("page_id") + 1).alias("many"))  # one row
    met = said.crossJoin(F.broadcast(many)).join(pages, (F.col("conv_id") * 3 + F.col("turn")) % F.col("many") == F.col("page_id"))
    return met.select("conv_id", "turn", "said", "url", F.concat("said", F.lit(" (see "), "url", F.lit("). or www.example.org/a!")).alias("text"))


def url_extract_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _messages(spark, sf_dir).select((F.col("conv_id") * 100 + F.col("turn")).alias("message"), F.posexplode(U.urls_in(F.col("text"))).alias("pos", "url"))
    own = found.select((F.col("message") * 10 + F.col("pos")).alias("pos"), "url", U.url_hash(U.canonical(F.col("url"), "import")).alias("url_hash"))
    return G.first_seen(own).select("pos", "url", "url_hash", "duplicates")


def share_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _messages(spark, sf_dir).withColumn("k", (F.col("conv_id") + F.col("turn")) % 3)
    field = F.when(F.col("k") == 0, F.col("url")).when(F.col("k") == 1, "").otherwise(F.concat(F.lit("look: "), "url", F.lit(" !")))
    text = F.when(F.col("k") == 1, F.concat("said", F.lit(" "), "url", F.lit(").  more"))).otherwise(F.col("said"))
    url, note = U.shared(field, text)
    return own.select("conv_id", "turn", url.alias("url"), note.alias("note"))


def capture_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.raw(spark, sf_dir, "pages").select("page_id", "url")
    items = own.where("page_id % 2 = 0").select(U.url_hash(U.canonical(F.col("url"), "capture")).alias("url_hash"), F.col("page_id").alias("item_id"), F.when(F.col("page_id") % 4 == 0, "full").otherwise("partial").alias("extraction_tier")).groupBy("url_hash").agg(F.min("item_id").alias("item_id"), F.min_by("extraction_tier", "item_id").alias("extraction_tier"))
    links = own.select("url", (F.col("page_id") % 3 == 0).alias("has_hint"), "page_id")
    return G.captured(links, items).groupBy("decision").agg(F.count("*").alias("n"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chunked(D.items(spark, sf_dir))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.items(spark, sf_dir).select("item_id", T.estimated_tokens(F.col("content")).cast("bigint").alias("tokens"))


def truncate_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.items(spark, sf_dir).select("item_id", F.sha2(T.head_and_tail(F.col("content"), 300), 256).alias("cut"))


def content_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.items(spark, sf_dir).select("item_id", F.sha2(T.capped(F.col("content"), 5000), 256).alias("capped"))


def slugs_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.items(spark, sf_dir).select("item_id", T.slug(F.col("title"), "topic").alias("slug"))
    return own.select("item_id", "slug", T.slug_label(F.col("slug")).alias("label"), T.slug_colour(F.col("slug")).alias("colour"))


def stream_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = D.chat_messages(spark, sf_dir).select("conv_id", "turn", "text", T.stream_pieces(F.col("text")).alias("p"))
    return own.select("conv_id", "turn", F.size("p").cast("bigint").alias("pieces"), (F.array_join("p", "") == F.col("text")).alias("lossless"))


def chat_export_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as chat exports and parsed again, with continuation lines and bad headers."""
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 86400 + F.col("turn") * 60), "dd/MM/yyyy, HH:mm")
    line = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("45/45/2024, 10:00 - x: "), F.col("text"))).otherwise(F.concat(stamp, F.lit(" - "), "role", F.lit(": "), "text"))
    files = D.chat_messages(spark, sf_dir).groupBy(F.col("conv_id").cast("string").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    messages, _ = G.chat_parsed(G.chat_lines(files))
    return messages.groupBy("file").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"), F.min("ms").alias("first_ms"))


def import_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.zero_filled(L.counts_by(_urls(spark, sf_dir).select(U.kind(F.col("url"), "import").alias("kind")), "kind"), D.KINDS).select("value", "n")


#: Characters of a text that is taken for the whole article.
LADDER = 2000
QUERIES = {f.__name__: f for f in (url_canonical_capture, url_canonical_resolve, url_canonical_import, url_hash_dedupe, url_kind_by_profile, url_ids, fallback_titles, page_meta, extraction_ladder, page_main_text, url_extract_dedupe, share_payload, capture_decision, chunk_documents, token_estimate, truncate_head_tail, content_cap, slugs_and_labels, stream_pieces, chat_export_messages, import_kind_counts)}

_U = "u AS (SELECT page_id AS id, url FROM pages UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - k}, '{u}')" for k, u in enumerate(EXTRA)) + ") t(id, url))"
_SHAPE = r"^\s*(https?)://([^/?#:\s]+)(?::(\d+))?([^?#\s]*)(?:\?([^#\s]*))?(?:#\S*)?\s*$"
_X = f"""{_U},
x AS (SELECT id, url, regexp_matches(url, '{_SHAPE}', 'i') AS ok, lower(regexp_extract(url, '{_SHAPE}', 1, 'i')) AS scheme, lower(regexp_extract(url, '{_SHAPE}', 2, 'i')) AS host, regexp_extract(url, '{_SHAPE}', 3, 'i') AS port0,
  CASE WHEN regexp_extract(url, '{_SHAPE}', 4, 'i') = '' THEN '/' ELSE regexp_extract(url, '{_SHAPE}', 4, 'i') END AS path, list_filter(string_split(regexp_extract(url, '{_SHAPE}', 5, 'i'), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_')) AS ps0 FROM u),
y AS (SELECT *, CASE WHEN port0 = '' OR (scheme = 'http' AND port0 = '80') OR (scheme = 'https' AND port0 = '443') THEN '' ELSE ':' || port0 END AS port,
  list_transform(ps0, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END) AS ps FROM x)"""


def _drop(form: str) -> str:
    return f"list_filter(ps, lambda p: NOT list_contains({list(U.DROPPED[form])}, lower(split_part(p, '=', 1))))"


def _q(params: str) -> str:
    return f"CASE WHEN len({params}) > 0 THEN '?' || array_to_string({params}, '&') ELSE '' END"


_RES = f"""{_X}, z AS (SELECT *, {_drop("resolve")} AS kp, regexp_replace(host, '^www\\.', '') AS bare FROM y),
r AS (SELECT *, CASE bare WHEN 'm.youtube.com' THEN 'youtube.com' WHEN 'twitter.com' THEN 'x.com' ELSE bare END AS al, regexp_extract(path, '^/+([^/]+)/+([^/]+)', 2) AS repo FROM z),
res AS (SELECT id, url, ok, host AS host0, path AS path0, CASE WHEN NOT ok THEN trim(url) WHEN bare = 'youtu.be' THEN 'https://youtube.com/watch?v=' || regexp_extract(path, '^/+([^/]+)', 1) || array_to_string(list_transform(list_filter(kp, lambda p: split_part(p, '=', 1) <> 'v'), lambda p: '&' || p), '')
  WHEN al = 'github.com' AND repo <> '' THEN 'https://github.com/' || regexp_extract(path, '^/+([^/]+)/+([^/]+)', 1) || '/' || regexp_replace(repo, '\\.git$', '') ELSE scheme || '://' || al || regexp_replace(path, '/$', '') || {_q("kp")} END AS canonical FROM r)"""
_IMP = f"CASE WHEN NOT ok THEN lower(trim(url)) WHEN path <> '/' AND ends_with(whole, '/') THEN left(whole, length(whole) - 1) ELSE whole END"
_I = with_views("items", sql="")
_MSG = "m AS (SELECT conv_id, turn, text AS said, url FROM conversations JOIN pages ON (conv_id * 3 + turn) % (SELECT max(page_id) + 1 FROM pages) = page_id)"
_on = lambda h, names: "(" + " OR ".join(f"{h} = '{n}' OR ends_with({h}, '.{n}')" for n in names) + ")"
_SOCIAL = [f"{w}{h}" for h in ("instagram.com", "x.com", "twitter.com", "threads.net", "tiktok.com", "reddit.com") for w in ("", "www.")]
_IMPORT_KIND = f"CASE WHEN NOT ok THEN 'other' WHEN {_on('host', ('github.com',))} THEN 'github' WHEN {_on('host', ('youtube.com', 'youtu.be', 'vimeo.com', 'tiktok.com'))} THEN 'video' WHEN {_on('host', ('twitter.com', 'x.com', 'instagram.com', 'threads.net', 'facebook.com', 'linkedin.com', 'reddit.com'))} THEN 'social' WHEN {_on('host', ('arxiv.org',))} OR ends_with(lower(path), '.pdf') THEN 'pdf' ELSE 'article' END"
_TRIM = "regexp_replace({0}, '^[\\s]+|[\\s]+$', '', 'g')"
_DEC = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&#39;', ''''), '&amp;', '&')"

#: The pages of the table have their text in one article, with advertisements and scripts between.
_BARE = "regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '(?s)<!--.*?-->|<script.*?</script>|<div class=\"ad\">.*?</div>|<[^<>]*>', ' ', 'g')"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("#x27", "''"), ("amp", "&")):
    _BARE = f"replace({_BARE}, '&{_name};', '{_char}')"
_ARTICLE = f"CASE WHEN html IS NOT NULL THEN trim(regexp_replace({_BARE}, '\\s+', ' ', 'g')) END"

ORACLE = {
    "url_canonical_capture": f"WITH {_X}, k AS (SELECT *, {_drop('capture')} AS kp, CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END AS cut FROM y), s AS (SELECT *, list_transform(list_sort(list_transform(kp, lambda p, i: {{'n': split_part(p, '=', 1), 'i': i, 'p': p}})), lambda s: s.p) AS sp FROM k) SELECT id, CASE WHEN ok THEN scheme || '://' || host || port || CASE WHEN cut = '' THEN '/' ELSE cut END || {_q('sp')} END AS canonical FROM s",
    "url_canonical_resolve": f"WITH {_RES} SELECT id, canonical FROM res",
    "url_canonical_import": f"WITH {_X}, k AS (SELECT *, {_drop('import')} AS kp FROM y), w AS (SELECT *, scheme || '://' || host || port || path || {_q('kp')} AS whole FROM k) SELECT id, {_IMP} AS canonical FROM w",
    "url_hash_dedupe": f"WITH {_X}, h AS (SELECT id, sha256(CASE WHEN ok THEN scheme || '://' || host || '/' || id % 3 ELSE '://' || '/' || id % 3 END) AS url_hash FROM y) SELECT id, url_hash, count(*) OVER (PARTITION BY url_hash) - 1 AS duplicates FROM h QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY id) = 1",
    "url_kind_by_profile": f"""WITH {_RES}, c AS (SELECT id, canonical, regexp_matches(canonical, '{_SHAPE}', 'i') AS rok, lower(regexp_extract(canonical, '{_SHAPE}', 2, 'i')) AS rh, lower(regexp_extract(canonical, '{_SHAPE}', 4, 'i')) AS rp FROM res)
SELECT id, CASE WHEN {_on("host", ("github.com",))} THEN 'github' WHEN host IN ('youtube.com', 'www.youtube.com', 'youtu.be', 'm.youtube.com', 'vimeo.com', 'www.vimeo.com') THEN 'video' WHEN list_contains({_SOCIAL}, host) THEN 'social' WHEN host IN ('open.spotify.com', 'soundcloud.com', 'www.soundcloud.com', 'podcasts.apple.com') THEN 'audio' WHEN ends_with(lower(path), '.pdf') THEN 'pdf' ELSE 'article' END AS capture,
  CASE WHEN NOT rok THEN 'other' WHEN rh = 'github.com' THEN 'github' WHEN rh = 'youtube.com' THEN 'video' WHEN rh IN ('x.com', 'instagram.com', 'threads.net', 'threads.com') THEN 'social' WHEN rh = 'arxiv.org' OR ends_with(rp, '.pdf') THEN 'pdf' WHEN rh IN ('soundcloud.com', 'open.spotify.com', 'anchor.fm') OR regexp_extract(rp, '\\.[^./]*$') IN ('.mp3', '.wav', '.m4a', '.ogg', '.flac') THEN 'audio' ELSE 'article' END AS resolve,
  {_IMPORT_KIND} AS import FROM y JOIN c USING (id)""",
    "url_ids": f"WITH {_RES} SELECT id, nullif(regexp_extract(canonical, '^https://github\\.com/([^/]+/[^/?#]+)$', 1), '') AS repo, nullif(regexp_extract(canonical, '^https?://youtube\\.com/watch\\?(?:.*&)?v=([^&]+)', 1), '') AS video, nullif(regexp_extract(canonical, '^https?://arxiv\\.org/(?:abs|pdf)/(\\d{{4}}\\.\\d{{4,5}})(?:v\\d+)?(?:\\.pdf)?$', 1), '') AS paper, regexp_extract(path0, '\\.[^./]*$') AS extension FROM res",
    "page_meta": f"SELECT page_id, nullif(trim({_DEC.format(chr(114) + 'egexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1)')}), '') AS title, CAST(NULL AS VARCHAR) AS description FROM pages",
    "fallback_titles": """WITH u AS (SELECT page_id, CASE WHEN page_id % 3 > 0 THEN url ELSE url || '/a%20b+c%C3%A9//?q=/x#/y' END AS url FROM pages),
s AS (SELECT *, list_filter(string_split(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+|[?#].*$', '', 'g'), '/'), lambda x: x <> '') AS parts, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AS ok FROM u)
SELECT page_id, CASE WHEN ok AND len(parts) > 0 THEN url_decode(replace(parts[-1], '+', '%2B')) ELSE url END AS title FROM s""",
    "page_main_text": f"SELECT page_id, {_ARTICLE} AS text FROM pages",
    "extraction_ladder": f"WITH a AS (SELECT page_id, {_ARTICLE} AS text FROM pages) SELECT page_id, CASE WHEN length(text) >= {LADDER} THEN 'full' ELSE 'metadata_only' END AS tier, CASE WHEN length(text) >= {LADDER} THEN CASE WHEN length(text) <= {T.CONTENT_CAP} THEN length(text) ELSE {T.CONTENT_CAP} + length(chr(10) || chr(10) || '[truncated — original was ' || length(text) || ' characters]') END END AS chars FROM a",
    "url_extract_dedupe": f"""WITH {_MSG}, e AS (SELECT (conv_id * 100 + turn) * 10 AS pos, url FROM m UNION ALL SELECT (conv_id * 100 + turn) * 10 + 1, 'https://www.example.org/a' FROM m),
u AS (SELECT pos AS id, url FROM e), {_X.split("," + chr(10), 1)[1]}, k AS (SELECT *, {_drop("import")} AS kp FROM y), w AS (SELECT *, scheme || '://' || host || port || path || {_q("kp")} AS whole FROM k),
h AS (SELECT id AS pos, url, sha256({_IMP}) AS url_hash FROM w) SELECT pos, url, url_hash, count(*) OVER (PARTITION BY url_hash) - 1 AS duplicates FROM h QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY pos) = 1""",
    "share_payload": f"WITH {_MSG}, s AS (SELECT *, (conv_id + turn) % 3 AS k FROM m) SELECT conv_id, turn, url, nullif(CASE WHEN k = 0 THEN trim(said) WHEN k = 1 THEN trim(regexp_replace(said || '  more', '\\s+', ' ', 'g')) ELSE 'look: !' || CASE WHEN trim(said) = '' THEN '' ELSE chr(10) || chr(10) || trim(said) END END, '') AS note FROM s",
    "token_estimate": f"{_I} SELECT item_id, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM items",
    "truncate_head_tail": f"{_I} SELECT item_id, sha256(CASE WHEN length(content) <= 1200 THEN content ELSE left(content, {int((1200 - len(T.MARKER)) * 0.7)}) || '{T.MARKER}' || right(content, {1200 - len(T.MARKER) - int((1200 - len(T.MARKER)) * 0.7)}) END) AS cut FROM items",
    "content_cap": f"{_I}, t AS (SELECT item_id, {_TRIM.format('content')} AS own FROM items) SELECT item_id, sha256(CASE WHEN length(own) <= 5000 THEN own ELSE left(own, 5000) || chr(10) || chr(10) || '[truncated — original was ' || length(own) || ' characters]' END) AS capped FROM t",
    "slugs_and_labels": f"""{_I}, s AS (SELECT item_id, coalesce(nullif(regexp_replace(regexp_replace(lower({_TRIM.format('title')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'topic') AS slug FROM items),
h AS (SELECT *, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(slug, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda acc, x: ((acc * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM s)
SELECT item_id, slug, array_to_string(list_transform(list_filter(string_split(slug, '-'), lambda w: w <> ''), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS label, ({list(T.PALETTE)})[abs(h) % 6 + 1] AS colour FROM h""",
    "capture_decision": f"""WITH u AS (SELECT page_id AS id, url FROM pages), {_X.split("," + chr(10), 1)[1]}, k AS (SELECT *, {_drop("capture")} AS kp, CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END AS cut FROM y),
s AS (SELECT id, scheme || '://' || host || port || CASE WHEN cut = '' THEN '/' ELSE cut END || coalesce((SELECT '?' || string_agg(p, '&' ORDER BY split_part(p, '=', 1)) FROM (SELECT unnest(kp) AS p)), '') AS c FROM k),
it AS (SELECT c, min(id) AS item_id FROM s WHERE id % 2 = 0 GROUP BY c)
SELECT CASE WHEN item_id IS NULL THEN 'new' WHEN item_id % 4 <> 0 AND id % 3 = 0 THEN 're-extract' ELSE 'touch' END AS decision, count(*) AS n FROM s LEFT JOIN it USING (c) GROUP BY 1""",
    "stream_pieces": "SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '(?:\\s*\\S+){1,6}|\\s+')) AS BIGINT) AS pieces, true AS lossless FROM conversations",
    "import_kind_counts": f"WITH {_X}, c AS (SELECT {_IMPORT_KIND} AS kind FROM y) SELECT k AS value, (SELECT count(*) FROM c WHERE kind = k) AS n FROM (SELECT unnest({list(D.KINDS)}) AS k)",
}
