"""SQL that says what the registered queries return, where SQL can."""

from __future__ import annotations

from lexilake.llm import chat, divergence, suffixes

#: Windows are worked out again, as the number of formatted characters depends on them.
OP1 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok'))),
k AS (SELECT *, CAST(ceil(strlen(text) / 4.0) AS BIGINT) + {chat.MARKS} AS tokens,
  {len(chat.START) + len(chat.TEXT) + len(chat.END)} + length(role) + length(text) + len(regexp_extract_all(role, '<\\\\*\\|')) + len(regexp_extract_all(text, '<\\\\*\\|')) AS chars FROM c),
n AS (SELECT *, row_number() OVER o - 1 AS seq, sum(tokens) OVER o - tokens AS before FROM k WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
l AS (SELECT conv_id, tokens AS lead_tokens, chars AS lead_chars FROM n WHERE seq = 0 AND role = 'system'),
m AS (SELECT n.*, lead_chars, floor(greatest(1, {chat.BUDGET - chat.HISTORY} - coalesce(lead_tokens, 0)) / 2.0) AS half FROM n LEFT JOIN l USING (conv_id)),
s AS (
  SELECT conv_id, min(before) AS start, min(seq) AS first, max(lead_chars) AS lead_chars FROM m
  GROUP BY conv_id, floor((before + tokens - 1) / greatest(1, half)), CASE WHEN tokens > half THEN before ELSE -1 END),
past AS (
  SELECT s.conv_id, sum(m.chars) AS chars FROM s JOIN m ON m.conv_id = s.conv_id AND m.seq < s.first AND m.before + {chat.HISTORY} >= s.start
  WHERE m.lead_chars IS NULL OR m.seq > 0 GROUP BY s.conv_id),
again AS (SELECT conv_id, sum(lead_chars) AS chars FROM s WHERE first > 0 GROUP BY conv_id),
d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), '') AS learned, sum(chars) AS chars
  FROM n GROUP BY conv_id)
SELECT d.conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
  CAST(d.chars + coalesce(past.chars, 0) + coalesce(again.chars, 0) AS BIGINT) AS formatted_chars
FROM d LEFT JOIN past USING (conv_id) LEFT JOIN again USING (conv_id)
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS top FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda k: CAST('0x' || substr(hex, 5 * k + 1, 5) AS BIGINT)) AS parts FROM h),
c AS (SELECT *, flatten(list_transform(parts, lambda v: [v >> 15 & 31, v >> 10 & 31, v >> 5 & 31, v & 31])) AS digits FROM b)
SELECT page_id, payload_bytes, array_to_string(list_transform(digits, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM c
"""

_N = suffixes.SPAN
OP6 = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, substr(h, 2 * s + 1, {2 * _N}) AS k, s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {_N - 1})) AS s FROM d)),
r AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
i AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= {_N} THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM i),
x AS (SELECT doc_id, min(s) AS lo, max(s) + {_N} AS hi FROM g GROUP BY doc_id, run),
y AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM x),
z AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS head FROM y JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN z USING (doc_id)
"""

#: Every term against every pair of sources, zero counts included.
OP11 = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
r AS (SELECT row_number() OVER () AS id, * FROM d),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM r),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= {divergence.MIN_DOCUMENTS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(l.total, 0) AS lang_total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang)),
x AS (SELECT g.*, term, k.n AS lang_n, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM x),
p AS (
  SELECT lang, source, term, n, 1 + ({divergence.UNIT}::HUGEINT * (n + {divergence.SMOOTH})::HUGEINT) // (total + {divergence.SMOOTH} * v)::HUGEINT AS p,
    1 + ({divergence.UNIT}::HUGEINT * (lang_n + {divergence.SMOOTH})::HUGEINT) // (lang_total + {divergence.SMOOTH} * v)::HUGEINT AS q FROM s),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
u AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM every LEFT JOIN pairs USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT * FROM o WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""


def _whole(scale: int, label: str = "0", where: str = "true") -> str:
    """Rows that take part, component by component."""
    return f"""
SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND {where} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


_PRODUCT = "CAST(list_sum(list_transform(list_zip({0}.v, {1}.v), lambda z: z[1] * z[2])) AS BIGINT)"

OP12 = f"""
WITH w AS ({_whole(256, "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END", "label IS NOT NULL")}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, {_PRODUCT.format("a", "b")} AS score FROM w a JOIN w b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER o AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 3
"""

OP13 = f"""
WITH w AS ({_whole(1024)}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, {_PRODUCT.format("q", "c")} AS score FROM w q JOIN w c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER o AS INTEGER) AS rank, vec_id, score FROM s
WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 10
"""
