"""Column functions over text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
CONTENT_CAP = 20_000
#: Fixed value: what stands for the middle that is left out.
MARKER = "\n\n[... content truncated to fit the model’s context window ...]\n\n"
MAX_QUERY_TOKENS = 24
#: Letters that are a to z with marks, and those letters: what the keyword index folds. Other scripts keep theirs.
_FOLDS = {
    chr(c): parts[0]
    for c in range(0xC0, 0x2000)
    if len(parts := unicodedata.normalize("NFD", chr(c))) > 1 and parts[0] in "abcdefghijklmnopqrstuvwxyz" and all("\u0300" <= m <= "\u036f" for m in parts[1:])
}
COMBINING = r"[\x{300}-\x{36F}]+"
MARKED, PLAIN = "".join(_FOLDS), "".join(_FOLDS.values())
#: Direction marks, zero-width characters and the byte order mark.
INVISIBLE = r"[\u200b-\u200f\u202a-\u202e\u2066-\u2069\ufeff]"
SPACES = r"[\u00a0\u202f]"
#: What a chip of a manually named topic is coloured with.
PALETTE = ("#6366f1", "#0ea5e9", "#10b981", "#f59e0b", "#ef4444", "#8b5cf6")
#: How a model says that it has nothing, with a plain or a curly apostrophe.
REFUSALS = (
    r"\bnothing (?:saved|in (?:your|my) library|i['’]?ve saved)\b",
    r"\bdon['’]?t have (?:anything|any (?:information|items|notes|saved))\b",
    r"\bno(?:thing)? (?:saved|relevant|matching) (?:items?|information)?\s*(?:found|about|on)\b",
    r"\bcouldn['’]?t find (?:anything|any(?:thing)?)\b",
    r"\bdoesn['’]?t (?:appear to|seem to)? ?cover\b",
    r"\bnot (?:something|anything) (?:you|i) saved\b",
    r"\bi don['’]?t see anything\b",
)


def js_trim(text: Column) -> Column:
    """Trim every Unicode space, as browsers do; Spark's trim knows only the plain one."""
    return F.regexp_replace(text, r"(?U)^[\s\ufeff]+|[\s\ufeff]+$", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(utf16_length(F.coalesce(text, F.lit(""))) / CHARS_PER_TOKEN)


def folded(text: Column) -> Column:
    """Lower case without marks, composed or combining."""
    return F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), COMBINING, "")


def index_tokens(text: Column) -> Column:
    """Tokens of the keyword index: runs of letters and digits, case and marks folded."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_tokens(text: Column, most: int = MAX_QUERY_TOKENS) -> Column:
    """Distinct tokens of a query in order of appearance, at most ``most``."""
    return F.slice(F.array_distinct(index_tokens(text)), 1, most)


def utf16_left(text: Column, most: Column) -> Column:
    """The first ``most`` UTF-16 units; half of a character beyond the basic plane is left out."""
    doubled = F.left(F.regexp_replace(text, r"([\x{10000}-\x{10FFFF}])", "$1\uffff"), most)
    return F.when(utf16_length(text) == F.length(text), F.left(text, most)).otherwise(F.replace(F.regexp_replace(doubled, r"[\x{10000}-\x{10FFFF}]$", ""), F.lit("\uffff"), F.lit("")))


def utf16_right(text: Column, most: Column) -> Column:
    """The last ``most`` UTF-16 units; half of a character beyond the basic plane is left out."""
    doubled = F.right(F.regexp_replace(text, r"([\x{10000}-\x{10FFFF}])", "$1\uffff"), most)
    return F.when(utf16_length(text) == F.length(text), F.right(text, most)).otherwise(F.replace(doubled, F.lit("\uffff"), F.lit("")))


def capped(text: Column, most: int = CONTENT_CAP) -> Column:
    """Trimmed, and cut with a note of its length if longer than ``most``."""
    own = js_trim(text)
    note = F.concat(utf16_left(own, F.lit(most)), F.lit("\n\n[truncated — original was "), utf16_length(own).cast("string"), F.lit(" characters]"))
    return F.when(utf16_length(own) <= most, own).otherwise(note)


def head_and_tail(text: Column, tokens: int, head_ratio: float = 0.7) -> Column:
    """Head and tail around a marker, within a token budget."""
    budget = tokens * CHARS_PER_TOKEN
    keep = max(0, budget - len(MARKER))
    head = int(keep * head_ratio)
    tail = keep - head
    cut = F.concat(utf16_left(text, F.lit(head)), F.lit(MARKER), utf16_right(text, F.lit(tail)) if tail else F.lit(""))
    return F.when(utf16_length(text) <= budget, text).otherwise(cut)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")


def normal_line(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, INVISIBLE, ""), SPACES, " ")


def slug(text: Column, fallback: str = "") -> Column:
    own = F.regexp_replace(F.regexp_replace(F.lower(js_trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(own == "", F.lit(fallback)).otherwise(own) if fallback else own


def slug_label(own: Column) -> Column:
    words = F.filter(F.split(own, r"[-_\s]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def slug_colour(own: Column) -> Column:
    """A palette colour by the 31-hash of the slug, kept in 32 signed bits."""
    span = 1 << 32
    wrap = lambda h: F.pmod(h + F.lit(span // 2), F.lit(span)) - F.lit(span // 2)
    h = F.aggregate(F.filter(F.split(own, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda acc, c: wrap(acc * 31 + F.ascii(c)))
    return F.element_at(F.array(*[F.lit(c) for c in PALETTE]), (F.abs(h) % len(PALETTE) + 1).cast("int"))


def masked_secret(text: Column) -> Column:
    return F.when(F.length(text) <= 10, F.lit("••••")).otherwise(F.concat(F.left(text, F.lit(6)), F.lit("••••"), F.right(text, F.lit(4))))


def xml_decoded(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def unfenced(text: Column) -> Column:
    """The inside of a Markdown code fence, if the text is one."""
    inner = F.regexp_extract(js_trim(text), r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(inner != "", inner).otherwise(js_trim(text))


def untrusted(text: Column) -> Column:
    """Wrapped in delimiters that cannot be forged from inside."""
    own = F.regexp_replace(text, r"(?i)<\s*/?\s*untrusted_content\s*>", "")
    return F.concat(F.lit("<untrusted_content>\n"), own, F.lit("\n</untrusted_content>"))


def citations(text: Column) -> Column:
    """Distinct ``[n]`` markers in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda n: n.cast("int")))


def citations_valid(text: Column, sources: Column) -> Column:
    cited = citations(text)
    return F.when(sources == 0, True).otherwise((F.size(cited) > 0) & F.forall(cited, lambda n: (n >= 1) & (n <= sources)))


def is_refusal(text: Column) -> Column:
    said = F.lit(False)
    for pattern in REFUSALS:
        said = said | text.rlike("(?i)" + pattern)
    return said


def stream_pieces(text: Column, words: int = 6) -> Column:
    """Pieces of up to ``words`` words that join to the text again; space leads the next piece."""
    return F.regexp_extract_all(text, F.lit(rf"(?:\s*\S+){{1,{words}}}|\s+"), F.lit(0))


def snippet(text: Column, most: int = 220) -> Column:
    own = js_trim(text)
    return F.when(F.length(own) <= most, own).otherwise(F.concat(js_trim(F.left(own, F.lit(most))), F.lit("…")))


def cache_key(user: Column, question: Column, scope: Column) -> Column:
    asked = F.lower(F.regexp_replace(js_trim(question), r"(?U)\s+", " "))
    return F.sha2(F.concat_ws("\u0001", user.cast("string"), asked, scope), 256)
