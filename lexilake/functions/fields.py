"""Column functions over request fields, JSON bags and payloads of other services."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexilake.functions import text as T


def enum_list(said: Column, known: tuple[str, ...], strict: bool = False) -> Column:
    """A comma-separated list of known values: trimmed, empties off, each once. Unknown ones go, or make it null if ``strict``."""
    own = F.filter(F.transform(F.split(F.coalesce(said, F.lit("")), ","), F.trim), lambda v: v != "")
    some = F.array_distinct(F.filter(own, lambda v: v.isin(*known)))
    return F.when(F.forall(own, lambda v: v.isin(*known)), some) if strict else some


def epoch(said: Column) -> Column:
    """A finite number as whole milliseconds, else null."""
    n = F.trim(said).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < 9e15), n).cast("bigint")


def kind_field(bag: Column, camel: str, kind: str = "string") -> Column:
    """A field of a JSON bag under its camel- or snake-case name, null where its type is another."""
    snake = "".join("_" + c.lower() if c.isupper() else c for c in camel)
    return F.coalesce(F.get_json_object(bag, f"$.{camel}"), F.get_json_object(bag, f"$.{snake}")).try_cast(kind)


def merged_json(base: Column, patch: Column) -> Column:
    """Two flat JSON objects in one; later keys win."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    own, new = as_map(base), as_map(patch)
    return F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(new, k)), new)


def wire_id(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), number.cast("string"))


def parsed_wire_id(prefix: str, said: Column) -> Column:
    """The number of a wire id: no sign, no leading zero, within the exact range of a double."""
    n = F.regexp_extract(said, rf"^{prefix}_([1-9][0-9]*)$", 1).try_cast("bigint")
    return F.when(n <= 9007199254740991, n)


def byte_cut(text: Column, most: int | Column) -> Column:
    """The longest head of a text of at most ``most`` UTF-8 bytes, never half a character.

    A character is whole if the byte behind the cut begins another one, so at most four places are looked at.
    """
    most = F.greatest(F.lit(0), F.lit(most) if isinstance(most, int) else most).cast("int")
    own = text.cast("binary")
    inside = lambda at: F.hex(F.substring(own, at + 1, F.lit(1))).between("80", "BF")
    at = F.when(~inside(most), most).when(~inside(most - 1), most - 1).when(~inside(most - 2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(own, F.lit(1), at).cast("string"))


#: What stands where a field was cut, and the bytes that all fields of a capture may have.
CUT_MARKER, PAYLOAD_BYTES = "\n\n[…truncated: this field exceeded the 1 MB capture limit…]", 1_000_000


def byte_capped(fields: dict[str, Column], most: int = PAYLOAD_BYTES, marker: str = CUT_MARKER) -> Column:
    """A struct of the fields and ``truncated``: together at most ``most`` bytes.

    If they have more, each gets its share by its size, with room for the marker, and
    is cut between characters; a marker follows where something was cut. A null
    field has no share and stays null.
    """
    size = {name: F.coalesce(F.octet_length(c), F.lit(0)) for name, c in fields.items()}
    total = sum(size.values(), F.lit(0))
    fits = total <= most

    def cut(name: str) -> Column:
        room = F.floor(most * (size[name].cast("double") / total)).cast("int") - len(marker.encode())
        kept = byte_cut(fields[name], room)
        return F.when(fits, fields[name]).otherwise(F.when(F.length(kept) < F.length(fields[name]), F.concat(kept, F.lit(marker))).otherwise(kept))

    return F.struct(*[cut(name).alias(name) for name in fields], (~fits).alias("truncated"))


def enrichment_ok(said: Column, kind: Column) -> Column:
    """Whether a model's JSON keeps the schema: tldr of 1 to 600 characters, 3 to 5 bullets of 1 to 400, 3 to 8 tags of 1 to 40, topic of 1 to 80, confidence 0 to 1.

    Repositories also say what they do and what they are used for, in 1 to 300 characters each.
    """
    own = F.from_json(T.unfenced(said), "tldr string, bullets array<string>, tags array<string>, topic string, confidence double, kindFields struct<what_it_does:string,primary_use_case:string>")
    sized = lambda c, most: F.coalesce(T.utf16_length(c).between(1, most), F.lit(False))
    ok = (
        sized(own["tldr"], 600) & F.size(own["bullets"]).between(3, 5) & F.forall(own["bullets"], lambda x: sized(x, 400))
        & F.size(own["tags"]).between(3, 8) & F.forall(own["tags"], lambda x: sized(x, 40)) & sized(own["topic"], 80) & own["confidence"].between(0, 1)
        & ((kind != "github") | (sized(own["kindFields"]["what_it_does"], 300) & sized(own["kindFields"]["primary_use_case"], 300)))
    )
    return F.coalesce(ok, F.lit(False))


REPOSITORY = "full_name string, description string, language string, stargazers_count bigint, license struct<spdx_id:string,name:string>, pushed_at string, created_at string, owner struct<login:string,avatar_url:string>"
OEMBED = "title string, author_name string, thumbnail_url string"
TIMED_TEXT = "events array<struct<tStartMs:bigint,segs:array<struct<utf8:string>>>>"


def repository(payload: Column) -> Column:
    own = F.from_json(payload, REPOSITORY)
    return F.struct(own["full_name"].alias("name"), own["description"].alias("description"), own["language"].alias("language"), own["stargazers_count"].alias("stars"), F.coalesce(own["license"]["spdx_id"], own["license"]["name"]).alias("license"))


def embedded(payload: Column) -> Column:
    return F.from_json(payload, OEMBED)


def transcript_lines(segments: Column) -> Column:
    """Segments (timestamp, text) of a transcript as lines ``[0:18] text``; those without a text are left out, and none is the empty text."""
    said = F.filter(segments, lambda x: T.js_trim(F.coalesce(x["text"], F.lit(""))) != "")
    return F.array_join(F.transform(said, lambda x: F.concat(F.lit("["), T.js_trim(F.coalesce(x["timestamp"], F.lit(""))), F.lit("] "), T.js_trim(x["text"]))), "\n")


def transcript(payload: Column) -> Column:
    """Caption events as one text: segments joined, line ends as spaces, empty ones left out."""
    events = F.from_json(payload, TIMED_TEXT)["events"]
    lines = F.transform(F.filter(events, lambda e: e["segs"].isNotNull()), lambda e: F.trim(F.regexp_replace(F.array_join(F.transform(e["segs"], lambda s: s["utf8"]), ""), r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def atom_entry(xml: Column) -> Column:
    """Title, summary, date, authors and categories of an Atom entry."""
    entry = F.regexp_extract(xml, r"(?s)<entry\b[^>]*>(.*?)</entry>", 1)
    one = lambda tag: F.trim(F.regexp_replace(T.xml_decoded(F.regexp_extract(entry, rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1)), r"\s+", " "))
    names = F.transform(F.regexp_extract_all(entry, F.lit(r"(?s)<name>(.*?)</name>"), F.lit(1)), lambda n: F.trim(T.xml_decoded(n)))
    return F.struct(one("title").alias("title"), one("summary").alias("summary"), one("published").alias("published"), names.alias("authors"), F.regexp_extract_all(entry, F.lit(r"<category[^>]*\bterm=\"([^\"]*)\""), F.lit(1)).alias("categories"))


def thread(html: Column) -> Column:
    """Posts of a thread page in order with a rule between, the author of its first permalink, and their number."""
    posts = F.regexp_extract_all(html, F.lit(r"(?is)<article\b[^>]*>(.*?)</article>"), F.lit(1))
    texts = F.filter(F.transform(posts, lambda p: F.trim(F.regexp_replace(T.xml_decoded(F.regexp_replace(p, r"(?s)<[^>]*>", " ")), r"\s+", " "))), lambda x: x != "")
    author = F.nullif(F.regexp_extract(html, r"/([A-Za-z0-9_]+)/status/\d+", 1), F.lit(""))
    return F.struct(F.array_join(texts, "\n\n---\n\n").alias("text"), author.alias("author"), F.size(texts).alias("posts"))


def caption(author: Column, text: Column) -> Column:
    return F.concat_ws(": ", F.nullif(author, F.lit("")), F.nullif(text, F.lit("")))


def file_version(name: Column) -> Column:
    return F.regexp_extract(name, r"\.v(\d+)\.[A-Za-z0-9]+$", 1).try_cast("int")
