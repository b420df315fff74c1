"""Ingest: page extraction, chunking, chat exports, link imports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexilake.functions import text as T
from lexilake.functions import urls as U
from lexilake.functions.main_text import readable

ARTICLE_MIN = 400
TARGET_TOKENS, OVERLAP_TOKENS, SHORT_TOKENS = 500, 75, 200
PHRASES = {"github": "a GitHub repository", "video": "a video", "article": "an article", "social": "a social media post", "pdf": "a PDF document", "audio": "an audio recording"}
_boundary = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9\"'])|\n{2,}")


def meta(html: Column, name: str) -> Column:
    """Content of a ``<meta>`` by property or name, entities decoded; null without one."""
    tag = F.regexp_extract(html, rf"(?is)<meta\s[^>]*(?:property|name)\s*=\s*[\"']{re.escape(name)}[\"'][^>]*>", 0)
    return F.nullif(T.xml_decoded(F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)), F.lit(""))


def title(html: Column) -> Column:
    own = F.trim(T.xml_decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.coalesce(meta(html, "og:title"), F.nullif(own, F.lit("")))


def ladder(*rungs: tuple[str, Column, Column]) -> Column:
    """The first rung (tier, condition, text) that holds, as a struct of tier and text."""
    out = F.lit(None)
    for tier, holds, text in reversed(rungs):
        out = F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(tier).alias("tier"), text.alias("text"))).otherwise(out)
    return out


def extracted(pages: DataFrame, least: int = ARTICLE_MIN) -> DataFrame:
    """page_id, title, tier and text of each page: full text, else its description, else metadata only."""
    own = pages.select("page_id", "url", "html", readable(F.col("html")).alias("body"))
    rung = ladder(("full", F.length("body") >= least, F.col("body")), ("partial", meta(F.col("html"), "og:description").isNotNull(), meta(F.col("html"), "og:description")), ("metadata_only", F.lit(True), F.lit(None).cast("string")))
    named = own.select("page_id", F.coalesce(title(F.col("html")), U.title_from(F.col("url"))).alias("title"), rung.alias("r"))
    return named.select("page_id", "title", F.col("r.tier").alias("tier"), T.capped(F.col("r.text")).alias("text"))


def _tokens(text: str) -> int:
    return -(-(len(text) + sum(c > "\uffff" for c in text)) // T.CHARS_PER_TOKEN)


def windows_of(text: str) -> list[str]:
    """Greedy windows of whole sentences up to the target, each led by the tail of the one before."""
    text = text.strip()
    if not text:
        return []
    if _tokens(text) <= SHORT_TOKENS:
        return [text]
    out, now, size = [], [], 0
    for sentence in filter(None, map(str.strip, _boundary.split(text))):
        n = _tokens(sentence)
        if now and size + n > TARGET_TOKENS:
            out.append(" ".join(now))
            tail, size = [], 0
            while now and size < OVERLAP_TOKENS:
                tail.insert(0, now.pop())
                size += _tokens(tail[0])
            now = tail
        now.append(sentence)
        size += n
    return [*out, " ".join(now)] if now else out


def chunked(items: DataFrame) -> DataFrame:
    """Chunks of each item (item_id, user_id, title, kind, content): item_id, user_id, ord, text. An order-dependent fold over one text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [
                (i, u, k, f'From "{t or ""}" ({PHRASES.get(kind, "a saved item")}):\n\n{w}')
                for i, u, t, kind, c in zip(rows["item_id"], rows["user_id"], rows["title"], rows["kind"], rows["content"])
                for k, w in enumerate(windows_of(c or ""))
            ]
            yield pd.DataFrame(out, columns=["item_id", "user_id", "ord", "text"])

    return items.select("item_id", "user_id", "title", "kind", "content").mapInPandas(run, "item_id bigint, user_id bigint, ord bigint, text string")


# Chat exports.

HEADER = r"^\[?(\d{1,2})/(\d{1,2})/(\d{2,4}),\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp][Mm])?"
IOS, ANDROID = r"^\[" + HEADER[4:] + r"\]\s(.*)$", "^" + HEADER[4:] + r"\s-\s(.*)$"
LOOKS_LIKE = r"^\[?\d{1,2}/\d{1,2}/\d{2,4},"


def chat_lines(files: DataFrame) -> DataFrame:
    """Lines of whole files (file, text): file, line (1 upwards), text; the byte order mark goes."""
    own = F.regexp_replace("text", "^\ufeff", "")
    return files.select("file", F.posexplode(F.split(own, "\r\n|\r|\n")).alias("pos", "raw")).select("file", (F.col("pos") + 1).cast("bigint").alias("line"), T.normal_line(F.col("raw")).alias("text"))


def chat_parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages (file, line, ms, author, text, is_system) and skipped lines (file, line, text, reason).

    Lines attach to the header before them; a bad header closes the message. The
    order of day and month is settled for each file by its first line that tells.
    """
    own = lines.where(F.trim("text") != "")
    ios, android = F.col("text").rlike(IOS), F.col("text").rlike(ANDROID)
    group = lambda k: F.when(ios, F.regexp_extract("text", IOS, k)).otherwise(F.regexp_extract("text", ANDROID, k))
    number = lambda k: F.coalesce(group(k).try_cast("int"), F.lit(0))
    shape = F.when(ios | android, "header").when(F.col("text").rlike(LOOKS_LIKE), "unparseable").otherwise("more")
    cut = own.select("file", "line", "text", shape.alias("shape"), *[number(k).alias(n) for k, n in ((1, "c1"), (2, "c2"), (4, "h"), (5, "mi"), (6, "s"))], group(3).alias("y"), F.upper(group(7)).alias("half"), group(8).alias("rest"))
    tells = F.when(F.col("c1") > 12, "DMY").when(F.col("c2") > 12, "MDY")
    order = cut.where((F.col("shape") == "header") & tells.isNotNull()).groupBy("file").agg(F.min_by(tells, "line").alias("order"))
    dated = cut.join(order, "file", "left").withColumn("order", F.coalesce("order", F.lit("DMY")))
    day, month = F.when(F.col("order") == "DMY", F.col("c1")).otherwise(F.col("c2")), F.when(F.col("order") == "DMY", F.col("c2")).otherwise(F.col("c1"))
    year = F.coalesce(F.when(F.length("y") <= 2, F.col("y").try_cast("int") + 2000).otherwise(F.col("y").try_cast("int")), F.lit(0))
    half = F.col("half") != ""
    hour = F.when(half, F.col("h") % 12 + F.when(F.col("half") == "PM", 12).otherwise(0)).otherwise(F.col("h"))
    ok_time = (F.col("mi") < 60) & (F.col("s") < 60) & F.when(half, F.col("h").between(1, 12)).otherwise(F.col("h") < 24)
    date = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")
    ms = F.when((F.col("shape") == "header") & ok_time, (F.unix_date(date).cast("bigint") * 86400 + hour * 3600 + F.col("mi") * 60 + F.col("s")) * 1000)
    timed = dated.withColumn("ms", ms)
    opens = F.col("shape") != "more"
    w = W.partitionBy("file").orderBy("line")
    led = timed.withColumn("head", F.max(F.when(opens, F.col("line"))).over(w)).withColumn("good", F.coalesce(F.max(F.when(F.col("ms").isNotNull(), F.col("line"))).over(w) == F.col("head"), F.lit(False))).withColumn("any", F.max(F.when(F.col("ms").isNotNull(), F.lit(1))).over(w).isNotNull())
    body = F.when(F.col("shape") == "header", F.when(F.col("rest").contains(": "), F.regexp_extract("rest", r"(?s)^.*?: (.*)$", 1)).otherwise(F.col("rest"))).otherwise(F.col("text"))
    author = F.when(F.col("rest").contains(": "), F.regexp_extract("rest", r"(?s)^(.*?): ", 1))
    kept = led.where("good").groupBy("file", F.col("head").alias("line")).agg(F.max("ms").alias("ms"), F.max(F.when(F.col("shape") == "header", author)).alias("author"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", body.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    reason = F.when(F.col("shape") == "header", "invalid date or time").when(F.col("shape") == "unparseable", "unknown header").when(F.col("any"), "no message to attach to").otherwise("before any message")
    return kept.withColumn("is_system", F.col("author").isNull()), led.where("NOT good").select("file", "line", "text", reason.alias("reason"))


def chat_exports(spark: SparkSession, path: str) -> DataFrame:
    """Whole export files under a path: file, text. Zip archives give their ``_chat.txt``."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for file, data in zip(rows["path"], rows["content"]):
                if bytes(data[:2]) != b"PK":
                    out.append((file, bytes(data).decode("utf-8", "replace")))
                    continue
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names = z.namelist()
                    name = "_chat.txt" if "_chat.txt" in names else next((n for n in names if n.endswith("/_chat.txt")), None)
                    if name:
                        out.append((file, z.read(name).decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["file", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "file string, text string")


def first_seen(links: DataFrame, hash_col: str = "url_hash", order: str = "pos") -> DataFrame:
    """The first of each hash, and how many others it stands for."""
    w = W.partitionBy(hash_col)
    return links.withColumn("rn", F.row_number().over(w.orderBy(order))).withColumn("duplicates", F.count("*").over(w) - 1).where("rn = 1").drop("rn")


def captured(links: DataFrame, items: DataFrame, form: str = "capture") -> DataFrame:
    """What becomes of captured links (url, has_hint): new, re-extract (not full and a fresh hint), or touch."""
    own = links.withColumn("url_hash", U.url_hash(U.canonical(F.col("url"), form)))
    met = own.join(items.select("url_hash", "item_id", "extraction_tier"), "url_hash", "left")
    what = F.when(F.col("item_id").isNull(), "new").when((F.col("extraction_tier") != "full") & F.col("has_hint"), "re-extract").otherwise("touch")
    return met.select("url", "url_hash", "item_id", what.alias("decision"))
