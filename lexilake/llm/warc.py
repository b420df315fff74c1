"""WARC archives, read by boundary-chain verification.

Reading: every task splits its byte ranges at the magic and emits, for each
candidate record, its offset and that of its successor by the declared length.
Magic inside a payload makes false candidates, even whole false records; the file
start settles it. Chains are first followed inside each range, which leaves one
exit per candidate; pointer jumping from the file start over these exits finds
where the true chain enters each range, in as many rounds as the logarithm of a
file's ranges. Only records on that chain are kept. A chain must end where its file
does: files where it does not (a truncated record, a header that cannot be read) are
counted and reported, never passed over.

Versions 1.0 and 1.1 are read, header fields of any name, folded or not, headers of
any length, and gzipped files. Both ways use Spark's readers and writers alone, so archives can be in any store
that Spark reaches.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexilake.llm.common import fresh_path, whole_number, written

#: What files are split at, and what follows it in the versions that are read.
MAGIC, VERSIONS = b"WARC/1.", (b"0\r\n", b"1\r\n")
GAP = len(MAGIC)
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_field = re.compile(rb"^([^\s:]+)[ \t]*:[ \t]*(.*?)[ \t]*$", re.S)
_fold = re.compile(rb"\r\n[ \t]+")
CANDIDATE = (
    "file string, block bigint, rel bigint, next bigint, exit bigint, body bigint, size bigint, complete boolean, total bigint,"
    " record_type string, page_id bigint, refers_to bigint, declared_bytes bigint, declared_digest string, digest string, uri string"
)


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a text's UTF-8."""
    hexed = F.sha1(data.cast("binary"))
    out = []
    for k in range(8):
        v = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(F.substring(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", compression: str = "none") -> None:
    """Write one record per row as WARC files under ``path`` (``compression``: none or gzip).

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the
    largest id is a response and the others are revisits that refer to it; rows that
    repeat that id are responses too, and so are rows with a null id. Null payload:
    empty; null URL: no target field. Ids of any but an integral type raise an error.
    Other columns are not looked at.
    """
    known = pages.select(
        whole_number(pages, id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")
    ).select("*", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("bigint").alias("size"))
    # the few digests that have more than one id, so the payloads themselves are seldom shuffled
    several = known.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("id").alias("top"), F.min("id").alias("least")).where("top > least")
    several = written(several.select(F.col("digest").alias("d"), F.col("size").alias("z"), "top"), "repeated-payloads")
    marked = known.join(several, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("z")), "left")
    revisit = F.coalesce(F.col("id") < F.col("top"), F.lit(False))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    safe = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    number = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("none:"), F.col("digest")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), number, F.lit(">"))),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("top").cast("string"), F.lit(">")))).otherwise(""),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.when(safe.isNotNull(), line("WARC-Target-URI", safe)).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
    )
    # a record ends with two line ends: the separator of Spark's text writer
    marked.select(F.concat(head, F.when(revisit, "").otherwise(F.col("payload"))).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between magics, with the file and the start of the byte range whose task reads them."""
    read = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return read.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes, list[int]]]:
    """file, block, bytes of the range from its first piece on (magics between pieces included), starts of its pieces."""
    at, parts, starts, size = None, [], [], 0
    for batch in batches:
        for value, file, block in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if (file, block) != at:
                if at is not None:
                    yield *at, b"".join(parts), starts
                at, parts, starts, size = (file, block), [], [], 0
            piece = value.as_py()
            starts.append(size)
            parts += [piece, MAGIC]
            size += len(piece) + GAP
    if at is not None:
        yield *at, b"".join(parts), starts


def _headers(data: bytes, starts: list[int]) -> Iterator[tuple[int, int, dict[bytes, bytes]]]:
    """start, where the body begins, and the fields (names in lower case) of each well-formed header, last first.

    Starts before one and the same blank line share what follows the last of them,
    so every byte is parsed once; the last field of a name counts.
    """
    end, known, fields = len(data), len(data), {}
    for start in reversed(starts):
        if data[start : start + 3] not in VERSIONS:
            continue
        blank = data.find(b"\r\n\r\n", start, min(end + 4, len(data)))
        if blank < 0:
            continue
        if blank != end:
            end, known, fields = blank, blank, {}
        for row in reversed(_fold.sub(b" ", data[start + 3 : known]).split(b"\r\n")):
            if m := _field.match(row):
                fields.setdefault(m[1].lower(), m[2])
        known = start
        if fields.get(b"content-length", b"").isdigit() and b"warc-type" in fields:
            yield start, end + 4, dict(fields)


def _page(value: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(m[1]) if m else None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CANDIDATE.split(",")]
    schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[x.split()[1]]) for n, x in zip(names, CANDIDATE.split(","))])
    for file, block, data, starts in _blocks(batches):
        found, view = {}, memoryview(data)
        for start, body, fields in _headers(data, starts[1:] if block == 0 else starts):  # what the file begins with is behind no magic
            size = int(fields[b"content-length"])
            found[start] = {
                "file": file, "block": block, "rel": start, "next": body + size + 4 + GAP, "body": body, "size": size, "complete": body + size <= len(data) - GAP,
                "record_type": fields[b"warc-type"].decode("utf-8", "replace"), "page_id": _page(fields.get(b"warc-record-id")), "refers_to": _page(fields.get(b"warc-refers-to")),
                "declared_bytes": int(x) if (x := fields.get(b"x-payload-length", b"")).isdigit() else None,
                "declared_digest": x.decode("utf-8", "replace").removeprefix("sha1:") if (x := fields.get(b"warc-payload-digest")) is not None else None,
                "digest": base64.b32encode(hashlib.sha1(view[body : body + size]).digest()).decode() if body + size <= len(data) - GAP else None,
                "uri": x.decode("utf-8", "replace") if (x := fields.get(b"warc-target-uri")) is not None else None,
            }
        for start in sorted(found, reverse=True):
            after = found[start]["next"]
            found[start]["exit"] = found[after]["exit"] if after in found else after
        rows = [{"file": file, "block": block, "total": len(data), "rel": -1}, *found.values()]
        for at in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_pylist(rows[at : at + 5000], schema=schema)


def _entries(known: DataFrame) -> DataFrame:
    """file and pos where the chain from each file's start enters a range."""
    exits = known.select("file", F.col("exit").alias("pos")).distinct()
    jump = written(known.select("file", "pos", "exit").join(exits, ["file", "pos"], "left_semi").unionByName(known.where(F.col("pos") == GAP).select("file", "pos", "exit")).distinct(), "jumps")
    reached = jump.where(F.col("pos") == GAP).select("file", "pos")
    doors = jump.select("file", "pos")
    n, before = reached.count(), -1
    while n != before and doors.count() > n:
        ahead = reached.join(jump, ["file", "pos"]).select("file", F.col("exit").alias("pos")).join(doors, ["file", "pos"], "left_semi")
        reached = written(reached.unionByName(ahead).distinct(), "reached")
        onward = jump.select("file", F.col("pos").alias("exit"), F.col("exit").alias("far"))
        jump = written(jump.join(onward, ["file", "exit"]).select("file", "pos", F.col("far").alias("exit")), "jumps")
        n, before = reached.count(), n
    return reached


def _follow(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of one range that lie on the chain from its entries."""
    after = dict(zip(rows["pos"], rows["next"]))
    keep: set[int] = set()
    for at in rows.loc[rows["entry"], "pos"]:
        while at in after and at not in keep:
            keep.add(at)
            at = after[at]
    return rows[rows["pos"].isin(keep)]


class BrokenArchive(ValueError):
    """Files whose chain of records does not end where they do."""


def broken_chains(known: DataFrame, kept: DataFrame) -> DataFrame:
    """file, file_bytes and ends_at (null: no record) of each file whose chain does not end at its end."""
    sizes = known.where("rel = -1").groupBy("file").agg((F.sum("total") - GAP).alias("file_bytes"))
    ends = kept.groupBy("file").agg((F.max("next") - GAP).alias("ends_at"))
    return sizes.join(ends, "file", "left").where(~F.col("file_bytes").eqNullSafe(F.col("ends_at")) & (F.col("file_bytes") > 0))


def verified_records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The records of the archives under ``path`` that the chain from each file's start reaches.

    file, offset, block, rel, body, size (of the block), complete, record_type,
    page_id, refers_to, uri, declared_bytes, declared_digest, digest (of the bytes
    read). A file that does not start with the magic has none. If the chain of a
    file ends anywhere but at its end, ``BrokenArchive`` is raised with the number of
    such files; without ``strict`` the whole records before the break are returned.
    """
    # without this, files gone since an earlier read of the same folder would be looked for
    found = written(_pieces(spark, path).mapInArrow(_candidates, CANDIDATE), "candidates")
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = found.where("rel = -1").select(F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    known = found.where("rel >= 0").join(base, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).drop("f", "b", "total")
    known = written(known.withColumn("pos", F.col("base") + F.col("rel")).withColumn("next", F.col("base") + F.col("next")).withColumn("exit", F.col("base") + F.col("exit")), "placed")
    entries = _entries(known).withColumn("_entry", F.lit(True))
    marked = known.join(entries, ["file", "pos"], "left").withColumn("entry", F.coalesce("_entry", F.lit(False))).drop("_entry")
    kept = marked.groupBy("file", "block").applyInPandas(_follow, marked.schema)
    kept = written(kept.withColumn("offset", F.col("pos") - GAP).drop("exit", "entry"), "records")
    if strict and (broken := broken_chains(found, kept).limit(5).collect()):
        n = broken_chains(found, kept).count() if len(broken) == 5 else len(broken)
        raise BrokenArchive(f"{n} files, among them " + "; ".join(f"{r['file']} ({r['file_bytes']} bytes, chain ends at {r['ends_at']})" for r in broken))
    kept = kept.drop("next")
    if kept.where("NOT complete").isEmpty():
        return kept
    # a payload with magic in it can run over the end of a range: put its parts together
    sizes = found.where("rel = -1").groupBy("file").agg((F.sum("total") - GAP).alias("file_bytes"))
    split = kept.where("NOT complete").join(sizes, "file").where(F.col("base") + F.col("body") + F.col("size") <= F.col("file_bytes")).drop("file_bytes")
    parts = _spanning(spark, path, split, base)
    digests = parts.groupBy("file", "pos").applyInPandas(_whole, "file string, pos bigint, payload binary").select(F.col("file").alias("f"), F.col("pos").alias("p"), "payload")
    late = split.join(digests, (F.col("file") == F.col("f")) & (F.col("pos") == F.col("p"))).where(F.octet_length("payload") == F.col("size"))

    names = kept.columns

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("digest")
            made = [base64.b32encode(hashlib.sha1(x.as_py()).digest()).decode() for x in batch.column(batch.schema.get_field_index("payload"))]
            batch = batch.set_column(at, "digest", pa.array(made, pa.string()))
            yield batch.select(names)

    return written(kept.where("complete").unionByName(late.select(*kept.columns, "payload").mapInArrow(digest, kept.schema)), "records")


def _placed_pieces(spark: SparkSession, path: str, base: DataFrame) -> DataFrame:
    """Each piece with the magic behind it and its place in the file."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, data, starts in _blocks(batches):
            for k, start in enumerate(starts):
                end = starts[k + 1] if k + 1 < len(starts) else len(data)
                yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "rel": start, "data": data[start:end]}], schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("data", pa.binary())]))

    raw = _pieces(spark, path).mapInArrow(place, "file string, block bigint, rel bigint, data binary")
    return raw.join(base, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select("file", (F.col("base") + F.col("rel")).alias("at"), "data")


def _spanning(spark: SparkSession, path: str, records: DataFrame, base: DataFrame) -> DataFrame:
    """file, pos, at, data: the parts of the payloads of records that more than one range holds."""
    need = records.select(F.col("file").alias("rf"), "pos", (F.col("base") + F.col("body")).alias("lo"), (F.col("base") + F.col("body") + F.col("size")).alias("hi"))
    pieces = _placed_pieces(spark, path, base)
    end = F.col("at") + F.octet_length("data")
    met = pieces.join(need, (F.col("file") == F.col("rf")) & (F.col("at") < F.col("hi")) & (end > F.col("lo")))
    skip, stop = F.greatest(F.lit(0), F.col("lo") - F.col("at")), F.least(F.octet_length("data").cast("bigint"), F.col("hi") - F.col("at"))
    return met.select("file", "pos", "at", F.substring(F.col("data"), (skip + 1).cast("int"), (stop - skip).cast("int")).alias("data"))


def _whole(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("at")
    return pd.DataFrame({"file": [rows["file"].iloc[0]], "pos": [rows["pos"].iloc[0]], "payload": [b"".join(rows["data"])]})


def payloads(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """file, offset and payload (bytes) of verified records."""

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("payload", pa.binary())])
        for file, block, data, starts in _blocks(batches):
            for start, body, fields in _headers(data, starts[1:] if block == 0 else starts):
                size = int(fields[b"content-length"])
                if body + size <= len(data) - GAP:
                    yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "rel": start, "payload": data[body : body + size]}], schema=schema)

    held = _pieces(spark, path).mapInArrow(bodies, "file string, block bigint, rel bigint, payload binary")
    own = held.join(records.where("complete").select("file", "block", "rel", "offset"), ["file", "block", "rel"]).select("file", "offset", "payload")
    base = records.select(F.col("file").alias("f"), F.col("block").alias("b"), "base").distinct()
    late = records.where("NOT complete")
    if late.isEmpty():
        return own
    parts = _spanning(spark, path, late, base).groupBy("file", "pos").applyInPandas(_whole, "file string, pos bigint, payload binary")
    return own.unionByName(parts.select("file", (F.col("pos") - GAP).alias("offset"), "payload"))


def archived_pages(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and read it back: one row per record.

    page_id, payload_bytes, payload_digest, record_type, refers_to. A response's
    length and digest are those of the bytes read; a revisit has no payload and
    carries them in its header.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_pages(pages, path, min_bytes, id_col, url_col, payload_col)
    own = F.col("record_type") == "response"
    return verified_records(spark, path).select(
        F.col("page_id").alias(id_col), F.when(own, F.col("size")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest")).otherwise(F.col("declared_digest")).alias("payload_digest"), "record_type", "refers_to",
    )
