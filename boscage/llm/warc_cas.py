"""Content-addressed WARC archive.

Every page gets a WARC record: the bytes of its header block, and a payload. Payloads are stored
once, addressed by SHA-256 and verified by SHA-1 and length when stored and when read (a payload
that fails stops the job); header blocks are stored as exact bytes, one per record, in a second
table. Among records with equal payloads of at least ``min_bytes`` bytes, the one with the largest
page_id is the response and the others are revisits of it. ``records`` joins headers to payloads on
the address and gives each record's original bytes; ``read`` parses those bytes again. A payload
moves to its response only: a revisit needs no more than the digest and length at its address, so
a payload that a third of all records share is joined once.

Both stores are Parquet; ``export`` writes plain WARC files of the records, ``parse_file`` reads
one by the lengths that its headers tell.

Defined cases: null html is an empty payload; a url with line breaks is percent-encoded in its
target field, a null url is ``about:blank`` there, and a field of its own keeps what the url was, so
both come back; null page_ids are records without an id, responses only if no other has the payload;
rows that repeat the largest page_id are all responses; an empty table gives empty stores; further
columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, written

#: WARC names and values that are part of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
EPOCH = "2000-01-01T00:00:00Z"
#: Field that keeps a url which the target field can't: "base64:" and its base64, or a dash for null.
KEPT_URL = "X-Page-Url"


def base32(hex_digits: Column) -> Column:
    """Upper-case base32 of 40 hex digits: 5 hex digits make 4 base32 digits."""
    parts = [F.lpad(F.conv(F.substring(hex_digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _described(pages: DataFrame) -> DataFrame:
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), raw.alias("payload")).select("page_id", "url", "payload", F.sha2("payload", 256).alias("address"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))


def headers(rows: DataFrame) -> DataFrame:
    """page_id, address, bytes and header (the exact block, in bytes) of each record."""
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    url = F.replace(F.replace(F.coalesce("url", F.lit("about:blank")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    kept = F.when(F.col("url").isNull(), F.lit("-")).when((url != F.col("url")) | (F.col("url") == ""), F.concat(F.lit("base64:"), F.replace(F.base64(F.encode("url", "UTF-8")), F.lit(CRLF), F.lit(""))))
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit(CRLF))
    block = F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", ident(F.col("page_id"))),
        line("WARC-Date", F.lit(EPOCH)),
        line("WARC-Target-URI", url),
        F.coalesce(line(KEPT_URL, kept), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", ident(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )
    return rows.select("page_id", "address", "bytes", F.encode(block, "UTF-8").alias("header"))


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> str:
    """Writes ``path``/headers and ``path``/payloads."""
    rows = _described(pages)
    light = rows.select("page_id", "url", "address", "sha1", "bytes")
    # stored, so both sides of the join come from a shuffle of their own and a common address can be split
    best = written(light.groupBy("address").agg(F.max("page_id").alias("first")), "warc-first")
    linked = light.join(best, "address").withColumn("refers_to", F.when((F.col("bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    headers(linked).write.option("compression", "zstd").parquet(f"{path}/headers")
    # equal addresses must hold equal digests and lengths; then any payload is the stored one. Copies
    # collapse in the task that reads them, before anything moves
    same = (F.min("sha1") == F.max("sha1")) & (F.min("bytes") == F.max("bytes"))
    failed = F.raise_error(F.concat(F.lit("payloads differ at address "), F.col("address"))).cast("binary")
    loads = rows.groupBy("address").agg(F.when(same, F.any_value("payload")).otherwise(failed).alias("payload"), F.min("sha1").alias("sha1"), F.min("bytes").alias("bytes"))
    loads.write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def _field(name: str) -> Column:
    """A field of ``header``, the text of a header block."""
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def records(spark: SparkSession, path: str) -> DataFrame:
    """address, record (the original bytes: header block, content, two line ends), and the verified
    digest and length of the payload, also of a revisit's."""
    heads = spark.read.parquet(f"{path}/headers").select("address", "bytes", F.col("header").alias("_head"), F.decode("header", "UTF-8").alias("header"))
    loads = spark.read.parquet(f"{path}/payloads").select("address", "payload", F.col("sha1").alias("_sha1"), F.col("bytes").alias("_bytes"))
    told = (F.col("bytes") == F.col("_bytes")) & (F.concat(F.lit("sha1:"), base32(F.col("_sha1"))) == _field("WARC-Payload-Digest"))
    whole = (F.sha2("payload", 256) == F.col("address")) & (F.sha1("payload") == F.col("_sha1")) & (F.octet_length("payload") == F.col("_bytes")) & (F.col("_bytes").cast("string") == _field("Content-Length"))
    failed = F.raise_error(F.concat(F.lit("payload not verified: "), F.coalesce("address", F.lit("")))).cast("binary")
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    revisit = _field("WARC-Type") == "revisit"
    out = lambda ok, content: ["address", F.when(ok, F.concat("_head", *content, end)).otherwise(failed).alias("record"), base32(F.col("_sha1")).alias("payload_digest"), F.col("_bytes").alias("payload_bytes")]
    first = heads.filter(~revisit).join(loads, "address", "left").select(*out(told & whole, ["payload"]))
    again = heads.filter(revisit).join(loads.drop("payload"), "address", "left").select(*out(told & (_field("Content-Length") == "0"), []))
    return first.unionByName(again)


def parse(found: DataFrame) -> DataFrame:
    """The fields of ``records``, read from their bytes: the header block up to the first empty
    line, then as much content as it tells."""
    size = F.instr(F.decode(F.substring("record", 1, 1 << 16), "ISO-8859-1"), CRLF * 2) + 3
    size = F.when(size > 3, size).otherwise(F.instr(F.decode("record", "ISO-8859-1"), CRLF * 2) + 3)  # a very long url
    cut = found.withColumn("_size", size).withColumn("header", F.decode(F.expr("substring(record, 1, _size)"), "UTF-8"))
    length = _field("Content-Length").cast("int")
    ident = lambda name: F.regexp_extract("header", rf"\r\n{name}: <urn:page:(-?\d+)>\r\n", 1).try_cast("long")
    kept = _field(KEPT_URL)
    url = F.when(kept.isNull(), _field("WARC-Target-URI")).when(kept != "-", F.decode(F.unbase64(F.substring_index(kept, ":", -1)), "UTF-8"))
    content = F.expr("substring(record, _size + 1, _length)")
    cut = cut.withColumn("_length", length)
    response = _field("WARC-Type") == "response"
    return cut.select(
        ident("WARC-Record-ID").alias("page_id"), url.alias("url"), "header", F.when(response, content).alias("payload"),
        F.when(response, F.octet_length(content).cast("long")).otherwise(F.when(F.octet_length("record") > 0, F.col("payload_bytes"))).alias("payload_bytes"),
        F.when(response, base32(F.sha1(content))).otherwise(F.substring_index(_field("WARC-Payload-Digest"), ":", -1)).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"), ident("WARC-Refers-To").alias("refers_to"),
        (F.octet_length("record") == F.col("_size") + F.col("_length") + 4).alias("verified"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record, parsed from its original bytes: the fields, the header block, and the payload
    (null for a revisit, whose digest and length are those of the payload that it stands for)."""
    return parse(records(spark, path))


def export(spark: SparkSession, path: str, target: str, per_file: int = 20_000) -> None:
    """WARC files (gzip) of the records of ``path`` below ``target``: a record ends in two line
    ends, so they are the line separator of the text writer."""
    body = F.decode(F.expr("substring(record, 1, octet_length(record) - 4)"), "UTF-8")
    records(spark, path).select(body.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(target)


def parse_file(data: bytes) -> Iterator[dict]:
    """The records of a WARC file's (unpacked) bytes, one after the other by their lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        block = data[at:end].decode("utf-8")
        field = lambda name, block=block: (re.findall(rf"\r\n{name}: ([^\r]*)\r\n", block) or [None])[0]
        size = int(field("Content-Length"))
        ident = lambda name, field=field: int(m.group(1)) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", field(name) or "")) else None
        kept, url = field(KEPT_URL), field("WARC-Target-URI")
        url = url if kept is None else None if kept == "-" else base64.b64decode(kept.removeprefix("base64:")).decode("utf-8")
        yield {"page_id": ident("WARC-Record-ID"), "url": url, "record_type": field("WARC-Type"), "refers_to": ident("WARC-Refers-To"), "payload_digest": field("WARC-Payload-Digest").removeprefix("sha1:"), "header": block, "payload": data[end : end + size]}
        if data[end + size : end + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length tells")
        at = end + size + 4


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages' archive to the shared folder and reads it back."""
    spark = pages.sparkSession
    return read(spark, write(pages, scratch(spark, "warc"), min_bytes))
