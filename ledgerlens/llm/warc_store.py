"""Content-addressed WARC archive.

Payload bytes are stored once for each SHA-256, which reading computes again. The exact bytes ahead of a record's
payload (WARC headers and HTTP headers) are stored on their own; whole records are put together from both, and a record
whose payload another one holds already is a ``revisit`` of that one, so readers of plain WARC find what they expect.

An archive is two Parquet tables in one folder: ``payloads(digest, page_id, url, headers, payload)``, a row for each
payload of ``LEAST_BYTES`` or more with the headers of the response that owns it, and ``records(digest, headers, small)``
for all other records; payloads shorter than a reference to them lie beside their headers. Everything here is built-in
expressions. Digests that very many records share are joined as slim rows only; the bytes are moved once, to be laid
down by digest, and copies are dropped within each task before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .storage import fresh_path
from .text import whole

#: Payloads under this many bytes are never revisited.
LEAST_BYTES = 100
CRLF = "\r\n"
#: Fixed value: what a revisit by equal payload calls itself.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Equal rows that one step of :func:`_repeated` makes.
STEP = 4096

_PAYLOADS = "digest string, page_id long, url string, headers binary, payload binary"
_RECORDS = "digest string, headers binary, small binary"


def _field(name: str, value: Column | str) -> Column:
    """A header line; none where the value is null."""
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _record_id(page_id: Column, url: Column, digest: Column, copy: Column) -> Column:
    """A name-based identifier; rows that are equal in all else differ by ``copy``."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    name = F.md5(F.concat_ws("\n", part(page_id), part(url), digest, copy.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def _target(url: Column, page_id: Column) -> Column:
    """A URI for any url: blanks and control characters become ``%20``; a page without url has a name of its own."""
    return F.when(F.coalesce(url, F.lit("")) == "", F.concat(F.lit("urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")))).otherwise(F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20"))


def header_bytes(date: str) -> Column:
    """Exact bytes ahead of a record's payload, from columns page_id, url, digest, payload_bytes, copy, owner, owner_url, again."""
    c = F.col
    again, own = c("again"), c("url").rlike(r"^[^\x00-\x20\x7F]+$") & ~c("url").startswith("urn:x-page:")
    only = lambda x: F.when(again, x)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), _field("Content-Length", c("payload_bytes")), F.lit(CRLF))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        _field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _record_id(c("page_id"), c("url"), c("digest"), c("copy"))),
        _field("WARC-Date", date),
        _field("WARC-Target-URI", _target(c("url"), c("page_id"))),
        _field("WARC-Profile", only(F.lit(PROFILE))),
        _field("WARC-Refers-To", only(_record_id(c("owner"), c("owner_url"), c("digest"), F.lit(0)))),
        _field("WARC-Refers-To-Target-URI", only(_target(c("owner_url"), c("owner")))),
        _field("WARC-Refers-To-Date", only(F.lit(date))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), c("digest"))),
        _field("X-Page-ID", c("page_id")),
        _field("X-Refers-To-Page-ID", only(c("owner"))),
        _field("X-Page-URL-Hex", F.when(~own, F.hex(c("url").cast("binary")))),
        _field("Content-Type", "application/http; msgtype=response"),
        _field("Content-Length", F.length(http) + F.when(again, 0).otherwise(c("payload_bytes"))),
        F.lit(CRLF), http,
    ).cast("binary")


def _repeated(rows: DataFrame, n: str) -> DataFrame:
    """Each row ``n`` times, numbered from 1 by ``copy``; in two steps, so that no array is as long as ``n``."""
    steps = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {STEP}"))))
    return steps.withColumn("copy", F.explode(F.sequence(F.expr(f"_k * {STEP} + 1"), F.expr(f"least({n}, (_k + 1) * {STEP})")))).drop("_k")


def write_archive(pages: DataFrame, path: str | None = None, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write ``pages(page_id, url, html)`` as an archive; its folder. ``date`` is the time of capture, for all records.

    A null page is an empty payload. Among equal payloads of ``LEAST_BYTES`` or more the one with the least page_id
    is the response and the others are revisits of it; rows without page_id come last, and of rows that repeat the
    least page_id one is the response. Other columns aren't looked at; an empty table gives an empty archive.
    """
    spark, path = pages.sparkSession, path or fresh_path(pages.sparkSession, "warc")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), whole("html").cast("binary").alias("payload"))
    keyed = keyed.withColumns({"digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    # copies meet within each task first, so a payload moves once a task at most, however many records share it
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("o")
    owned = keyed.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("digest").agg(first, F.first("payload").alias("payload"))
    owned = owned.select("digest", "o.page_id", "o.url", F.octet_length("payload").cast("long").alias("payload_bytes"), F.lit(0).alias("copy"), F.lit(False).alias("again"), "payload")
    owned = owned.withColumns({"owner": F.col("page_id"), "owner_url": F.col("url")})
    owned.select("digest", "page_id", "url", header_bytes(date).alias("headers"), "payload").write.parquet(f"{path}/payloads")

    small = F.when(F.col("payload_bytes") < LEAST_BYTES, F.col("payload")).alias("small")
    slim = keyed.select("page_id", "url", "digest", "payload_bytes", small).groupBy("page_id", "url", "digest", "payload_bytes", "small").agg(F.count("*").alias("n"))
    owners = spark.read.schema(_PAYLOADS).parquet(f"{path}/payloads").select("digest", F.col("page_id").alias("owner"), F.col("url").alias("owner_url"), F.lit(True).alias("again"))
    rows = slim.join(owners, "digest", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    mine = F.col("again") & F.col("page_id").eqNullSafe(F.col("owner")) & F.col("url").eqNullSafe(F.col("owner_url"))
    rows = rows.withColumn("n_left", F.col("n") - F.when(mine, 1).otherwise(0)).where("n_left > 0")
    _repeated(rows, "n_left").select("digest", header_bytes(date).alias("headers"), "small").write.parquet(f"{path}/records")
    return path


def whole_records(spark: SparkSession, path: str) -> DataFrame:
    """``digest, owns, record``: every record of an archive as bytes: headers, block, two line ends.

    Written one after the other they are a WARC file. ``owns`` marks the responses whose payload others may refer to.
    """
    held = spark.read.schema(_PAYLOADS).parquet(f"{path}/payloads").select("digest", F.lit(True).alias("owns"), "headers", "payload")
    others = spark.read.schema(_RECORDS).parquet(f"{path}/records").select("digest", F.lit(False).alias("owns"), "headers", F.coalesce("small", F.lit(b"")).alias("payload"))
    end = F.lit((CRLF * 2).encode())
    return held.unionByName(others).select("digest", "owns", F.concat("headers", "payload", end).alias("record"))


def parsed(records: DataFrame) -> DataFrame:
    """Fields of WARC records from their bytes alone (column ``record``); the other columns stay.

    ``payload`` is what the record itself holds, ``payload_bytes`` the length that its HTTP headers state, and ``sound``
    says whether lengths agree and, for a response, whether its payload has the stated digest.
    """
    blank = CRLF * 2
    text = F.col("record").cast("string")
    at = records.withColumn("_head", F.left(text, F.instr(text, blank) + 3))
    field = lambda name: F.regexp_extract("_head", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    number = lambda c: c.try_cast("long")
    at = at.withColumns({"_at": F.octet_length("_head"), "_length": F.coalesce(number(field("Content-Length")), F.lit(-1))})
    at = at.withColumn("_block", F.substring(F.col("record"), F.col("_at") + 1, F.greatest(F.col("_length"), F.lit(0)).cast("int")))
    http = F.col("_block").cast("string")
    at = at.withColumn("_http", F.left(http, F.instr(http, blank) + 3))
    target = field("WARC-Target-URI")
    url = F.when(F.contains(F.col("_head"), F.lit("X-Page-URL-Hex: ")), F.unhex(field("X-Page-URL-Hex")).cast("string")).when(~target.startswith("urn:x-page:"), target)
    at = at.withColumns({
        "record_type": field("WARC-Type"), "record_id": field("WARC-Record-ID"), "page_id": number(field("X-Page-ID")), "url": url, "payload_digest": F.substring_index(field("WARC-Payload-Digest"), "sha256:", -1),
        "refers_to_id": F.nullif(field("WARC-Refers-To"), F.lit("")), "refers_to": number(field("X-Refers-To-Page-ID")),
        "payload_bytes": number(F.regexp_extract("_http", r"\r\nContent-Length: ([0-9]+)\r\n", 1)),
        "payload": F.substring(F.col("_block"), F.octet_length("_http") + 1, F.lit(2**31 - 1)),
    })
    own = F.octet_length("payload") == F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    ends = (F.octet_length("record") == F.col("_at") + F.col("_length") + 4) & (F.substring(F.col("record"), F.col("_at") + F.col("_length") + 1, 4) == F.lit(blank.encode()))
    alike = (F.col("record_type") == "revisit") | (F.sha2("payload", 256) == F.col("payload_digest"))
    sound = F.col("_head").startswith("WARC/1.1" + CRLF) & ends & own & alike
    return at.withColumn("sound", F.coalesce(sound, F.lit(False))).drop("_head", "_at", "_length", "_block", "_http")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: its fields, its bytes ``record``, the full ``payload`` and ``verified``.

    Revisits come with the payload that they refer to, by digest and record id. ``verified`` is false for a record that
    isn't sound, and for a revisit whose response is missing, altered or another one.
    """
    rows = parsed(whole_records(spark, path)).withColumnRenamed("digest", "stored_as")
    keep = ["page_id", "url", "record_type", "record_id", "refers_to", "payload_bytes", "payload_digest", "record"]
    good = F.col("sound") & (F.col("stored_as") == F.col("payload_digest"))
    responses = rows.where("record_type <> 'revisit'").select(*keep, "payload", good.alias("verified"))
    held = rows.where("owns").select(F.col("payload_digest").alias("_d"), F.col("record_id").alias("_id"), F.col("payload").alias("_payload"), F.col("payload_bytes").alias("_bytes"), good.alias("_good"))
    back = rows.where("record_type = 'revisit'").drop("payload").join(held, F.col("payload_digest") == F.col("_d"), "left")
    right = good & F.col("_good") & (F.col("_id") == F.col("refers_to_id")) & (F.col("_bytes") == F.col("payload_bytes"))
    return responses.unionByName(back.select(*keep, F.col("_payload").alias("payload"), F.coalesce(right, F.lit(False)).alias("verified")))


def demanded(column: str) -> Column:
    """``column`` of a verified record; a record that isn't verified ends the query with an error."""
    return F.when(F.col("verified"), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("altered WARC record "), F.col("record_id"))))
