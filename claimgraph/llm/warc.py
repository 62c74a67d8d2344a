"""WARC archives: writing transactions, and assembling them again from the archives.

Each page is a capture of three records: a response (or, for a payload stored before, a revisit without the payload),
a request and a metadata record, the latter two joined to the first by WARC-Concurrent-To. Archives are written by
Spark's text writer and read by its text reader with the version line as the separator, so files can be split and no
task holds more than a record. A payload that itself holds the version line is stored as chunked HTTP, the chunks
ending inside that line, so that it separates records only.

Equal payloads of at least `least` bytes are stored once, as the response of the largest page id (and, among rows of that
id, of the largest url, to which revisits refer). Defined results: every row of the table is a capture; record ids follow from
the page id, the url, the payload and the number of an occurrence, so repeated rows (equal id, url and html) are told
apart; null html is an empty payload, a null url an empty target; line breaks in a url are percent-encoded; rows without an id
are responses; an empty table gives no records; other columns are not read; records without a partner give a capture
with nulls in its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.llm.common import checkpoint, shared_path

VERSION = "WARC/1.1"
SEPARATOR = f"{VERSION}\r\n"
LEAST = 1000
#: A table of revisits of at most so many rows (about 100 bytes each) is broadcast; a larger one is joined by key.
BROADCAST_REVISITS = 200_000


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: Column, record_id: Column, url: Column, fields: list[tuple[str, Column]], content_type: str, body: Column, date: str) -> Column:
    """A record's text, without the line feed that the text writer appends."""
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), url)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]  # concat is null, and concat_ws leaves it out, where the value is null
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), body, F.lit("\r\n\r"))


def _http(payload: Column) -> Column:
    """An HTTP response; chunked where the payload holds the version line."""
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n")
    plain = F.concat(head, F.lit("Content-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload)
    cut = len("WARC/")
    pieces = F.split(payload, VERSION.replace(".", r"\."), -1)
    last = F.size(pieces) - 1
    chunk = F.transform(pieces, lambda p, i: F.concat(F.when(i > 0, F.lit(VERSION[cut:])).otherwise(F.lit("")), p, F.when(i < last, F.lit(VERSION[:cut])).otherwise(F.lit(""))))
    chunks = F.transform(F.filter(chunk, lambda c: c != ""), lambda c: F.concat(F.lower(F.hex(F.octet_length(c))), F.lit("\r\n"), c, F.lit("\r\n")))
    chunked = F.concat(head, F.lit("Transfer-Encoding: chunked\r\n\r\n"), F.array_join(chunks, ""), F.lit("0\r\n\r\n"))
    return F.when(F.contains(payload, F.lit(VERSION)), chunked).otherwise(plain)


def _dechunk(body: Column) -> Column:
    """The payload of a chunked body: each size line is followed by so many bytes."""
    raw = body.cast("binary")
    start = F.struct(raw.alias("rest"), F.array().cast("array<binary>").alias("parts"))

    def step(s: Column, _: Column) -> Column:
        line = F.split_part(s["rest"].cast("string"), F.lit("\r\n"), F.lit(1))
        size = F.conv(line, 16, 10).cast("int")
        at = F.octet_length(line) + 3
        left = F.octet_length(s["rest"])
        return F.struct(F.substring(s["rest"], at + size + 2, left).alias("rest"), F.when(size > 0, F.array_append(s["parts"], F.substring(s["rest"], at, size))).otherwise(s["parts"]).alias("parts"))

    lines = F.sequence(F.lit(1), F.size(F.split(body, "\r\n[0-9a-f]+\r\n", -1)))
    return F.aggregate(lines, start, step, lambda s: F.array_join(F.transform(s["parts"], lambda p: p.cast("string")), ""))


def revisits(payloads: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, digest, refers_to, target_url) of each row of (id, url, digest, n_bytes) whose payload a row of larger id has
    as well."""
    large = payloads.where((F.col("n_bytes") >= least) & F.col("id").isNotNull())
    kept = large.groupBy("digest", "n_bytes").agg(F.max(F.struct("id", "url")).alias("top"), F.min("id").alias("low")).where("low < top.id")
    return large.join(kept, ["digest", "n_bytes"]).where("id < top.id").select("id", "digest", F.col("top.id").alias("refers_to"), F.col("top.url").alias("target_url")).distinct()


def _numbered(rows: DataFrame, slim: DataFrame) -> DataFrame:
    """rows (id, url, html, digest) with `occurrence`, from 1 for rows that are all alike. Only repeated rows move, and those
    as one row and its count."""
    again = checkpoint(slim.groupBy("id", "url", "digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select(F.col("id").alias("__id"), F.col("url").alias("__url"), F.col("digest").alias("__digest"), "copies"))
    n = again.count()
    if not n:
        return rows.withColumn("occurrence", F.lit(1))
    again = F.broadcast(again) if n <= BROADCAST_REVISITS else again
    flagged = rows.join(again, F.col("id").eqNullSafe(F.col("__id")) & (F.col("url") == F.col("__url")) & (F.col("digest") == F.col("__digest")), "left").drop("__id", "__url", "__digest")
    alike = flagged.where("copies IS NOT NULL").groupBy("id", "url", "digest").agg(F.first("html").alias("html"), F.max("copies").alias("copies"))
    alike = alike.select("id", "url", "html", "digest", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("occurrence"))
    return flagged.where("copies IS NULL").select("id", "url", "html", "digest", F.lit(1).alias("occurrence")).unionByName(alike)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write three records per page below `path`."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    url = F.replace(F.replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), html.alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    slim = checkpoint(rows.select("id", "url", "digest", F.octet_length("html").alias("n_bytes")))
    again = checkpoint(revisits(slim, least)).select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "refers_to", "target_url")
    if again.count() <= BROADCAST_REVISITS:
        again = F.broadcast(again)
    rows = _numbered(rows, slim).join(again, (F.col("id") == F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    said = F.coalesce(F.col("id").cast("string"), F.lit(""))
    own = (said, F.col("url"), F.col("digest"), F.col("occurrence").cast("string"))
    main_id = _urn(F.lit("main"), *own)
    earlier = F.when(F.col("refers_to").isNotNull(), _urn(F.lit("main"), F.col("refers_to").cast("string"), F.col("target_url"), F.col("digest"), F.lit("1")))
    kind = F.when(earlier.isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    body = F.when(earlier.isNull(), _http(F.col("html"))).otherwise(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"))
    profile = F.when(earlier.isNotNull(), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    main = _record(kind, main_id, F.col("url"), [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Profile", profile), ("WARC-Refers-To", earlier)], "application/http;msgtype=response", body, date)
    joined = [("WARC-Concurrent-To", main_id)]
    request = _record(F.lit("request"), _urn(F.lit("request"), *own), F.col("url"), joined, "application/http;msgtype=request", F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n")), date)
    metadata = _record(F.lit("metadata"), _urn(F.lit("metadata"), *own), F.col("url"), joined, "application/warc-fields", F.concat(F.lit("pageId: "), said, F.lit("\r\n")), date)
    rows.select(F.explode(F.array(main, request, metadata)).alias("value")).write.text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(type, record_id, url, concurrent_to, refers_to, digest, complete, body) of every record below `path`."""
    text = spark.read.option("lineSep", SEPARATOR).text(path).where(F.col("value") != "")
    head = F.substring_index("value", "\r\n\r\n", 1)
    parts = text.select(head.alias("head"), F.col("value"))
    body = F.substring(F.col("value"), F.length("head") + 5, F.length("value") - F.length("head") - 8)
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))
    return parts.select(
        field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("record_id"), F.coalesce(field("WARC-Target-URI"), F.lit("")).alias("url"), field("WARC-Concurrent-To").alias("concurrent_to"), field("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"), (F.octet_length("value") - F.octet_length("head") - 8 == field("Content-Length").cast("long")).alias("complete"), body.alias("body"),
    )


def payload(body: Column) -> Column:
    """What an HTTP response carries."""
    head = F.substring_index(body, "\r\n\r\n", 1)
    rest = F.substring(body, F.length(head) + 5, F.length(body))
    return F.when(F.contains(head, F.lit("Transfer-Encoding: chunked")), _dechunk(rest)).otherwise(rest)


def assemble(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """One nested row per capture: its response or revisit with the payload's measures, its request, its metadata."""
    capture = F.coalesce("concurrent_to", "record_id")
    held = F.col("type") == "response"
    text = payload(F.col("body"))
    measured = records.select(
        capture.alias("capture_id"), "type", "url", "refers_to", "digest", "complete",
        F.when(held, F.sha1(text.cast("binary"))).alias("found_digest"), F.when(held, F.octet_length(text)).alias("n_bytes"), *([F.when(held, text).alias("payload")] if with_payload else []),
        F.when(~F.col("type").isin("response", "revisit"), F.col("body")).alias("body"),
    )
    own = F.col("type").isin("response", "revisit")
    names = ["type", "url", "refers_to", "digest", "complete", "found_digest", "n_bytes", *(["payload"] if with_payload else [])]
    main = measured.where(own).select("capture_id", F.struct(*names).alias("response"))
    side = measured.where(~own).groupBy("capture_id").agg(F.max(F.when(F.col("type") == "request", F.col("body"))).alias("request"), F.max(F.when(F.col("type") == "metadata", F.col("body"))).alias("metadata"))
    return main.join(side, "capture_id", "full")


def op7(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The digest columns of the archive contract."""
    path = shared_path(spark, "warc")
    write(pages, path)
    found = assemble(read_records(spark, path), with_payload=False)
    page_id = F.nullif(F.regexp_extract("metadata", r"pageId: ([^\r\n]*)", 1), F.lit("")).cast("long")
    rows = checkpoint(found.select("capture_id", page_id.alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("target"), F.col("response.found_digest").alias("payload_digest"), F.col("response.n_bytes").cast("long").alias("payload_bytes"), (F.col("response.complete") & F.coalesce(F.col("response.digest") == F.col("response.found_digest"), F.lit(True))).alias("verified")))
    held = rows.where("record_type = 'response'").select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"))
    return rows.join(held, "target", "left").select("page_id", F.coalesce("payload_bytes", "b").alias("payload_bytes"), F.coalesce("payload_digest", "d").alias("payload_digest"), "record_type", "refers_to", "verified")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM m)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to, TRUE AS verified
FROM k
"""
