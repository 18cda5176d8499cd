"""WARC archives: write captures, read them back, assemble transactions.

Format: WARC 1.1 records (ISO 28500) with ``request``, ``response`` or ``revisit`` (profile
identical-payload-digest) and ``metadata`` records per capture. Request and metadata records
name their capture's record in ``WARC-Concurrent-To``. Archives go through Spark's own text
sink and source, so any store Spark can reach will do; a record is one row whose separator is
the blank line that ends a record, and a file is one gzip stream.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, join_hot, shared_dir, staged

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
    "payload_digest string, http_length long, fields map<string,string>, block binary, payload binary, block_bytes long, seen_digest string"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of a SHA-1: five hexadecimal digits make four of base 32."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*cols: Column) -> Column:
    h = F.md5(F.concat_ws("\u0001", *cols))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record(headers: list[Column], block: Column) -> Column:
    """Header lines (null ones are left out), length, blank line and block, as one string."""
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws(CRLF, *headers, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit(CRLF * 2), block)


def archive_records(pages: DataFrame, min_payload_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One row ``record`` for each WARC record of pages (page_id, url, html).

    Of pages whose payloads are equal and have at least min_payload_bytes, the one with the
    smallest page_id is the response and the others revisit it. Null html is an empty payload;
    a null url gives a record without target; a repeated row is a capture of its own, and of rows
    that share the smallest page_id the first written is the response. A null page_id sorts last.
    Payload bytes are shuffled once, by page; the roles are found on digests alone.
    """
    from pyspark.sql import Window

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    pages = pages.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("n", F.octet_length("payload").cast("long"))
    first = pages.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    roles = join_hot(pages.select("page_id", "digest").distinct(), first, "digest").select("digest", F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key"), "first_id")
    keyed = pages.withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    turn = F.row_number().over(Window.partitionBy("key", "digest").orderBy("url"))
    rows = keyed.join(roles, ["key", "digest"]).withColumn("turn", turn)
    is_first = (F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("turn") == 1)) | (F.col("n") < min_payload_bytes)
    rows = rows.withColumn("kind", F.when(is_first, "response").otherwise("revisit"))

    def rid(kind: str, key: Column, turn: Column) -> Column:
        return _uuid(F.lit(kind), key, F.col("digest"), turn.cast("string"))

    capture = rid("capture", F.col("key"), F.col("turn"))
    origin = rid("capture", F.coalesce(F.col("first_id").cast("string"), F.lit("")), F.lit(1))
    uri = F.col("url")
    for bad, good in (("%0D", "\r"), ("%0A", "\n"), ("%20", " "), ("%09", "\t")):
        uri = F.replace(uri, F.lit(good), F.lit(bad))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)  # noqa: E731  null if the value is
    common = [line("WARC-Date", F.lit(date)), line("WARC-Target-URI", uri)]
    digest = line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    revisit = F.col("kind") == "revisit"
    http = F.concat(F.lit(HTTP), F.col("n").cast("string"), F.lit(CRLF * 2))
    main = _record(
        [line("WARC-Type", F.col("kind")), line("WARC-Record-ID", capture), *common, digest, F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")), F.when(revisit, line("WARC-Refers-To", origin)), F.lit("Content-Type: application/http;msgtype=response")],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload").cast("string"))),
    )
    request = _record([F.lit("WARC-Type: request"), line("WARC-Record-ID", rid("request", F.col("key"), F.col("turn"))), line("WARC-Concurrent-To", capture), *common, F.lit("Content-Type: application/http;msgtype=request")], F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    about = _record([F.lit("WARC-Type: metadata"), line("WARC-Record-ID", rid("metadata", F.col("key"), F.col("turn"))), line("WARC-Concurrent-To", capture), *common, F.lit("Content-Type: application/warc-fields")], F.concat(F.lit("page-id: "), F.col("key"), F.lit(CRLF)))
    return rows.select(F.explode(F.array(request, main, about)).alias("record"))


def write_archives(records: DataFrame, path: str) -> None:
    records.select("record").write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def _parse(batches, payloads: bool):
    """Follows record lengths through the lines of each file; a record never leaves its file."""
    rows: list[tuple] = []
    names = [c.split()[0] for c in ("record_id s", "record_type s", "concurrent_to s", "refers_to s", "target_uri s", "payload_digest s", "http_length l", "fields m", "block b", "payload b", "block_bytes l", "seen_digest s")]
    text = pa.string()
    types = [text, text, text, text, text, text, pa.int64(), pa.map_(text, text), pa.binary(), pa.binary(), pa.int64(), text]

    def finish(header: dict, block: bytes) -> None:
        kind, ctype = header.get("warc-type"), header.get("content-type", "")
        fields, payload, length, seen = [], None, None, None
        if ctype.startswith("application/http"):
            head, _, body = block.partition(b"\r\n\r\n")
            fields = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split(CRLF)[1:])]
            length = dict(fields).get("content-length")
            length = int(length) if length and length.isdigit() else None
            if kind == "response":
                payload, seen = body, base64.b32encode(hashlib.sha1(body).digest()).decode()
        elif ctype.startswith("application/warc-fields"):
            fields = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF) if x)]
        digest = header.get("warc-payload-digest", "")
        rows.append((header.get("warc-record-id"), kind, header.get("warc-concurrent-to"), header.get("warc-refers-to"), header.get("warc-target-uri"), digest.removeprefix("sha1:") or None, length, list(dict(fields).items()), block if payloads else None, payload if payloads else None, len(payload) if payload is not None else len(block), seen))

    def out():
        cols = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    at, header, name, need, got, kept = None, None, "", 0, 0, []
    for batch in batches:
        for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if file != at:
                at, header, need, kept = file, None, 0, []
            if need:
                take = min(need, len(line) + 1)
                kept.append((line + b"\n")[:take])
                need -= take
                if not need:
                    finish(header, b"".join(kept))
                    # what stands behind the block in its last line is only the record's blank line
                    header, kept = None, []
                continue
            line = line.rstrip(b"\r")
            if header is None:
                if line.startswith(b"WARC/"):
                    header = {}
            elif line:
                k, _, v = line.decode("utf-8", "replace").partition(":")
                header[k.strip().lower()] = v.strip()
            else:
                need = int(header.get("content-length", "0"))
                if not need:
                    finish(header, b"")
                    header = None
        if len(rows) >= 256 or sum(len(r[8] or b"") for r in rows) > 8 << 20:
            yield out()
    if rows:
        yield out()


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives under path, one row each (RECORD_SCHEMA). Without ``payloads``
    blocks are dropped after their digests are taken, before anything is shuffled. Blocks are
    cut by Content-Length alone, so payloads may hold blank lines or text like a record's start."""
    bounded_batches(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(lambda b: _parse(b, payloads), RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit record, with the request and metadata
    records that are concurrent to it (null where missing). Records that are concurrent to no
    capture are left out; of several requests or metadata records the smallest id counts."""
    capture = F.col("record_type").isin("response", "revisit")
    side = F.col("record_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull()
    parts = F.struct("record_id", "target_uri", "fields", "block", "block_bytes")
    main = F.struct("record_type", "target_uri", "refers_to", "payload_digest", "seen_digest", "http_length", "fields", "payload", "block_bytes")
    pick = lambda kind: F.min_by(F.when(side & (F.col("record_type") == kind), parts), F.when(side & (F.col("record_type") == kind), F.col("record_id"))).alias(kind)
    # an equi-join of the three kinds on the capture's id: one shuffle, whatever is missing
    met = records.where(capture | side).groupBy(F.when(capture, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("record_id"))
    return met.agg(F.first(F.when(capture, main), ignorenulls=True).alias("capture"), pick("request"), pick("metadata")).where("capture is not null")


def op6_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(archive_records(pages, min_payload_bytes=0), path)
    rows = assemble(read_archives(spark, path, payloads=False)).select("record_id", F.expr("try_cast(metadata.fields['page-id'] as bigint)").alias("page_id"), F.col("capture.record_type").alias("record_type"), F.col("capture.refers_to").alias("origin"), F.coalesce("capture.seen_digest", "capture.payload_digest").alias("payload_digest"), F.when(F.col("capture.record_type") == "response", F.col("capture.block_bytes")).otherwise(F.col("capture.http_length")).alias("payload_bytes"))
    rows = staged(rows, "captures")
    origins = rows.where("record_type = 'response'").select(F.col("record_id").alias("origin"), F.col("page_id").alias("refers_to"))
    # responses refer to nothing: they stay out of the join, where null keys would meet in one task
    revisits = join_hot(rows.where("record_type = 'revisit'"), origins, "origin", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return rows.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(revisits.select(columns))


OP6_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
d AS (SELECT page_id, payload_bytes, h, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest FROM p),
f AS (SELECT h, min(page_id) AS first_id FROM d GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d JOIN f USING (h)
"""
