"""WARC archives: writing captures, reading records, assembling transactions.

Writing gives each page three records: the request, the response (or a revisit
of an equal payload), and a metadata record that bears the page's id.  Request
and metadata name the response in ``WARC-Concurrent-To``.  The archives are
written by Spark's text writer with the records' own end as line separator, so
they land, gzipped, wherever Spark can write.

Reading takes whole files (each bounded when written) and parses records by
their lengths.  Assembly joins the records through the concurrent-to ids and
gives one nested row per capture.  Requests and metadata are first reduced to
one row per id they name, so records that name one id too often can't multiply
rows or fill a task.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.llm.common import small
from partwise.session import cut, remove_at_end, shared_dir

# Fixed values of the format.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

#: Payloads shorter than this are always stored.
LEAST_REVISIT = 1_000
#: Parts over which rows of one digest are dealt.
SPREAD = 16
#: Bytes in an archive file before compression, at most, unless a single capture has more.
FILE_BYTES = 128 << 20
#: Pages up to this size are written together; larger ones apart, in files of fewer.
SMALL_PAGE = 64 << 10
DATE = "2024-01-01T00:00:00Z"


def payload(html: str = "html") -> Column:
    """The page's bytes; null is empty."""
    return F.coalesce(F.col(html), F.lit("")).cast("binary")


def mark() -> Column:
    """Tells records of one page id apart by their content."""
    return F.lower(F.hex(F.xxhash64("url", "html")))


def revisited(pages: DataFrame) -> DataFrame:
    """``(digest, first, first_id)`` of payloads that more than one page id has: the largest page id, and the id of its record, the response."""
    keys = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= LEAST_REVISIT).select(F.sha1(payload()).alias("digest"), "page_id", mark().alias("mark"))
    named = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "mark"))).alias("top")
    ids = keys.groupBy("digest").agg(named, F.max("page_id").alias("first"), F.min("page_id").alias("last"), F.count("page_id").alias("n"), F.count("*").alias("m"))
    return ids.where("first <> last or n <> m").where("first is not null").select("digest", "first", F.concat(F.lit("urn:page:"), F.col("first").cast("string"), F.lit(":"), "top.mark").alias("first_id"))


def decided(pages: DataFrame) -> DataFrame:
    """``(row_id, row_mark, first, first_id)`` of the rows, known by page id and mark, whose payload other ids have: digests and ids are joined, no body.

    Rows of one digest are dealt over ``SPREAD`` parts, to each of which the digest's one decision goes.
    """
    rows = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= LEAST_REVISIT).select(F.sha1(payload()).alias("digest"), F.col("page_id").alias("row_id"), mark().alias("row_mark"))
    parts = revisited(pages).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row_id", "row_mark"), F.lit(SPREAD)).cast("int"))
    return dealt.join(parts, ["digest", "part"]).select("row_id", "row_mark", "first", "first_id").distinct()


def records(pages: DataFrame, decisions: DataFrame) -> DataFrame:
    """One column ``value``: the text of each record, without its end.

    Rows that repeat an id and payload are all responses, or all revisits of one
    larger id.  A null id counts as the least, and its metadata names no page.
    Decisions meet pages by id and mark, so pages of one payload don't gather.
    """
    body = F.coalesce("html", F.lit(""))
    page = pages.select(
        "page_id",
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"),
        body.alias("body"),
        F.octet_length(body).alias("size"),
        F.sha1(payload()).alias("sha"),
        mark().alias("mark"),
    ).join(decisions, F.col("page_id").eqNullSafe(F.col("row_id")) & (F.col("mark") == F.col("row_mark")), "left")
    old = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))) & (F.col("size") >= LEAST_REVISIT)
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    page = page.withColumn("old", old).withColumn("id", F.concat(F.lit("urn:page:"), name, F.lit(":"), "mark"))
    target = F.concat(F.lit("\r\nWARC-Target-URI: "), "url", F.lit(f"\r\nWARC-Date: {DATE}"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    visit = F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <"), F.col("first_id"), F.lit(">"))

    def record(kind: Column | str, own: Column, extra: Column, block: Column, content: str) -> Column:
        return F.concat(
            F.lit("WARC/1.0\r\nWARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind), F.lit("\r\nWARC-Record-ID: <"), own, F.lit(">"), target, extra,
            F.lit(f"\r\nContent-Type: {content}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
        )

    beside = F.concat(F.lit("\r\nWARC-Concurrent-To: <"), "id", F.lit(">"))
    digest = F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), "sha")
    capture = record(
        F.when(F.col("old"), "revisit").otherwise("response"),
        F.col("id"),
        F.concat(digest, F.when(F.col("old"), visit).otherwise("")),
        F.when(F.col("old"), http).otherwise(F.concat(http, "body")),
        "application/http;msgtype=response",
    )
    asked = F.concat(F.lit("GET "), "url", F.lit(f" HTTP/1.1\r\nAccept: text/html{END}"))
    request = record("request", F.concat("id", F.lit(":request")), beside, asked, "application/http;msgtype=request")
    fields = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    metadata = record("metadata", F.concat("id", F.lit(":metadata")), beside, fields, "application/warc-fields")
    return page.select(F.explode(F.array(request, capture, metadata)).alias("value"))


def write(pages: DataFrame, folder: str) -> None:
    """Write the pages' records as gzipped archives into a new folder.

    Spark bounds files by rows; small pages go by so many rows that their bytes are bounded, and larger
    ones, if there are any, by so many as the largest allows.
    """
    pages = pages.select("page_id", "url", "html")
    decisions = small(cut(decided(pages)))
    size = F.octet_length(F.coalesce("html", F.lit(""))) + F.octet_length(F.coalesce("url", F.lit(""))) * 4
    largest = pages.agg(F.max(size)).first()[0] or 0
    for name, part, most in (("small", size <= SMALL_PAGE, SMALL_PAGE), ("large", size > SMALL_PAGE, largest)):
        if most >= SMALL_PAGE and (name == "small" or largest > SMALL_PAGE):
            rows = 3 * max(1, FILE_BYTES // (most + 4096))
            records(pages.where(part), decisions).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", rows).text(f"{folder}/{name}")


def parsed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, with names in lower case, and block of each record.  A cut-off record raises ``ValueError``."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut off")
        yield headers, block


RECORD = "type string, record_id string, target_uri string, concurrent_to string, refers_to string, payload_digest string, http_length long, head string, payload binary"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the archives in a folder: ids without angle brackets, HTTP head and payload apart.

    For records that aren't HTTP responses the whole block is ``head``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, pa.string()) for n in ("type", "record_id", "target_uri", "concurrent_to", "refers_to", "payload_digest")] + [("http_length", pa.int64()), ("head", pa.string()), ("payload", pa.binary())]
        )
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(memoryview(content.as_buffer()))
                rows, held = [], 0
                for headers, block in parsed(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)):
                    row = record_row(headers, block)
                    rows.append(row)
                    held += len(block)
                    if held > 4 << 20 or len(rows) >= 4_096:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(folder).select("content")
    return files.mapInArrow(run, RECORD)


def record_row(headers: dict[str, str], block: bytes) -> tuple:
    """One record as a row of ``RECORD``."""
    bare = lambda k: headers[k].strip("<>") if k in headers else None
    kind = headers.get("warc-type")
    length = body = None
    head = block
    if kind in ("response", "revisit") and block.startswith(b"HTTP/"):
        head, _, rest = block.partition(b"\r\n\r\n")
        body = rest if kind == "response" else None
        for line in head.split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            if key.strip().lower() == b"content-length" and value.strip().isdigit():
                length = int(value)
    digest = headers.get("warc-payload-digest")
    return kind, bare("warc-record-id"), headers.get("warc-target-uri"), bare("warc-concurrent-to"), bare("warc-refers-to"), digest, length, head.decode("utf-8", "replace"), body


def assemble(rows: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture`` (the response's or revisit's columns), ``request``, ``metadata`` (null if there is none).

    Of several requests or metadata records that name a capture the one with the
    least id counts.  Requests and metadata that name no known capture, or
    nothing, are no captures and are left out.  Captures that repeat an id are
    rows of their own.
    """
    notes = rows.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    note = F.struct("record_id", "target_uri", "head")
    notes = notes.groupBy(F.col("concurrent_to").alias("of")).agg(
        F.min(F.when(F.col("type") == "request", note)).alias("request"), F.min(F.when(F.col("type") == "metadata", note)).alias("metadata")
    )
    captures = rows.where(F.col("type").isin("response", "revisit"))
    capture = F.struct(*[c for c in rows.columns if c != "concurrent_to"]).alias("capture")
    return captures.select(capture, F.col("record_id").alias("own")).join(notes, F.col("own") == F.col("of"), "left").select("capture", "request", "metadata")


def transactions(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages' archives (into the shared folder, if none is named, until the application ends), read them back and assemble them.

    Null and empty payloads are stored as such, null urls as empty; pages of any size; an empty table gives an
    empty result; other columns are ignored whatever their names.
    """
    spark = pages.sparkSession
    at = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, at)
    if folder is None:
        remove_at_end(spark, at)
    return assemble(read(spark, at))


def digests(nested: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each capture.

    Size and digest of a response are computed from the payload that was read;
    a revisit's are those that its record states.
    """
    c, old = F.col("capture"), F.col("capture.type") == "revisit"
    page = F.nullif(F.regexp_extract("metadata.head", r"page-id: (-?\d+)", 1), F.lit("")).cast("long")
    return nested.select(
        page.alias("page_id"),
        F.when(old, c["http_length"]).otherwise(F.octet_length(c["payload"])).cast("long").alias("payload_bytes"),
        F.when(old, F.substring_index(c["payload_digest"], ":", -1)).otherwise(F.sha1(c["payload"])).alias("payload_digest"),
        c["type"].alias("record_type"),
        F.when(old, F.nullif(F.regexp_extract(c["refers_to"], r"^urn:page:(-?\d+):", 1), F.lit("")).cast("long")).alias("refers_to"),
    )


#: The query in DuckDB: payloads are compared whole.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest, max(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM q
"""
