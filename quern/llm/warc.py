"""WARC archives: write captures, read records, assemble transactions.

Writing is all DataFrame functions: a page becomes the text of three records (request; response or
revisit; metadata) which Spark's text writer appends to gzip-compressed archives, so a lost task is
redone and its file committed once. ``WARC-Concurrent-To`` of the request and the metadata names
the response or revisit.

Revisits: of the pages whose payloads are equal (by SHA-1) and at least ``least_bytes`` long, the
one with the largest id is stored and the others refer to it. The winner of a payload is an
aggregate that Spark combines before its shuffle; the join that brings it back can be split where
one payload has a large share of all pages. Of equal ids with one payload all are stored.

Reading: whole archive files go to tasks; a record ends where its Content-Length says, so payloads
may hold anything, header lines included. Assembly groups records by the id of their response or
revisit and emits one nested row per capture.

Defined cases: a null html is an empty payload; an empty payload is stored like any other; a null
url is written as an empty target; white space and control characters of a url are percent-encoded;
rows that repeat a page_id and its payload are separate captures with the same record id, and
assemble to a row each; records that join no response make a row with a null ``main``; an empty
table makes no record; a very long html is one record, in an archive of its own. Columns other than
those named are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_BYTES = 1000
#: Captures in an archive file at most.
CAPTURES_A_FILE = 4_000
#: Bytes of an archive file before compression at most, but for a single capture that is larger; bounds what a reading task holds.
BYTES_A_FILE = 256 << 20
RECORD = "record_id string, type string, target_uri string, concurrent_to string, refers_to string, headers map<string,string>, http_header string, payload_bytes long, payload_digest string, payload binary"


def _id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))))


def _record(kind: Column, record_id: Column, fields: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), record_id)]
    lines += [F.when(v.isNotNull(), F.concat(F.lit(f"\r\n{k}: "), v)).otherwise("") for k, v in fields]
    return F.concat(*lines, F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"))


def classify(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, digest, winner): winner is null for a page whose payload is stored."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("digest"))
    shared = rows.filter(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1").select("digest", "winner")
    found = rows.join(shared, "digest", "left")
    return found.withColumn("winner", F.when(~F.col("winner").eqNullSafe(F.col("page_id")), F.col("winner")))


def records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", **names) -> DataFrame:
    """(value): the archive text of each page, without its last line feed."""
    rows = classify(pages, **names)
    main = _id(F.lit("main"), F.col("page_id"), F.col("digest"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    revisit, when = F.col("winner").isNotNull(), F.lit(date)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    common = [("WARC-Target-URI", uri), ("WARC-Date", when)]
    request = _record(F.lit("request"), _id(F.lit("request"), F.col("page_id"), F.col("digest")), [*common, ("WARC-Concurrent-To", main)], "application/http; msgtype=request", F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\n\r\n")))
    profile = F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    refers = F.when(revisit, _id(F.lit("main"), F.col("winner"), F.col("digest")))
    response = _record(
        F.when(revisit, "revisit").otherwise("response"), main, [*common, ("WARC-Payload-Digest", digest), ("WARC-Profile", profile), ("WARC-Refers-To", refers)],
        "application/http; msgtype=response", F.concat(head, F.when(revisit, "").otherwise(F.col("html"))),
    )
    about = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    metadata = _record(F.lit("metadata"), _id(F.lit("metadata"), F.col("page_id"), F.col("digest")), [*common, ("WARC-Concurrent-To", main)], "application/warc-fields", about)
    whole = F.concat(request, response, metadata)
    return rows.select(F.substring(whole, F.lit(1), F.length(whole) - 1).alias("value"))


def write_warc(pages: DataFrame, path: str, captures: int = CAPTURES_A_FILE, size: int = BYTES_A_FILE, **options) -> None:
    """Write a request, a response or revisit, and a metadata record of each page.

    Files are bounded by captures and bytes. A capture of more than its share, ``size / captures``, goes to
    a folder of its power of two and of its place in the writing task: of so many rows in a row as may
    all be that large, those that are share a file. So no rows are counted first and none move.
    """
    share, length = max(1, size // captures), F.octet_length("value")
    power = F.ceil(F.log2(length.cast("double"))).cast("int")
    rows = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(float(size)) / F.pow(F.lit(2.0), power)).cast("long"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    group = F.when(length <= share, "0").otherwise(F.concat_ws("-", power, F.floor(place / rows).cast("long")))
    dealt = records(pages, **options).withColumn("part", group)
    dealt.write.partitionBy("part").option("maxRecordsPerFile", captures).option("lineSep", "\n").option("compression", "gzip").text(path)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts here: {line[:80]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError(f"record {headers.get('warc-record-id')} is cut off")
        yield headers, block


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of ``RECORD`` for each record of the archives in ``path``; ``payloads=False`` leaves payload null.

    Length and SHA-1 are computed from the bytes read. Of HTTP records the payload is what follows
    the HTTP header.
    """
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.string()] * 5 + [pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                raw = io.BytesIO(data)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == b"\x1f\x8b" else raw
                rows, held = [], 0
                for headers, block in parse(stream):
                    http, payload = None, block
                    if headers.get("content-type", "").startswith("application/http"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        http = head.decode("utf-8", "replace")
                    held += len(payload)
                    rows.append((
                        headers.get("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
                        list(headers.items()), http, len(payload), hashlib.sha1(payload).hexdigest(), payload if payloads or headers.get("warc-type") == "metadata" else None,
                    ))
                    if len(rows) >= 1000 or held > 8_000_000:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(read, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, main, request, metadata), each a record or null."""
    names = [f.name for f in found.schema.fields]
    keyed = found.select(F.coalesce("concurrent_to", "record_id").alias("capture_id"), F.struct(*names).alias("r"))
    grouped = keyed.groupBy("capture_id").agg(F.collect_list("r").alias("all"))

    def of(*kinds: str) -> Column:
        return F.filter("all", lambda r: r["type"].isin(*kinds))

    return grouped.select("capture_id", F.get(of("request"), F.lit(0)).alias("request"), F.get(of("metadata"), F.lit(0)).alias("metadata"), F.explode_outer(of("response", "revisit")).alias("main")).select("capture_id", "main", "request", "metadata")


def resolve(captures: DataFrame) -> DataFrame:
    """``captures`` with ``stored``: the capture of the response that a revisit refers to, else its own."""
    stored = captures.filter("main.type = 'response'").groupBy(F.col("capture_id").alias("stored_id")).agg(F.first(F.struct("main", "metadata")).alias("stored"))
    return captures.join(stored, F.coalesce("main.refers_to", "capture_id") == F.col("stored_id"), "left").drop("stored_id")
