import gzip
import hashlib
import io

import pytest

from quern.llm import warc as W
from quern.llm.entries import op5_warc
from quern.llm.storage import new_path

LONG = "ä" * 600  # 1200 bytes
ROWS = [
    (1, "http://a/x y", LONG), (2, "http://b/", LONG), (3, None, LONG), (4, "http://c/", "short"), (5, "http://d/", "short"), (6, "u", None), (7, "u", ""),
    (8, "http://e/\r\nX: 1", "x" * 3000 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n"), (4, "http://c/", "short"), (9, "ü", "a" * 999), (10, "ü", "a" * 999), (11, "u", "b" * 1000), (12, "u", "b" * 1000),
]


def plain(rows):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body]
        first = max(same) if len(body) >= 1000 else page
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "response" if first == page else "revisit", None if first == page else first))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'z' AS digest", "'z' AS winner")
    pages.select("page_id", "url", "html", "digest", "winner").write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in op5_warc(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == plain(ROWS)


def test_assembly_is_one_nested_row_a_capture(spark):
    path = new_path(spark, "w")
    W.write_warc(spark.createDataFrame(ROWS, "page_id long, url string, html string"), path)
    found = W.read_warc(spark, path)
    assert found.count() == 3 * len(ROWS)
    rows = W.assemble(found).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.request.concurrent_to == r.metadata.concurrent_to == r.main.record_id and r.request.type == "request"
        if r.main.type == "response":
            assert hashlib.sha1(bytes(r.main.payload)).hexdigest() == r.main.payload_digest == r.main.headers["warc-payload-digest"][5:]
    assert {r.main.target_uri for r in rows if r.metadata.payload == b"page_id: 8"} == {"http://e/%20%20X:%201"}
    alone = W.assemble(found.filter("type = 'request'")).collect()
    assert len(alone) == len({r.capture_id for r in alone}) and all(r.main is None for r in alone)


def test_parser():
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    got = list(W.parse(io.BytesIO(record * 2)))
    assert [b for _, b in got] == [b"ab\r\nc"] * 2 and got[0][0]["warc-type"] == "warcinfo"
    assert len(list(W.parse(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(record) + gzip.compress(record)))))) == 2
    with pytest.raises(ValueError, match="cut off"):
        list(W.parse(io.BytesIO(record[:-8])))
    with pytest.raises(ValueError, match="no record"):
        list(W.parse(io.BytesIO(b"junk\n")))


def test_empty_table(spark):
    path = new_path(spark, "w")
    W.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert W.read_warc(spark, path).count() == 0


def test_archives_are_bounded_by_captures_and_bytes(spark):
    sizes = [(n * 37) % 900 + 1 if n % 7 else 3000 + n * 11 for n in range(300)] + [60_000, 60_000]
    rows = [(n, "u", chr(97 + n % 26) * k) for n, k in enumerate(sizes)]
    pages, path = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), new_path(spark, "w")
    W.write_warc(pages, path, captures=10, size=20_000, least_bytes=10**9)
    found = W.read_warc(spark, path)
    assert found.filter("type = 'response'").select("payload_bytes").toPandas()["payload_bytes"].sort_values().tolist() == sorted(sizes)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect()
    for f in files:
        data = gzip.decompress(bytes(f.content))
        n = sum(h["warc-type"] == "response" for h, _ in W.parse(io.BytesIO(data)))
        assert n <= 10 and (len(data) <= 20_000 + 10 or n == 1)
    assert len(files) < 150
