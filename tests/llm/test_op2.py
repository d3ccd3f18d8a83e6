import base64
import gzip
import hashlib
import io

from pyspark.sql import functions as F

from tricklake.llm import warc as W


def brute(rows):
    groups = {}
    for p, _, h in rows:
        groups.setdefault(h or "", []).append(p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        ids = [x for x in groups[h or ""] if x is not None]
        top = max(ids) if ids else None
        revisit = len(groups[h or ""]) > 1 and top is not None and p != top
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def test_pages_round_trip(spark, tmp_path):
    import random

    r = random.Random(1)
    rows = [(1, "http://a b", "<p>x</p>"), (9, None, "<p>x</p>"), (4, "u", None), (5, "u", ""), (6, "u", "long " * 40000), (None, "n", "<p>x</p>"), (None, "n", "alone"), (7, "u", "dup"), (7, "u", "dup"), (3, "u", "dup")]
    rows += [(100 + i, "u", "".join(chr(r.randrange(32, 1000)) for _ in range(r.randrange(3000)))) for i in range(60)]
    df = spark.createDataFrame([(*x, "h") for x in rows], "page_id long, url string, html string, headers string")
    manifest = W.written(W.write_warc(df, f"file://{tmp_path}/w"), "m")
    for split in (100, 5000, 1 << 24):
        got = W.read_warc(manifest, split)
        h = F.col("headers")
        got = got.select(h["X-Page-ID"].cast("long"), F.coalesce(h["X-Payload-Length"].cast("long"), F.length("payload").cast("long")), F.substring(h["WARC-Payload-Digest"], 6, 32), "warc_type", h["X-Refers-To-Page"].cast("long"), "digest_ok").collect()
        assert sorted((tuple(x[:5]) for x in got), key=str) == brute(rows)
        assert all(x[5] is not False for x in got)
    listed = W.list_archives(spark, f"file://{tmp_path}/w/*")
    assert W.read_warc(listed).count() == len(rows)


def test_foreign_bytes_and_empty_archives():
    rec = W._record("response", 1, "u", b"\x1f\x8b\x08 inner magic" * 50, "A" * 32, None)
    data = b"junk\x1f\x8b\x08junk" + rec + gzip.compress(b"no record") + rec
    assert [x[0] for x in W.records_in(io.BytesIO(data), 0, len(data))] == [11, len(data) - len(rec)]
    assert list(W.records_in(io.BytesIO(data), 12, len(data) - len(rec))) == []
    assert list(W.records_in(io.BytesIO(b""), 0, 0)) == []


def test_damaged_records_are_told(spark, tmp_path):
    whole = W._record("response", 1, "u", b"some payload", "A" * 32, None)
    short = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nbody\r\n\r\n")
    long = W._record("response", 2, "u", bytes(range(256)) * 200, "A" * 32, None)
    (tmp_path / "a.warc.gz").write_bytes(whole + short + whole + long[:-30])
    for split in (20, 1 << 20):
        got = W.read_warc(W.list_archives(spark, f"file://{tmp_path}/*"), split).orderBy("offset").collect()
        assert [(r.warc_type, r.payload is None, r.digest_ok) for r in got] == [("response", False, False), ("response", True, False), ("response", False, False), ("response", True, False)]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = W.written(W.write_warc(df, f"file://{tmp_path}/w"), "m")
    assert manifest.count() == 0 and W.read_warc(manifest).count() == 0


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in W.op2_warc(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(rows)
