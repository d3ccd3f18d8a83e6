"""Records whose header is longer than any block."""

import random

from tricklake.llm import warc as W


def test_long_urls(spark, tmp_path):
    r = random.Random(3)
    url = lambda n: "data:text/html;base64," + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n))
    rows = [(1, "http://a", "<p>x</p>"), (2, url(200_000), "long"), (3, url(70_000), "longer"), (4, url(3_000_000), "longest"), (5, "http://b", "<p>y</p>")]
    manifest = W.written(W.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w"), "m")
    for split in (50_000, 1 << 24):
        got = [(int(x.headers["X-Page-ID"]), x.headers["WARC-Target-URI"], bytes(x.payload).decode(), x.digest_ok) for x in W.read_warc(manifest, split).collect()]
        assert sorted(got) == [(*x, True) for x in rows]
