import hashlib
import re

from tricklake.llm import substring_dedup as D
from tricklake.llm.substring_dedup import substring_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, window):
    texts = [(d, WORD.findall((t or "").encode())) for d, t in rows]
    first = {}
    for d, w in texts:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in texts:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                keep[i : i + window] = [False] * window
        kept = b" ".join(x for x, k in zip(w, keep) if k)
        out.append((d, len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, window, shingle, batches):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_words string")
    got = [tuple(r) for r in substring_dedup(df, window, shingle, batches)[0].collect()]
    assert sorted(got, key=str) == brute(rows, window)


def test_small_and_odd_rows(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [
        (5, " ".join(base)), (3, " ".join(base[10:30]) + " tail words here"), (9, "x " + " ".join(base[:25]) + " y\tz"),
        (9, " ".join(base)), (11, None), (12, ""), (None, " ".join(base)), (13, "a " * 60), (14, "a " * 30), (15, "long" * 5000),
    ]
    for batches in (1, 2, 5):
        check(spark, rows, 8, 3, batches)


def test_compaction_and_thinning(spark, monkeypatch):
    """Ten batches over an index of two runs, and a passage in so many documents that its fingerprints count as hot."""
    made = []
    merge = D.FingerprintIndex.merge
    monkeypatch.setattr(D.FingerprintIndex, "merge", lambda self, batch: (merge(self, batch), made.append((len(self.runs), self.compactions)))[0])
    settle = D.repeated_spans
    monkeypatch.setattr(D, "repeated_spans", lambda *a: settle(*a, hot_rows=3))
    thinned = []
    keep = D.written
    monkeypatch.setattr(D, "written", lambda df, name: (thinned.append(name), keep(df, name))[1])
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, f"own{i} a{i % 7} b{i % 5} c{i % 3} " + passage + f" end{i} z{i % 4}") for i in range(60)] + [(i, " ".join(f"v{(i * 3 + j) % 50}" for j in range(30))) for i in range(60, 90)]
    check(spark, rows, 8, 3, 10)
    assert len(made) == 10 and max(n for n, _ in made) <= 2 and made[-1][1] >= 4
    assert "thinned" in thinned


def test_empty_table(spark):
    check(spark, [], 8, 3, 4)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, 50, 16, 4)
