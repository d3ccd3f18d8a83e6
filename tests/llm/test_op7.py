import hashlib
import random

import numpy as np

from tricklake.llm import order_minhash as O
from tricklake.llm.common import run_hashes


def plain(text):
    """The same signature: occurrences counted in a dictionary, k-mer by k-mer, selected by sorting."""
    if not text:
        return np.zeros(O.M, np.uint32)
    k = min(O.K, len(text))
    codes = np.array([ord(c) for c in text], np.uint64)
    base = run_hashes(codes, k, 11) if k > 1 else codes + np.uint64(1)
    seen, h = {}, []
    for i, x in enumerate(base.tolist()):
        mer = text[i : i + k]
        n = seen.get(mer, 0)
        seen[mer] = n + 1
        x ^= n * 0x9E3779B97F4A7C15 % 2**64
        x ^= x >> 31
        h.append(x * 0xD6E8FEB86659FD93 % 2**64)
    a, out = np.array(h, np.uint64), []
    for m in O._MULS:
        v = (a * m) >> np.uint64(32)
        x = 0x51ED270B
        for i in sorted(np.lexsort((np.arange(len(h)), v))[: O.L].tolist()):
            x = ((x ^ h[i]) * 0x9E3779B97F4A7C15) % 2**64
            x ^= x >> 29
        out.append(x >> 32)
    return np.array(out, np.uint32)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    show = lambda s: "".join(f"{x:08x}" for x in s.tolist())
    out = []
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        keep = len(t) - len(t) // 4
        e = "".join([*list(t)[:keep], *list(nxt)[: len(t) - keep]])
        s, se, sn = plain(t), plain(e), plain(nxt)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), show(s), show(se), float((s == se).mean()), float((s == sn).mean())))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id long, text string, bucket string")
    return sorted((tuple(r) for r in O.fingerprints(df).collect()), key=str)


def test_rows_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i * 3, "".join(r.choice("ab cdé𝄞") for _ in range(r.randint(0, 60)))) for i in range(70)]
    rows += [(6, "abc"), (6, "abc"), (500, None), (501, ""), (502, "x"), (None, "null id"), (None, None), (2**60, "y" * 3000)]
    assert got(spark, rows) == brute(rows)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in O.op7_order_minhash(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(rows)


def test_single_and_none(spark):
    assert got(spark, [(1, "some text here")]) == brute([(1, "some text here")])
    assert got(spark, []) == []


def test_order_matters():
    words = [f"word{i}" for i in range(200)]
    a, b = " ".join(words), " ".join(words[100:] + words[:100])
    c = a.replace("word57", "other")
    s = O.signature(a)
    assert O.likeness(s, O.signature(c)) > 0.7 > O.likeness(s, O.signature(b))
    assert O.likeness(s, O.signature("nothing like it at all " * 20)) < 0.1
