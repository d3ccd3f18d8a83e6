import math
import random
import re
import statistics
import zlib

import pytest

from tricklake.llm import toxicity as T


def naive(seq):
    """All maximal segments by the recursive definition: the best one, then left and right of it."""
    best, at = 0.0, None
    for i in range(len(seq)):
        s = 0.0
        for j in range(i, len(seq)):
            s += seq[j]
            if s > best + 1e-9:
                best, at = s, (i, j + 1)
    if not at:
        return []
    a, b = at
    return naive(seq[:a]) + [(a, b, round(best, 6))] + [(b + x, b + y, s) for x, y, s in naive(seq[b:])]


def test_segments_equal_the_definition():
    r = random.Random(2)
    for _ in range(200):
        seq = [r.choice([-1.13, -0.57, 0.91, 2.03, -0.31]) for _ in range(r.randint(0, 25))]
        got = [(a, b, round(s, 6)) for a, b, s in T.maximal_segments(list(enumerate(seq)), 0.31)]
        assert got == naive(seq)
        sparse = [(i, s) for i, s in enumerate(seq) if s != -0.31]
        assert [(a, b, round(s, 6)) for a, b, s in T.maximal_segments(sparse, 0.31)] == naive(seq)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "bad bad bad", "x"), (3, "bad bad bad", "x"), (None, "fine", "x"), (5, "w " * 100000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1), (5, 0), (5, None), (77, 1)], "doc_id long, toxic int")
    got = T.toxicity(docs, T.fit_model(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    empty = T.fit_model(docs.limit(0), labels.limit(0))
    assert T.toxicity(docs, empty).count() == 6 and T.toxicity(docs.limit(0), empty).collect() == []


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in T.op10_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic").collect()]
    held = [(t, got[d].predicted) for d, t in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    tp = sum(t and p for t, p in held)
    assert tp >= 0.9 * sum(t for t, _ in held) and tp >= 0.85 * sum(p for _, p in held)


def brute_scores(docs, labels, held_out):
    """Scores of docs(id, text) by loops: prior, log-odds, segments by their definition, extreme values, curve."""
    words_of = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower())
    fit = [(words_of(t), labels[d]) for d, t in docs if d in labels and not held_out(d)]

    def odds(units):
        sets = [({u for w in ws for u in units(w)}, y) for ws, y in fit]
        every = {u for s, _ in sets for u in s}
        c = {u: [sum(u in s and y == k for s, y in sets) for k in (0, 1)] for u in every}
        n = [sum(x[k] for x in c.values()) for k in (0, 1)]
        out = {}
        for u, (c0, c1) in c.items():
            a = T.PRIOR * (c0 + c1)
            m = T.PRIOR * sum(n)
            o = math.log((c1 + a) / (n[1] + m - c1 - a)) - math.log((c0 + a) / (n[0] + m - c0 - a))
            z = o / math.sqrt(1 / (c1 + a) + 1 / (c0 + a))
            if abs(z) >= T.LEAST_Z:
                out[u] = (o, z)
        return out

    begin = lambda w: [w[:k] + "*" for k in range(3, 11) if len(w) > k]
    whole = odds(lambda w: [w])
    weights = odds(lambda w: [] if w in whole else begin(w)) | whole

    def weight(w):
        known = [weights[u] for u in [w, *begin(w)] if u in weights]
        return max(known, key=lambda x: abs(x[1]))[0] if known else None

    line = lambda ws: [-T.DRIFT if weight(w) is None else weight(w) for w in ws]
    best = lambda ws: max((s for _, _, s in naive(line(ws))), default=0.0)
    clean = [ws for ws, y in fit if not y]
    p = (sum(weight(w) is not None and weight(w) > 0 for ws in clean for w in ws) + 0.5) / (sum(map(len, clean)) + 1)
    mean = statistics.mean([o for o, _ in weights.values() if o > 0] or [1.0])
    lo, hi = 1e-3, 10.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if p * math.exp(mid * mean) + (1 - p) * math.exp(-mid * T.DRIFT) > 1 else (mid, hi)
    rate = (lo + hi) / 2
    log_k = statistics.mean(rate * best(ws) - math.log(max(len(ws), 1)) for ws in clean) - 0.5772156649015329
    log_e = lambda s, n: (log_k + math.log(max(n, 1)) - rate * s) / math.log(10)

    def features(ws):
        e = [log_e(s, len(ws)) for _, _, s in naive(line(ws))]
        return math.asinh(-min(e, default=log_e(0, len(ws)))), math.log1p(sum(x <= math.log10(T.SIGNIFICANT) for x in e))

    curve = T._logistic(__import__("numpy").array([[1.0, *features(ws)] for ws, _ in fit]), __import__("numpy").array([float(y) for _, y in fit]))
    return {d: 1 / (1 + math.exp(-(curve[0] + curve[1] * x[0] + curve[2] * x[1]))) for d, t in docs for x in [features(words_of(t))]}


def test_scores_against_brute_force(spark, tmp_path):
    r = random.Random(4)
    plain = [f"word{i}" for i in range(40)]
    bad = ["filthy", "filthier", "scumbag", "vile"]
    docs, labels = [], {}
    for d in range(160):
        toxic = d % 5 == 0
        ws = [r.choice(plain) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(2, 5) if toxic else int(r.random() < 0.05)):
            ws.insert(r.randint(0, len(ws)), r.choice(bad))
        docs.append((d, " ".join(ws)))
        if d % 7:
            labels[d] = int(toxic)
    docs.append((900, ""))
    spark.createDataFrame([(d, t, "en", "s") for d, t in docs], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels.items()), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    want = brute_scores(docs, labels, held)
    got = {x.doc_id: x for x in T.op10_toxicity(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and len({round(x, 3) for x in want.values()}) > 5
    for d, x in got.items():
        assert x.score == pytest.approx(want[d], abs=1e-5) and x.held_out == held(d) and x.predicted == int(x.score >= 0.3)


def test_more_evidence_scores_higher():
    """No end beyond which evidence counts alike."""
    m = T.ToxicityModel({"bad": (2.0, 9.0)}, curve=(-9.0, 2.0, 0.0))
    scores = [m.probability(*m.features([b"bad"] * n + [b"x"] * (4000 - n))[1:]) for n in (1, 10, 100, 1000, 4000)]
    assert scores == sorted(set(scores))
