import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tricklake.llm import topk_search as S


def brute(rows, k):
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints[i] = [math.floor(1024 * x) for x in v]
    out = []
    for q in ints:
        if q % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def check(spark, rows, k=10):
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, v int")
    got = S.top_k(S.integer_vectors(df), F.col("vec_id") % 100 == 0, k).collect()
    assert sorted(map(tuple, got)) == brute([tuple(r) for r in df.select("vec_id", "embedding").collect()], k)


def test_odd_rows_and_ties(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 40)
    monkeypatch.setattr(S, "STRIPE_ROWS", 130)
    monkeypatch.setattr(S, "QUERY_ROWS", 2)
    r = np.random.default_rng(1)
    rows = [(i * 10, r.normal(size=8).tolist()) for i in range(200)]
    rows += [(i * 10 + 1, [0.5] * 8) for i in range(100)] + [(3, None), (None, [1.0] * 8), (100000, [0.0] * 8), (5, [None] * 8), (7, [float("nan")] + [0.0] * 7), (200, [float("inf")] * 8), (11, []), (12, [0.25])]
    rows = [x for x in rows if x[0] != 200 or x[1][0] == float("inf")]
    check(spark, rows)
    check(spark, rows[:3])
    check(spark, [])


def best(rows, q, k, without=None):
    full = rows @ q
    order = [i for i in np.lexsort((np.arange(len(rows)), -full)) if i != without][:k]
    return order, full[order].tolist()


def test_lists_stop_early():
    r = np.random.default_rng(2)
    rows = np.floor(r.normal(size=(5000, 3)) * 1000).astype(np.int64)
    lists, q = S.SortedLists(np.arange(5000), rows), np.array([3, -7, 2])
    ids, scores, share = lists.top(q, 10)
    assert (ids.tolist(), scores.tolist()) == best(rows, q, 10) and share < 0.7
    # a bar that other blocks have set closes rows earlier, and all of them if it is out of reach
    order, full = best(rows, q, 10, without=7)
    ids, scores, less = lists.top(q, 10, full[-1], without=7)
    assert (ids.tolist(), scores.tolist()) == (order, full) and less <= share
    ids, _, least = lists.top(q, 10, full[0] + 1)
    assert not len(ids) and least <= less


def test_stops_only_when_no_other_row_can_qualify():
    r = np.random.default_rng(3)
    for width, k in ((1, 3), (2, 1), (6, 10), (24, 5)):
        rows = np.floor(r.normal(size=(700, width)) * 20).astype(np.int64)  # many ties
        lists = S.SortedLists(np.arange(700), rows)
        for _ in range(20):
            q = np.floor(r.normal(size=width) * 20).astype(np.int64)
            ids, scores, share = lists.top(q, k)
            assert (ids.tolist(), scores.tolist()) == best(rows, q, k) and 0 <= share <= 1
            bar = scores[-1]
            ids, scores, _ = lists.top(q, k, bar)
            assert (ids.tolist(), scores.tolist()) == best(rows, q, k)


def test_oracle(spark):
    con = duckdb.connect()
    con.sql("create view embeddings as select * from read_parquet('/root/testdata/sf0.01/embeddings.parquet')")
    assert sorted(con.sql(S.ORACLE).fetchall()) == sorted(map(tuple, S.op1_topk_search(spark, "/root/testdata/sf0.01").collect()))
