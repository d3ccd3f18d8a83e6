import math
import re
from collections import defaultdict

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from tricklake.llm import curriculum as C


def targets(sizes, weights):
    """Resharing round by round."""
    total, out, open_ = 1.5 * sum(sizes), {}, set(range(len(sizes)))
    while open_:
        left = total - sum(out.values())
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > 2 * sizes[i]}
        if not over:
            return [out[i] if i in out else left * weights[i] / w for i in range(len(sizes))]
        for i in over:
            out[i] = 2.0 * sizes[i]
        open_ -= over
    return [out[i] for i in range(len(sizes))]


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, size string")
    got = [r.asDict() for r in C.mix(df).collect()]
    assert len(got) == len(rows)
    per = defaultdict(int)
    for _, t, s in rows:
        per[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(per, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, targets([per[s] for s in names], [C.WEIGHTS[i % 3] for i in range(len(names))])))
    for s in names:
        mine = [r for r in got if r["source"] == s]
        assert all(math.isclose(r["target"], want[s], rel_tol=1e-12, abs_tol=1e-9) and r["source_size"] == per[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 1
        assert all(0 <= r["taken"] <= 2 * r["size"] and sum(p["words"] for p in r["passes"]) == r["taken"] for r in mine)
    return got


ROWS = [(i, "w " * (i % 17), f"s{i % 5}") for i in range(200)] + [(1000 + i, "big " * 50, "hot") for i in range(150)] + [(1, None, None), (2, "a b", None), (2, "a b", None), (None, "c", "s1"), (7, "", "void"), (8, "x" * 9000, "é")]


def test_against_round_by_round_resharing(spark, monkeypatch):
    monkeypatch.setattr(C, "BIN_ROWS", 20)
    a = check(spark, ROWS)
    assert sorted(map(str, a)) == sorted(map(str, check(spark, ROWS[::-1])))
    check(spark, [(1, "a b c", "x"), (2, "d", "y")])
    check(spark, [(1, "", "x")])
    assert C.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_schedule_is_sorted_and_follows_the_weights(spark):
    df = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    rows = C.schedule(C.mix(df)).collect()
    pos = [r.position for r in rows]
    assert pos == sorted(pos) and 0 <= pos[0] and pos[-1] <= 1
    early = [r for r in rows if r.position < 0.25 and r.doc_id % 3 == 0]
    late = [r for r in rows if r.position >= 0.75 and r.doc_id % 3 == 0]
    assert len(early) > 1.5 * len(late)  # s0's weight falls


def test_the_query_s_rows_come_in_training_order(spark):
    rows = C.op5_curriculum_mix(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    place = [2.0 if r.first_position is None else r.first_position for r in rows]
    assert place == sorted(place) and (place[-1] == 2.0) == any(r.taken == 0 for r in rows)
    assert all((r.first_position is None) == (r.taken == 0) for r in rows) and len(rows) == docs.count()
    readings = C.schedule(C.mix(docs)).collect()
    taken, first = defaultdict(int), {}
    for r in readings:
        taken[r.doc_id] += r.words
        first.setdefault(r.doc_id, r.position)
    assert {r.doc_id: r.taken for r in rows if r.taken} == dict(taken)
    assert all(math.isclose(r.first_position, first[r.doc_id], abs_tol=1e-6) for r in rows if r.taken)


def test_oracle(spark):
    con = duckdb.connect()
    documents = pa.table({"doc_id": [r[0] for r in ROWS], "text": [r[1] for r in ROWS], "source": [r[2] for r in ROWS]})  # noqa: F841
    want = con.sql(C.ORACLE).fetchall()
    first = F.try_element_at("passes", F.lit(1))["position"]
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    got = C.mix(df).select("doc_id", "size", "source_size", "target", "taken", F.round(first, 6)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
