"""Documents of any shape as tables: nothing is lost."""

import json
import random

from pyspark.sql import functions as F

from tricklake.sources import documents as D


def leaves(v):
    if isinstance(v, dict):
        for x in v.values():
            yield from leaves(x)
    elif isinstance(v, list):
        for x in v:
            yield from leaves(x)
    else:
        yield {True: "true", False: "false"}.get(v, v) if isinstance(v, bool) else v


def expected(doc, v, keys=()):
    out = []

    def visit(tbl, i, parent, v):
        if isinstance(v, dict) and v and all(k.isdigit() for k in v):
            for k, x in v.items():
                visit(tbl, f"{i}-{k}", parent, x)
        elif isinstance(v, dict):
            i = next((str(v[k]) for k in keys if k in v), i)
            plain = {k: x for k, x in v.items() if not isinstance(x, (dict, list))}
            out.extend((tbl, i, parent, k, x) for k, x in plain.items())
            if not plain:
                out.append((tbl, i, parent, None, None))
            for k, x in v.items():
                if k not in plain:
                    visit(k, i, i, x)
        elif isinstance(v, list):
            for n, x in enumerate(v):
                visit(tbl, f"{i}-{n}", parent, x)
        else:
            out.append((tbl, i, parent, "value", v))

    visit("root", doc, None, v)
    text = lambda x: x if x is None else str(x).lower() if isinstance(x, bool) else str(x)
    return sorted(((doc, *r[:4], text(r[4])) for r in out), key=str)


def walk(spark, docs, tmp_path, keys=()):
    df = spark.createDataFrame([(d, None if v is None else json.dumps(v)) for d, v in docs], "k string, j string").select("k", F.parse_json("j").alias("v"))
    return sorted((tuple(x) for x in D.walk_variants(df, "k", "v", f"file://{tmp_path}/{random.random()}", keys).collect()), key=str)


def test_the_case_that_lost_fields(spark, tmp_path):
    doc = {"n": {"a": 5, "kids": [{"x": 1}, {"x": 2, "more": {"y": "z"}}]}, "l": [{"in": {"z": 3}}, 7, [8, [9]]], "m": {"12": {"a": 1}, "13": {"a": 2}, "14": 3}, "e": {}, "el": []}
    got = walk(spark, [("d", doc)], tmp_path)
    assert got == expected("d", doc)
    for row in [("n", "d", "d", "a", "5"), ("kids", "d-1", "d", "x", "2"), ("more", "d-1", "d-1", "y", "z"), ("in", "d-0", "d-0", "z", "3"), ("l", "d-2-1-0", "d", "value", "9"), ("m", "d-13", "d", "a", "2"), ("m", "d-14", "d", "value", "3"), ("e", "d", "d", None, None)]:
        assert ("d", *row) in got


def test_shapes_that_differ_by_row(spark, tmp_path):
    r = random.Random(7)

    def make(depth):
        kind = r.random()
        if depth == 0 or kind < 0.3:
            return r.choice([1, -7, "text", True, False, None, "", 12345678901])
        if kind < 0.6:
            return {f"{'f' if kind < 0.5 else ''}{r.randint(0, 9)}": make(depth - 1) for _ in range(r.randint(0, 4))}
        return [make(depth - 1) for _ in range(r.randint(0, 3))]

    docs = [(f"d{i}", {"top": make(4), "id": i}) for i in range(60)] + [("null", None), ("plain", 5), ("list", [1, {"a": 2}]), ("none", {})]
    got = walk(spark, docs, tmp_path)
    assert got == sorted((x for d, v in docs if v is not None for x in expected(d, v)), key=str)
    # every leaf of every document is in some table
    text = lambda x: x if x is None else str(x)
    assert sorted((text(x) for d, v in docs if v is not None for x in leaves(v)), key=str) == sorted((x[5] for x in got if x[4] is not None), key=str)


def test_primary_keys_and_columns(spark, tmp_path):
    docs = [("d", {"event": {"event_id": 77, "name": "Open", "sessions": [{"session_id": "s1", "n": 1}, {"n": 2}]}})]
    got = walk(spark, docs, tmp_path, ("event_id", "session_id"))
    assert got == expected("d", docs[0][1], ("event_id", "session_id"))
    df = spark.createDataFrame(got, "doc string, tbl string, id string, parent string, field string, value string")
    assert sorted(map(tuple, D.walked_table(df, "sessions", ["session_id", "n"]).collect())) == [("d", "77-1", "77", None, "2"), ("d", "s1", "77", "s1", "1")]
