"""Line dedup against brute force over windows of every length."""

import random

from tricklake.llm import line_dedup as D


def brute(rows, least):
    docs = {(d, t): t.split("\n") for d, t in rows if t is not None}
    keys = sorted(docs, key=lambda k: (k[0] is None, k[0] or 0))
    gone = {k: set() for k in keys}
    for h in range(1, max(map(len, docs.values())) + 1):
        seen = set()
        for k in keys:
            for i in range(len(docs[k]) - h + 1):
                w = tuple(docs[k][i : i + h])
                if w in seen and sum(map(len, w)) >= least:
                    gone[k] |= set(range(i, i + h))
                seen.add(w)
    texts = lambda d, t: "\n".join(x for i, x in enumerate(docs[d, t]) if i not in gone[d, t])
    return sorted(((d, None, 0, 0) if t is None else (d, texts(d, t), len(docs[d, t]), len(gone[d, t])) for d, t in rows), key=str)


def got(spark, rows, least):
    out = D.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), least)
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in out.collect()), key=str)


def test_floor_of_the_whole_run(spark):
    a, b, c = "a" * 20, "b" * 5, "c" * 20
    edge = ["e" * 45, "f" * 3, "g" * 3]
    rows = [(1, "\n".join(["one", a, b, c, "two"])), (2, "\n".join(["three", a, b, c])), (3, "\n".join([*edge, "four"])), (4, "\n".join(["five", *edge])), (5, "\n".join([a, b, "six"]))]
    assert got(spark, rows, 40) == brute(rows, 40) == sorted([(1, rows[0][1], 5, 0), (2, "three", 4, 3), (3, rows[2][1], 4, 0), (4, "five", 4, 3), (5, rows[4][1], 3, 0)], key=str)


def test_every_length(spark):
    r = random.Random(7)
    pool = [f"{i}" + "z" * (i % 9) for i in range(9)] + ["", "", "b"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 14)))) for i in range(40)]
    long = [r.choice(pool) for _ in range(60)]
    rows += [(200 + i, "\n".join([f"own {i}", *long[i : 50 + i], f"end {i}"])) for i in range(4)]
    rows += [(100, None), (101, ""), (102, "\n" * 30 + "x" * 70), (106, "\n" * 37 + "x" * 70 + "\n\n"), (103, rows[3][1]), (103, rows[3][1]), (None, rows[5][1]), (50, "same\n" * 70)]
    for least in (0, 1, 14, 60):
        assert got(spark, rows, least) == brute(rows, least)
