import duckdb

from tricklake.llm import line_dedup as D


def brute(rows, least):
    docs = {}
    for d, t in rows:
        if t is not None:
            docs[d is None, d or 0, t] = t.split("\n")
    keys = sorted(docs, key=lambda k: k[:2])
    gone = {k: set() for k in keys}
    for h in range(1, max(map(len, docs.values()), default=0) + 1):
        seen = set()
        for k in keys:
            ls = docs[k]
            for i in range(len(ls) - h + 1):
                w = tuple(ls[i : i + h])
                if w in seen and sum(map(len, w)) >= least:
                    gone[k] |= set(range(i, i + h))
                seen.add(w)
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
        else:
            k = (d is None, d or 0, t)
            out.append((d, "\n".join(x for i, x in enumerate(docs[k]) if i not in gone[k]), len(docs[k]), len(gone[k])))
    return sorted(out, key=str)


def got(spark, rows, least):
    df = spark.createDataFrame([(d, t, 5, "a") for d, t in rows], "doc_id long, text string, pos int, a string")
    out = D.line_dedup(df, least)
    assert {"doc_id", "text", "pos", "a"} <= set(out.columns)
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in out.collect()), key=str)


def test_runs_and_odd_rows(spark):
    import random

    r = random.Random(4)
    pool = [f"line {i} " + "z" * (i % 9) for i in range(12)] + ["", "", "b"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 14)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, rows[3][1]), (103, rows[3][1]), (None, rows[5][1]), (104, "x" * 20000), (105, "x" * 20000 + "\ny"), (50, "same\n" * 70)]
    for least in (1, 14, 60):
        assert got(spark, rows, least) == brute(rows, least)
    assert got(spark, [], 10) == []


def test_columns_of_clashing_names(spark):
    rows = [(1, "a" * 50, 1, 2, 3, "x", 9, 8), (2, "a" * 50 + "\nrest", 4, 5, 6, "y", 7, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d int, t int, _d2 int, spans string, n_lines int, row int")
    out = D.line_dedup(df)
    assert out.columns == ["doc_id", "text", "d", "t", "_d2", "spans", "row", "n_lines", "n_deleted"]
    assert sorted(map(tuple, out.collect())) == [(1, "a" * 50, 1, 2, 3, "x", 8, 1, 0), (2, "rest", 4, 5, 6, "y", 6, 2, 1)]


def test_oracle(spark):
    con = duckdb.connect()
    con.sql("create view documents as select * from read_parquet('/root/testdata/sf0.001/documents.parquet')")
    want = sorted(con.sql(D.ORACLE).fetchall())
    have = sorted(map(tuple, D.op9_line_dedup(spark, "/root/testdata/sf0.001").collect()))
    assert have == want and any(r[2] for r in have)
