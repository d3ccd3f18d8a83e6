import re

from tricklake.llm import minhash_dedup as M

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, k, num, den):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").encode().lower())
        sets.setdefault(d, set()).update({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    from collections import Counter

    both = Counter()
    for ds in where.values():
        ds = sorted(ds)
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[a, b] += 1
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in both.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d, _ in rows)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, component_id string")
    return [tuple(r) for r in M.near_duplicates(df, **kw).collect()]


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(4, long), (2, long + " x"), (7, None), (8, ""), (9, "A b"), (10, "a B"), (11, " \t\n"), (12, long.upper()), (13, "one")]
    got = run(spark, rows + [(None, long)], k=3, num=85, den=100)
    assert sorted(x for x in got if x[0] is not None) == brute(rows, 3, 85, 100)
    assert [x for x in got if x[0] is None] == [(None, 58, None, True)]


def test_empty(spark):
    assert run(spark, [], k=3) == []


def test_long_posting_lists(spark, monkeypatch):
    """A group of near copies whose posting lists go by leaders and blocks."""
    import random

    monkeypatch.setattr(M, "BLOCK", 16)
    monkeypatch.setattr(M, "LEADERS", 1)
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(120)] = f"e{r.randrange(1000)}"
        rows.append((d, " ".join(w)))
    assert sorted(run(spark, rows, k=3, num=85, den=100)) == brute(rows, 3, 85, 100)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in M.op6_minhash_dedup(spark, "/root/testdata/sf0.01").collect())
    assert got == brute(rows, 3, 85, 100)
    assert any(not r[3] for r in got)
