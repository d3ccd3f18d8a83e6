import hashlib
import random
import zlib

import duckdb
import pytest

from tricklake.llm import merkle as M

SF = "/root/testdata/sf0.01"
COLS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def coded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grow(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def around(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        out.append((run[: i % 8], run[i % 8 + 1 :]))
        i //= 8
    return out


def brute(rows):
    """What op12 returns for rows (doc_id, source, lang, n_chars, text)."""
    of = {}
    for r in rows:
        leaf = H(*map(coded, r))
        cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
        claim = H(*map(coded, r[:4]), coded(r[4].encode().lower().decode())) if cut else leaf
        of.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf, claim, r[0]))
    langs = sorted(of, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: grow([r[2] for r in sorted(of[x])]) for x in langs}
    top = grow([trees[x][-1][0] for x in langs]) if langs else []
    out = []
    for t, x in enumerate(langs):
        for i, (_, _, leaf, claim, doc_id) in enumerate(sorted(of[x])):
            path = around(trees[x], i) + around(top, t)
            h = claim
            for left, right in path:
                h = H(*left, h, *right)
            root = top[-1][0]
            out.append((doc_id, leaf, trees[x][-1][0], root, H(*(s for left, right in path for s in (*left, *right))), h, h == root))
    return sorted(out, key=str)


def got(spark, rows, tmp_path):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], COLS + ", pos int, tree string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, M.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def test_odd_rows(spark, tmp_path):
    long = "Long Text " * 20000
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(83)]
    rows += [(5, "s", "de", None, long), (None, None, None, None, None), (None, "s", "en", 0, ""), (7, "s", None, 1, "é ÀÉ Z"), (3, "s", "zz", 1, "Alone"), (2, "", "", 0, "A"), (8, "a", "Ä", 2, "x"), (9, "a", "fr", 2, "X")]
    rows += [(5, "s", "de", None, long), (7, "t", "de", 1, "same id"), (7, "u", "de", 1, "same id")]
    rows += [(i, None, f"l{i}", i, "Few") for i in range(20)]
    assert got(spark, rows, tmp_path) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 65])
def test_sizes(spark, tmp_path, n):
    rows = [(i * 3, "s", "en", 1, "Some Text") for i in range(n)]
    assert got(spark, rows, tmp_path) == brute(rows)


def test_missing_nodes_are_the_least_set():
    r = random.Random(3)
    for _ in range(300):
        size = r.randint(1, 700)
        lo = r.randrange(size)
        hi = r.randrange(lo, size)
        need, have = set(), {(0, i) for i in range(lo, hi + 1)}
        n, level = size, 0
        while n > 1:
            for i in list({i for k, i in have if k == level}):
                run = range(i // 8 * 8, min(i // 8 * 8 + 8, n))
                need |= {(level, j) for j in run}
                have.add((level + 1, i // 8))  # follows from its run
            n, level = -(-n // 8), level + 1
        assert sorted(M.missing(lo, hi, size)) == sorted(need - have)


def test_slices_that_cut_runs(spark):
    rows = [(i, f"g{i % 7 * (i % 3)}", f"{i:064d}") for i in range(500)]
    man = M.build(spark.createDataFrame(rows, "k long, g string, h string"), "g", "k", "h")
    want = None
    for size in (16, 37, 2048):
        out = M.multiproofs(man, "h", size)
        have = sorted(map(tuple, out.select("k", "before", "after", "root", M.fold(out.h, out.before, out.after)).collect()))
        assert len(have) == 500 and all(x[3] == x[4] == man.root for x in have)
        assert want is None or have == want
        want = have


def test_query_and_oracle_on_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    have = sorted(map(tuple, M.op12_merkle_manifest(spark, SF).collect()), key=str)
    assert have == brute(rows)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    assert sorted(con.sql(M.ORACLE).fetchall(), key=str) == have
    assert 0 < sum(not r[-1] for r in have) < len(have)
