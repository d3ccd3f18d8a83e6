import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tricklake.llm import spelling as S

SF = "/root/testdata/sf0.01"


def edits_apart(a, b):
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    words = sorted(counts)
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by_size.get(len(w) + k, []) if edits_apart(w, x)] for w in words}
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= 2 * counts[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, counts[w], form.get(w), root, len(near[w]), counts[form[w]] if w in form else None))
    return out


def brute_counts(rows):
    total = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.encode().lower().decode()
            h = zlib.crc32(f"{'null' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def got(df):
    return sorted((r.word, r.n, r.form, r.root, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("alphabet,size", [("ab", 9), ("aéÿ", 5), ("abcdefghijklmnopqrstuvwxyz", 3)])
def test_random_words(spark, alphabet, size):
    r = random.Random(size)
    counts = {"".join(r.choice(alphabet) for _ in range(r.randint(1, size))): r.choice((1, 2, 3, 5, 8, 8, 20, 41, 100)) for _ in range(400)}
    df = spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()] + [("", 9, "x", 1), (None, 9, "x", 1)], "word string, n long, key string, id int")
    assert got(S.spelling_variants(df)) == brute(counts)


def test_long_chain_and_one_long_word(spark):
    counts = {"a" * (5 + i): 2**i for i in range(41)}  # each the form of the one before
    counts |= {"z" * 70 + "b" * i: 1 + 9 * i for i in range(3)} | {"q" * 5000: 3, "q" * 4999: 9, "q" * 2000 + "r" + "q" * 2999: 2}
    out = got(S.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert out == brute(counts)
    assert {x[3] for x in out if x[0][0] == "a"} == {"a" * 45}


def test_counts_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 500)
    r = random.Random(8)
    words = [f"{a}{b}" for a in ("colour", "Naïve", "ÉTUDE", "x×y÷z", "ß", "Ā", "don't", "I") for b in ("", "s", "ed")]
    rows = [(i, " ".join(r.choice(words) for _ in range(90))) for i in range(60)]
    rows += [(None, rows[0][1]), (1, None), (2, ""), (3, rows[3][1]), (3, rows[3][1]), (4, "longword" * 9000), (4, "longword" * 9000)]
    df = spark.createDataFrame([(d, t, 1, "n") for d, t in rows], "doc_id long, text string, n int, word string")
    have = S.word_counts(df, 5, S.misspelling).where("n >= 3")
    assert dict(map(tuple, have.collect())) == brute_counts(rows)


def test_empty(spark):
    assert got(S.spelling_variants(spark.createDataFrame([], "word string, n long"))) == []
    assert S.word_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_and_oracle_on_the_given_table(spark):
    have = got(S.op13_spelling_variants(spark, SF))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {x[0]: x[1] for x in have} == brute_counts(rows) and any(x[2] for x in have)
    some = [x for x in have if x[0][0] in "kvé"]
    assert all(x[4] == sum(edits_apart(x[0], y[0]) for y in have) for x in some)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    assert sorted(con.sql(S.ORACLE).fetchall()) == have
