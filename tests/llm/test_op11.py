import itertools
import random

import pytest
import xxhash

from tricklake.llm import simhash_dedup as S


def brute_print(text, k):
    import re

    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    hs = [xxhash.xxh64(b" ".join(words[i : i + k]), seed=42).intdigest() for i in range(max(len(words) - k + 1, 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, k, radius):
    prints = [brute_print(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, prints[i], least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in S.simhash_duplicates(df, **kw).collect()), key=str)


@pytest.mark.parametrize("radius,free", [(4, 64), (4, 31), (4, 15), (4, 5), (3, 40), (1, 64)])
def test_masks_cover_the_radius(radius, free):
    r = random.Random(free)
    positions = r.sample(range(64), free)
    masks = S.covering_masks(radius, sum(1 << p for p in positions))
    assert 0 not in masks and len(masks) <= 2 ** (radius + 1) - 1
    every = itertools.combinations(positions, radius) if free < 32 else (r.sample(positions, radius) for _ in range(5000))
    for some in every:
        assert any(not m & sum(1 << p for p in some) for m in masks)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(20000))
    rows = [(4, long), (9, long.upper()), (3, long + " more"), (7, None), (8, ""), (1, " \t\n"), (12, "one"), (11, "ONE"), (5, "a b c d"), (5, "a b c"), (None, "a b c"), (None, None), (None, "nobody else"), (4, long)]
    assert got(spark, rows, k=4) == brute(rows, 4, 4)
    assert got(spark, []) == []


@pytest.mark.parametrize("most", [16, 4096])
def test_crowded_buckets(spark, most):
    """Thousands of prints around few centres: with small buckets they are dealt on, twice and more."""
    r = random.Random(most)
    prints = set()
    for _ in range(3):
        x = r.getrandbits(64)
        for _ in range(250):
            prints.add(x)
            x ^= 1 << r.randrange(64)
            if r.random() < 0.3:
                x ^= sum(1 << b for b in r.sample(range(64), 9))
        dense = r.getrandbits(64)
        prints |= {dense ^ r.getrandbits(9) for _ in range(60)}
    prints = sorted(prints)
    up = {p: p for p in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            up[root(a)] = root(b)
    want = {frozenset(p for p in prints if root(p) == x) for x in {root(p) for p in prints}}
    df = spark.createDataFrame([(S._signed(p),) for p in prints], "fp long")
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in S.links_within(df, 4, most).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    up = {p: p for p in prints}
    for a, b in links:
        up[root(a)] = root(b)
    assert {frozenset(p for p in prints if root(p) == x) for x in {root(p) for p in prints}} == want


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    have = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in S.op11_covering_simhash(spark, sf).collect())
    assert have == sorted(brute(rows, 4, 4))
    assert any(c != d for d, _, c in have)
