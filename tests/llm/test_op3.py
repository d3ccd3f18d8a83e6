import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tricklake.llm import lm_scoring as L


def segmentations(text, scores):
    """Sum over all segmentations, by enumeration."""
    if not text:
        return 1.0
    return sum(math.exp(scores[text[:i]]) * segmentations(text[i:], scores) for i in range(1, len(text) + 1) if text[:i] in scores)


def test_forward_is_the_sum_of_all_segmentations():
    scores = {b: math.log(p) for b, p in ((b"a", 0.2), (b"b", 0.3), (b"ab", 0.1), (b"ba", 0.15), (b"aba", 0.05))}
    lat = L.Lattice(scores)
    for text in (b"", b"a", b"abab", b"babbaab"):
        assert math.isclose(math.exp(lat.forward(text)[-1]), segmentations(text, scores), rel_tol=1e-12)
    words = [(b"aab", 1.0), (b"abab", 2.0), (b"ababba", 0.5), (b"b", 3.0), (b"b", 3.0), (b"babba", 1.0)]
    into, slow = {}, {}
    lat.expect(words, into)
    together = list(lat.marginals(w for w, _ in words))
    lat.SHORT = 0
    lat.expect(words, slow)
    assert math.isclose(sum(len(k) * v for k, v in into.items()), sum(len(w) * c for w, c in words))  # each segmentation covers the text
    assert into.keys() == slow.keys() and all(math.isclose(into[k], slow[k]) for k in into)
    assert all(math.isclose(x, lat.forward(w)[-1]) and math.isclose(math.exp(x), segmentations(w, scores)) for x, (w, _) in zip(together, words))
    assert lat.forward(b"ab" * 30000)[-1] < -1000  # no underflow
    assert lat.forward(b"c")[-1] == -math.inf


def brute_counts(rows):
    tok = {i: [w for w in (t or "").encode().lower().split()] + [b""] for i, (_, t) in enumerate(rows)}
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    c = Counter(w for i, ws in tok.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, held[i], len(tok[i]), sum(c[w] > 0 for w in tok[i]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok[i])) for i, (d, _) in enumerate(rows)]


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, word string")
    got = sorted((tuple(r) for r in L.lm_scores(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()), key=lambda r: (str(r[0]), r[2], r[5]))
    want = sorted(brute_counts(rows), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and g[6] < 0
    return got


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK_DOCS", 2)
    check(spark, [(1, None), (2, ""), (3, "A a b"), (3, "A a b"), (None, "q"), (4, "w" * 5000), (5, "x " * 70000), (6, "é ▁ \n\t z")])
    assert L.lm_scores(spark.createDataFrame([], "doc_id long, text string"), F.lit(False)).collect() == []


def vocabulary():
    """The file's pieces that fit in one marked word, by rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=L.MODEL)
    weights = {}
    for i in range(3, sp.get_piece_size()):
        piece = bytes([i - 3]) if i < 259 else sp.id_to_piece(i).encode()
        if b"\xe2\x96\x81" not in piece[1:] and not any(c in piece for c in b" \t\n\v\f\r"):
            weights[piece] = weights.get(piece, 0) + 1 / (i + 10)
    for b in range(256):
        weights.setdefault(bytes([b]), 1 / (len(weights) + 10))
    total = sum(weights.values())
    return {p: w / total for p, w in weights.items()}


def uses(word, chances):
    """Probability of a word and the expected uses of its pieces, by sums over all pairs of offsets."""
    n = len(word)
    a, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for j in range(1, n + 1):
        a[j] = sum(a[i] * chances.get(word[i:j], 0.0) for i in range(j))
    for i in range(n - 1, -1, -1):
        b[i] = sum(chances.get(word[i:j], 0.0) * b[j] for j in range(i + 1, n + 1))
    return a[n], [(word[i:j], a[i] * chances[word[i:j]] * b[j] / a[n]) for i in range(n) for j in range(i + 1, n + 1) if word[i:j] in chances]


def test_scores_against_brute_force(spark):
    """Training and scores of whole documents, worked out word by word."""
    rows = [(i, t) for i, t in enumerate(["the cat sat on the mat", "The dog and the cat", "", None, "ünïcode wörds ü", "dogs dogs dogs", "a strange xylophone", "on and on", "cat", "held out mat of dogs"])]
    chances, held = vocabulary(), {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    assert held
    tokens = {i: (t or "").encode().lower().split() for i, t in rows}
    c = Counter(w for i, ws in tokens.items() if i not in held for w in ws)
    for _ in range(L.ROUNDS):
        n = Counter()
        for w, k in c.items():
            for piece, e in uses(b"\xe2\x96\x81" + w, chances)[1]:
                n[piece] += k * e
        total = sum(n.values()) + 0.1 * len(chances)
        chances = {p: (n[p] + 0.1) / total for p in chances}
    ends = len(rows) - len(held)
    end = (ends + 1) / (sum(c.values()) + ends + 2)
    got = {r.doc_id: r.score for r in L.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()}
    for i, ws in tokens.items():
        want = math.log10(end) + sum(math.log10((1 - end) * uses(b"\xe2\x96\x81" + w, chances)[0]) for w in ws)
        assert math.isclose(got[i], want, rel_tol=1e-9), i


def test_each_round_scores_held_out_words_better(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)
    train, held = Counter(), Counter()
    for d, t in rows:
        (held if zlib.crc32(str(d).encode()) % 7 == 2 else train).update((t or "").encode().lower().split())
    words = spark.createDataFrame(sorted(train.items()), "word binary, c long").coalesce(1)
    scores, totals = L.vocabulary(), []
    for _ in range(L.ROUNDS + 1):
        assert math.isclose(sum(map(math.exp, scores.values())), 1.0, rel_tol=1e-9)
        lattice = L.Lattice(scores)
        totals.append(sum(c * lattice.forward(L.MARK + w)[-1] for w, c in held.items()))
        scores = L.learn_scores(words, scores)
    assert totals == sorted(totals) and totals[1] > 0.8 * totals[0]


def test_chunks_are_small_and_added_up_in_arrow(spark):
    # a worker that held a chunk of 16 MB as Python objects took an executor's memory
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} only{i} w{i % 7}") for i in range(3500)] + [(None, "w1"), (9000, None)], "doc_id long, text string").coalesce(1)
    postings = L.word_postings(docs.withColumn("held_out", F.lit(False)), True)
    assert postings.where("word is null").count() == 2
    out = L.lm_scores(docs, F.col("doc_id") % 7 == 2, rounds=1)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert len(got) == 3502 and sorted(r.doc_id for r in got if r.doc_id is not None) == [*range(3500), 9000]
    by = {r.doc_id: r for r in got}
    assert by[None].n_tokens == 2 and by[9000].n_tokens == 1 and all(by[i].n_tokens == 5 and by[i].n_known == (4 if i % 7 == 2 else 5) for i in range(3500))
