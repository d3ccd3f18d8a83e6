import math
import random

import pytest

from tricklake.llm import piece_codec as P


@pytest.fixture(scope="module")
def vocab():
    return P.PieceVocabulary()


def whole(chars, v):
    """Score of the best segmentation, all positions kept."""
    best = [0.0] + [-math.inf] * len(chars)
    for j in range(1, len(chars) + 1):
        for i in range(max(0, j - v.longest), j):
            if chars[i:j] in v.ids:
                best[j] = max(best[j], best[i] + v.ids[chars[i:j]][1])
        if chars[j - 1] not in v.ids:
            best[j] = max(best[j], best[j - 1] + v.spell(chars[j - 1])[1])
    return best[-1]


def score(ids, v):
    bytes_of = set(v.byte_ids.values())
    out, text = 0.0, b"".join(v.raw[i] for i in ids)
    k = 0
    while k < len(ids):
        if ids[k] in bytes_of:  # a spelled character
            run = bytearray()
            while True:
                run += v.raw[ids[k]]
                k += 1
                try:
                    out += v.spell(run.decode())[1]
                    break
                except UnicodeDecodeError:
                    pass
        else:
            out -= math.log(ids[k] + 10)
            k += 1
    return out, text


def test_streaming_equals_the_whole_search(vocab):
    r = random.Random(1)
    alphabet = "abcdeehtnoi sr▁é漢\n"
    for n in (0, 1, 5, 40, 400, 3000):
        text = "".join(r.choice(alphabet) for _ in range(n))
        ids = [i for part in P.viterbi(text, vocab) for i in part]
        s, raw = score(ids, vocab)
        assert raw.decode() == text and math.isclose(s, whole(text, vocab), abs_tol=1e-6)
        a = P.encode_texts([text], P._Units(vocab))[0].tolist()
        if n:
            assert math.isclose(score(a, vocab)[0], whole(" " + text, vocab), abs_tol=1e-6)


def test_shared_beginnings_and_memo_do_not_change_ids(vocab, monkeypatch):
    r = random.Random(2)
    words = sorted({"".join(r.choice(" thea▁éion漢") for _ in range(r.randint(1, 50))) for _ in range(3000)})
    begun, join = P.Beginning(), lambda parts: [i for part in parts for i in part]
    assert [join(P.viterbi(w, vocab, begun)) for w in words] == [join(P.viterbi(w, vocab)) for w in words]
    texts = [" ".join(r.choice(words) for _ in range(10)) for _ in range(60)] * 2
    want = [score(a.tolist(), vocab) for a in P.encode_texts(texts, P._Units(vocab))]
    monkeypatch.setattr(P, "MEMO_BYTES", 3000)
    units = P._Units(vocab)
    assert [score(P.encode_texts([t], units)[0].tolist(), vocab) for t in texts] == want and units.held < 20_000


def test_commits_early(vocab):
    first = next(P.viterbi("the " * 5000, vocab))
    assert len(first) < 200


def test_keeps_a_bounded_window(vocab):
    r = random.Random(3)
    text = "".join(r.choice("ethanoirs") for _ in range(40000))  # one word
    g, most, parts = P.viterbi(text, vocab), 0, 0
    for _ in g:
        most, parts = max(most, len(g.gi_frame.f_locals["back"]) if g.gi_frame else 0), parts + 1
    assert most < 10 * vocab.longest and parts > 4000


def test_scores_of_another_library(vocab):
    """Unigram search of the tokenizers package with the same pieces and scores."""
    from tokenizers import models

    pieces = sorted(vocab.ids.items(), key=lambda x: x[1][0])
    other = models.Unigram([("\0", -1e9), *((p, s) for p, (_, s) in pieces)], unk_id=0, byte_fallback=False)
    r = random.Random(4)
    letters = [p for p in vocab.ids if len(p) == 1 and p.isalpha() and p.isascii()]
    for n in (1, 3, 8, 15, 40, 200):
        for _ in range(40):
            text = "".join(r.choice(letters) for _ in range(n))
            theirs = sum(vocab.ids[t.value][1] for t in other.tokenize(text))
            ids = [i for part in P.viterbi(text, vocab) for i in part]
            assert math.isclose(score(ids, vocab)[0], theirs, abs_tol=1e-6)


def test_round_trip(spark, vocab):
    rows = [(1, None), (2, ""), (3, "  two  blanks "), (3, "  two  blanks "), (4, "▁mark\t\r\n<0x41>"), (5, "x" * 30000), (6, "漢字 𝄞 é"), (None, "null id")]
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, ids string")
    got = P.encoded(df).collect()
    assert len(got) == len(rows)
    assert all(r.round_trip for r in got if r.doc_id != 1) and [r.ids for r in got if r.doc_id in (1, 2)] == [None, []]
    assert P.encoded(df.limit(0)).collect() == []
    assert P.op8_sentencepiece(spark, "/root/testdata/sf0.001").where("not round_trip").count() == 0
