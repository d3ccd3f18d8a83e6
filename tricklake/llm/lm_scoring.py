"""Language-model scores: word counts of the corpus and subword lattice likelihood.

The pieces of a public vocabulary, with scores learned here, weight all
segmentations of a text; the forward recursion in log space sums them. No piece
holds a word mark after its first character, so all segmentations of a document
pass through every word start and the document's lattice is the product of its
words' lattices: the recursion runs once for each distinct word of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
END = b""  # a token that no word can equal
#: what a task holds of one chunk: its words while postings are made, its postings while they are added up
CHUNK_BYTES, CHUNK_DOCS = 6_000_000, 3_000
#: rounds of expectation maximisation
ROUNDS = 3


def vocabulary(model_file: str = MODEL) -> dict[bytes, float]:
    """Pieces (bytes) that can occur inside one marked word, with natural-log scores.

    The file ranks its pieces; rank r starts with a weight of 1 / (r + 10). Pieces with
    a mark after their first character are left out; byte pieces stand for
    single bytes, so any text has a segmentation. The size of the vocabulary bounds what is sent to tasks.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    out: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        piece = bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).encode()
        if piece.find(MARK, 1) < 0 and not set(piece) & {9, 10, 11, 12, 13, 32}:
            out[piece] = out.get(piece, 0.0) + 1 / (i + 10)
    for b in range(256):
        out.setdefault(bytes([b]), 1 / (len(out) + 10))
    total = math.fsum(out.values())
    return {k: math.log(v / total) for k, v in out.items()}


class Lattice:
    """Forward and backward recursions over all segmentations of marked words.

    Words come sorted; up to SHORT bytes they share the states of common beginnings, which are
    kept on a stack. Longer ones go alone, in log space, with the memory of their length.
    """

    #: Up to this many bytes no product of piece probabilities underflows.
    SHORT = 40

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.stems = {p[:i] for p in scores for i in range(1, len(p) + 1)}
        #: every end of a piece -> the piece's probability, or None if it is only an end
        chances = {p: math.exp(s) for p, s in scores.items()}
        self.tails = {p[i:]: chances.get(p[i:]) for p in scores for i in range(len(p))}

    def edges(self, text: bytes, i: int) -> Iterator[tuple[int, bytes, float]]:
        j, n, stems, scores = i + 1, len(text), self.stems, self.scores
        while j <= n and (p := text[i:j]) in stems:
            if (s := scores.get(p)) is not None:
                yield j, p, s
            j += 1

    def forward(self, text: bytes) -> list[float]:
        """Log probability of reaching each byte offset, over all segmentations; the memory is the text's length."""
        a = [-math.inf] * (len(text) + 1)
        a[0] = 0.0
        for i in range(len(text)):
            if (x := a[i]) == -math.inf:
                continue
            for j, _, s in self.edges(text, i):
                s, y = s + x, a[j]
                a[j] = s if y == -math.inf else max(y, s) + math.log1p(math.exp(-abs(y - s)))
        return a

    def marginals(self, words: Iterable[bytes]) -> Iterator[float]:
        """Log probability of each word."""
        tails, a, before = self.tails, [1.0], b""
        for word in words:
            if len(word) > self.SHORT:
                yield self.forward(word)[-1]
                continue
            same = _shared(before, word)
            del a[same + 1 :]
            for j in range(same + 1, len(word) + 1):
                total, i = 0.0, j - 1
                while i >= 0 and (p := word[i:j]) in tails:
                    if (c := tails[p]) is not None:
                        total += a[i] * c
                    i -= 1
                a.append(total)
            before = word
            yield math.log(a[-1]) if a[-1] > 0 else -math.inf

    def expect(self, words: Iterable[tuple[bytes, float]], into: dict[bytes, float]) -> None:
        """Add the expected uses of each piece over words with weights.

        A boundary of a common beginning is reached from behind by all words that share it; so what comes
        back is added up on the stack and handed on when the boundary leaves it.
        """
        tails, a, back, ways, before = self.tails, [1.0], [0.0], [[]], b""

        def leave(size: int) -> None:
            while len(a) > size:
                a.pop()
                if b := back.pop():
                    for i, p, c in ways[-1]:
                        c *= b
                        back[i] += c
                        into[p] = into.get(p, 0.0) + a[i] * c
                ways.pop()

        for word, weight in words:
            if len(word) > self.SHORT:
                self._expect_long(word, weight, into)
                continue
            same = _shared(before, word)
            leave(same + 1)
            for j in range(same + 1, len(word) + 1):
                total, i, own = 0.0, j - 1, []
                while i >= 0 and (p := word[i:j]) in tails:
                    if (c := tails[p]) is not None:
                        total += a[i] * c
                        own.append((i, p, c))
                    i -= 1
                a.append(total)
                back.append(0.0)
                ways.append(own)
            if a[-1] > 0:
                back[-1] += weight / a[-1]
            before = word
        leave(1)

    def _expect_long(self, text: bytes, weight: float, into: dict[bytes, float]) -> None:
        a, n = self.forward(text), len(text)
        b = [-math.inf] * n + [0.0]
        for i in range(n - 1, -1, -1):
            top, found = -math.inf, []
            for j, p, s in self.edges(text, i):
                if (v := s + b[j]) > -math.inf:
                    found.append((p, v))
                    top = max(top, v)
            if found:
                b[i] = top + math.log(sum(math.exp(v - top) for _, v in found))
                if a[i] > -math.inf:
                    base = a[i] - a[n]
                    for p, v in found:
                        if (e := base + v) > -40:
                            into[p] = into.get(p, 0.0) + weight * math.exp(e)


def _shared(one: bytes, two: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(one), len(two))
    if one[:n] == two[:n]:
        return n
    return next(i for i in range(n) if one[i] != two[i])


def word_postings(docs: DataFrame, postings: bool) -> DataFrame:
    """docs(doc_id, text, held_out) -> per chunk of documents and distinct word: chunk, word, c (uses in training documents)[, posts].

    posts packs (document of the chunk, uses) in 32-bit words. Each chunk has one
    row more, without a word, that packs its documents' id, validity, held_out and token number.
    """

    def flush(ids: list, held: list, arrays: list, known: dict, uid: int):
        nd = len(ids)
        sizes = [len(x) for x in arrays]
        w = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
        d = np.repeat(np.arange(nd), sizes)
        key, tf = np.unique(w * nd + d, return_counts=True)
        w, d = key // nd, key % nd
        train = ~np.array(held, bool)
        words = np.unique(w)
        c = np.bincount(w, weights=tf * train[d], minlength=len(known))[words].astype(np.int64)
        names = list(known)
        names = pa.array([names[i] for i in words.tolist()], pa.binary())
        chunk = pa.array(np.full(len(words), uid, np.int64))
        if not postings:
            return pa.RecordBatch.from_arrays([chunk, names, pa.array(c)], ["chunk", "word", "c"])
        many = (tf - 1) // 0xFFFF
        if many.any():  # more uses than 16 bits hold: several entries
            w, d, tf = np.repeat(w, many + 1), np.repeat(d, many + 1), np.repeat(tf, many + 1)
            inner = np.arange(len(w)) - np.repeat(np.cumsum(many + 1) - many - 1, many + 1)
            tf = np.minimum(tf - 0xFFFF * inner, 0xFFFF)
        packed = (d | tf << 16).astype(np.uint32).tobytes()
        off = np.append(np.searchsorted(w, words), len(w)) * 4
        posts = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(packed)])
        doc = np.array([0 if x is None else x for x in ids], np.int64).tobytes()
        head = doc + np.array([x is not None for x in ids], np.uint8).tobytes() + np.array(held, np.uint8).tobytes() + np.array(sizes, np.int64).tobytes()
        body = [pa.concat_arrays([chunk, pa.array([uid])]), pa.concat_arrays([names, pa.array([None], pa.binary())]), pa.concat_arrays([pa.array(c), pa.array([0])]), pa.concat_arrays([posts, pa.array([head], pa.binary())])]
        return pa.RecordBatch.from_arrays(body, ["chunk", "word", "c", "posts"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 32
        ids, held, arrays, size = [], [], [], 0

        class Known(dict):
            def __missing__(self, word):
                i = self[word] = len(self)
                return i

        known = Known()
        for batch in batches:
            for doc, text, out in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["held_out"].to_pylist()):
                words = (text or "").encode().lower().split()
                words.append(END)
                arrays.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                ids.append(doc)
                held.append(bool(out))
                size += len(text or "")
                if size >= CHUNK_BYTES or len(ids) >= CHUNK_DOCS:
                    yield flush(ids, held, arrays, known, uid)
                    uid, ids, held, arrays, size, known = uid + 1, [], [], [], 0, Known()
        if ids:
            yield flush(ids, held, arrays, known, uid)

    return docs.select("doc_id", "text", "held_out").mapInArrow(rows, "chunk long, word binary, c long" + ", posts binary" * postings)


def learn_scores(words: DataFrame, scores: dict[bytes, float], floor: float = 0.1) -> dict[bytes, float]:
    """One round of expectation maximisation over words(word, c), sorted in each partition: new log scores; what comes to the driver is one row a piece."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        into: dict[bytes, float] = {}
        Lattice(scores).expect(((MARK + bytes(word), float(c)) for pdf in batches for word, c in zip(pdf["word"], pdf["c"])), into)
        yield pd.DataFrame({"piece": list(into), "n": list(into.values())})

    uses = words.where("c > 0 and word <> x''").mapInPandas(rows, "piece binary, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    n = {bytes(r[0]): r[1] for r in uses.collect()}
    total = math.fsum(n.values()) + floor * len(scores)
    return {p: math.log((n.get(p, 0.0) + floor) / total) for p in scores}


def lm_scores(docs: DataFrame, held_out, model_file: str = MODEL, rounds: int = ROUNDS) -> DataFrame:
    """Score each row's whole text by a word model and by the subword lattice, both learned from the rows where held_out is false.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score
    (both log10). Null and empty texts are one end token. A row with a null
    held_out expression (null doc_id) counts as training. Repeated rows are scored
    each and count each. An empty table gives no rows. The lattice's scores start from the vocabulary's and
    go through some rounds of expectation maximisation over all training words. Without training rows all counts are 0 and the scores are the prior's. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    words = written(word_postings(docs, False).groupBy("word").agg(F.sum("c").alias("c")).sortWithinPartitions("word"), "words")
    n, v, ends = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.sum(F.when(F.expr("word = x''"), F.col("c"))), F.lit(0))).first()
    scores = vocabulary(model_file)
    for _ in range(rounds):
        scores = learn_scores(words, scores)
    # the end is one more piece beside the words' pieces
    end = math.log((ends + 1) / (n + 2))
    go_on = math.log1p(-(ends + 1) / (n + 2))

    def marginal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(scores)
        for pdf in batches:
            found = lattice.marginals(MARK + bytes(w) for w in pdf["word"])
            p = [p + go_on if w else end for w, p in zip(pdf["word"], found)]
            yield pd.DataFrame({"word": pdf["word"], "c": pdf["c"], "logp": np.array(p, float) / math.log(10)})

    logs = words.mapInPandas(marginal, "word binary, c long, logp double")
    seen = word_postings(docs, True).drop("c").join(logs, "word", "left").select("chunk", "c", "logp", "posts")

    def total(group: pa.Table) -> pa.Table:
        # stays in Arrow: a Python object for each word of a chunk, and copies of them, took most of a worker's memory
        lone = pc.is_null(group["logp"])
        head = group["posts"].filter(lone)[0].as_py()
        nd = len(head) // 18
        ids, valid = np.frombuffer(head, np.int64, nd), np.frombuffer(head, np.uint8, nd, 8 * nd).astype(bool)
        held, sizes = np.frombuffer(head, np.uint8, nd, 9 * nd).astype(bool), np.frombuffer(head, np.int64, nd, 10 * nd)
        rows = group.select(["c", "logp", "posts"]).filter(pc.invert(lone)).sort_by([("c", "ascending"), ("logp", "ascending")])
        posts = pa.concat_arrays(rows["posts"].cast(pa.binary()).chunks)
        off = np.frombuffer(posts.buffers()[1], np.int32)[posts.offset : posts.offset + len(posts) + 1]
        e, times = np.frombuffer(posts.buffers()[2], np.uint32)[off[0] // 4 : off[-1] // 4], np.diff(off) // 4
        doc, tf = (e & 0xFFFF).astype(np.int64), (e >> 16).astype(np.float64)
        c, p = rows["c"].to_numpy(), rows["logp"].to_numpy()
        uses = lambda x: np.bincount(doc, weights=tf * np.repeat(x, times), minlength=nd)
        columns = {"doc_id": pa.array(ids, mask=~valid), "held_out": held, "n_tokens": sizes, "n_known": uses(c > 0).astype(np.int64), "train_tokens": np.full(nd, n, np.int64), "base_score": uses(np.log10((c + 1) / (n + v + 1))), "score": uses(p)}
        return pa.table(columns)

    return seen.groupBy("chunk").applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
