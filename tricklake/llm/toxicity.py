"""Toxic passages by maximum-scoring segments over token log-odds.

Log-odds of tokens in toxic and clean labelled documents, shrunk by an informative
Dirichlet prior, weigh each token of a text; a linear-time scan finds every maximal-scoring segment. The score
of a segment is calibrated by an extreme-value law fitted on clean documents (expected number of as good segments by chance), and
the passages of a text are aggregated to one probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Labelled documents that the model is fitted on at most (the first by md5 of their id); what it holds and what reaches the driver is bounded by them.
FIT_ROWS = 16_000
PRIOR, LEAST_Z, DRIFT, SIGNIFICANT = 0.05, 4.0, 0.15, 0.01
STEMS = range(3, 11)
#: Bytes of the words whose weights a worker remembers.
MEMO_BYTES = 40_000_000
_SPLIT = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """A-Z lower-cased; ASCII letters, digits and all other characters but ASCII ones make up tokens."""
    return (text or "").encode().lower().translate(_SPLIT).split()


def stems(word: bytes) -> list[str]:
    """What can give a token its weight: the word itself, and its beginnings, as words are inflected."""
    text = word.decode("utf-8", "replace")
    return [text, *(text[:k] + "*" for k in STEMS if len(text) > k)]


def maximal_segments(items: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence whose listed positions have a score and all others -drift; one pass, linear."""
    stack: list[list] = []  # left sum, right sum, start, end, index of the nearest earlier one with a smaller left sum
    total, last = 0.0, -1
    for pos, s in items:
        total -= drift * (pos - last - 1)
        last = pos
        if s <= 0:
            total += s
            continue
        new = [total, total + s, pos, pos + 1, -1]
        total += s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= new[0]:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= new[1]:
                new[4] = j
                stack.append(new)
                break
            new[0], new[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - x) for x, r, a, b, _ in stack]


@dataclass
class ToxicityModel:
    """Weights (log-odds, z) of words and stems, the extreme-value law (rate and log of the constant) and the final logistic curve."""

    weights: dict[str, tuple[float, float]]
    rate: float = 1.0
    log_k: float = 0.0
    #: without labels of both kinds nothing is called toxic
    curve: tuple[float, ...] = (-4.0, 0.0, 0.0)

    def __post_init__(self):
        self.memo: dict[bytes, float | None] = {}
        self.held = 0

    def weight(self, word: bytes) -> float | None:
        """Log-odds of the surest of the word's stems; a memo of MEMO_BYTES at most and one word."""
        if word not in self.memo:
            self.held += len(word) + 100
            if self.held > MEMO_BYTES:
                self.memo.clear()
                self.held = len(word) + 100
            known = [w for s in stems(word) if (w := self.weights.get(s))]
            self.memo[word] = max(known, key=lambda w: abs(w[1]))[0] if known else None
        return self.memo[word]

    def hits(self, words: list[bytes]) -> list[tuple[int, float]]:
        memo, weight = self.memo, self.weight
        return [(i, s) for i, w in enumerate(words) if (s := memo[w] if w in memo else weight(w)) is not None]

    def segments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        return maximal_segments(self.hits(words), DRIFT)

    def log10_e(self, score: float, n: int) -> float:
        """log10 of the number of segments of at least this score to be expected in n clean tokens."""
        return (self.log_k + math.log(max(n, 1)) - self.rate * score) / math.log(10)

    def features(self, words: list[bytes]) -> tuple[list[tuple[int, int, float]], float, float]:
        """Significant passages (start, end, log10 E), evidence of the best segment, number of significant ones."""
        found = [(a, b, self.log10_e(s, len(words))) for a, b, s in self.segments(words)]
        return [x for x in found if x[2] <= math.log10(SIGNIFICANT)], *self.evidence([e for _, _, e in found], len(words))

    def evidence(self, log10_e: list[float], n: int) -> tuple[float, float]:
        """Of the best of n tokens' segments, a text without any counting as one of score 0, and of the number of significant ones: on a scale that is linear near 0 and logarithmic beyond, without end."""
        many = sum(e <= math.log10(SIGNIFICANT) for e in log10_e)
        return math.asinh(-min(log10_e, default=self.log10_e(0.0, n))), math.log1p(many)

    def probability(self, best: float, many: float) -> float:
        z = self.curve[0] + self.curve[1] * best + self.curve[2] * many
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def _log_odds(fit: DataFrame, units) -> dict[str, tuple[float, float]]:
    """(log-odds, z) of those units of the documents' token sets whose z is large; a unit counts once a document."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = (Counter(), Counter())
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                c[int(toxic)].update({u for w in set(tokens(text)) for u in units(w)})
        both = list(c[0].keys() | c[1].keys())
        for lo in range(0, len(both), 50_000):
            part = both[lo : lo + 50_000]
            yield pd.DataFrame({"unit": part, "clean": [c[0][w] for w in part], "toxic": [c[1][w] for w in part]})

    by = written(fit.mapInPandas(count, "unit string, clean long, toxic long").groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "tokens")
    n0, n1 = by.agg(F.coalesce(F.sum("clean"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n0 or not n1:
        return {}
    prior = PRIOR * (F.col("clean") + F.col("toxic"))
    mass = PRIOR * (n0 + n1)
    odds = F.log((F.col("toxic") + prior) / (n1 + mass - F.col("toxic") - prior)) - F.log((F.col("clean") + prior) / (n0 + mass - F.col("clean") - prior))
    z = odds / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    rows = by.select("unit", odds.alias("odds"), z.alias("z")).where(F.abs("z") >= LEAST_Z).collect()  # of the fitted documents' tokens
    return {r.unit: (float(r.odds), float(r.z)) for r in rows}


def _token_weights(fit: DataFrame) -> dict[str, tuple[float, float]]:
    """Weights of words, then of the stems of all other words."""
    words = _log_odds(fit, lambda w: stems(w)[:1])
    return _log_odds(fit, lambda w: [] if (s := stems(w))[0] in words else s[1:]) | words


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton steps with a small ridge; x has a leading column of ones."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        ridge = 0.01 * np.eye(len(b))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, b))


def fit_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """docs(doc_id, text), labels(doc_id, toxic): fitted on at most fit_rows labelled documents, so what reaches the driver is bounded.

    A document labelled more than once is toxic if any label says so; null labels and null ids don't count, null texts are left out. Rows that repeat a doc_id count each.
    Of the weights of a token's beginnings the surest is taken, of equally sure ones the longest. Without labels of both kinds, as in an empty table, nothing is called toxic. Other columns are ignored.
    """
    sample = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(fit_rows)
    fit = written(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").select("text", "toxic"), "fit")
    model = ToxicityModel(_token_weights(fit))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [tokens(t) for t in pdf["text"]]
            best = [max((s for _, _, s in model.segments(w)), default=0.0) for w in words]
            yield pd.DataFrame({"toxic": pdf["toxic"].astype(int), "n": [len(w) for w in words], "best": best, "hits": [sum(h > 0 for _, h in model.hits(w)) for w in words]})

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [model.features(tokens(t))[1:] for t in pdf["text"]]
            yield pd.DataFrame({"toxic": pdf["toxic"].astype(int), "best": [b for b, _ in x], "many": [m for _, m in x]})

    seen = fit.mapInPandas(scan, "toxic int, n long, best double, hits long").toPandas()
    clean = seen[seen["toxic"] == 0]
    if len(clean) and len(seen) > len(clean):
        # rate: a clean token's weights w solve E[exp(rate * w)] = 1, the default being -DRIFT
        p = (clean["hits"].sum() + 0.5) / (clean["n"].sum() + 1.0)
        up = [w for w, _ in model.weights.values() if w > 0]
        mean = float(np.mean(up)) if up else 1.0
        lo, hi = 1e-3, 10.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if p * math.exp(mid * mean) + (1 - p) * math.exp(-mid * DRIFT) > 1 else (mid, hi)
        model.rate = (lo + hi) / 2
        x = model.rate * clean["best"].to_numpy() - np.log(np.maximum(clean["n"].to_numpy(), 1))
        model.log_k = float(x.mean()) - 0.5772156649015329
        seen = fit.mapInPandas(weigh, "toxic int, best double, many double").toPandas()
        model.curve = _logistic(np.column_stack([np.ones(len(seen)), seen[["best", "many"]].to_numpy()]), (seen["toxic"] > 0).to_numpy(float))
    return model


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, score (0 to 1), passages (start and end in tokens, log10 of the expected number, the words).

    Null and empty texts have no tokens and get the score of a text without any
    hit. Each row is scored by its whole text alone, however long; repeated rows get equal scores, null doc_ids stay. An empty table gives no rows, other columns are left out.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores, passages = [], []
            for text in pdf["text"]:
                words = tokens(text)
                found, best, many = model.features(words)
                scores.append(model.probability(best, many))
                passages.append([{"start": a, "end": b, "log10_e": e, "words": b" ".join(words[a:b]).decode("utf-8", "replace")} for a, b, e in found])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": scores, "passages": passages})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(rows, "doc_id long, score double, passages array<struct<start:int,end:int,log10_e:double,words:string>>")


def toxic_score(text: Column, model: ToxicityModel) -> Column:
    """The score alone, as a column."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.probability(*model.features(tokens(t))[1:]) for t in texts], dtype=float)

    return score(text)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    model = fit_model(docs, table(spark, sf_dir, "labels").where(~held))
    return toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
