"""Exact top-k inner-product search by aggregation without random access.

Candidates come in blocks; a block keeps, per dimension, the list of its rows by
component. A query reads all lists in step from their better ends; what has been
read bounds each row's score from below and above. Reading stops when no row outside the best k can
still qualify; the final scores are the partial sums and what is unread of the best rows. The k-th best score that a query has
reached is passed on from block to block, so that later blocks are read less far.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rows of a candidate block, of a stripe of blocks that one task reads one after the other, and of a query block.
BLOCK_ROWS, STRIPE_ROWS, QUERY_ROWS = 4096, 16_384, 4096
#: A step reads a list's n-th part; bounds of all open rows are only made when some of a few rows have closed; from so few open rows on others are passed over.
STEPS, PROBE, FEW = 16, 64, 512


class SortedLists:
    """A block of integer vectors as one sorted list a dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.up = np.argsort(self.rows, axis=0, kind="stable").T.copy()  # (dimension, place): row, smallest component first
        self.values = np.take_along_axis(self.rows.T, self.up, 1).astype(np.float64)
        # (end, dimension, row): how many entries come before the row's, from the top and from the bottom of the list
        place = np.argsort(self.up, axis=1).astype(np.int32)
        self.place = np.stack([len(rows) - 1 - place, place])
        self.probe = np.random.default_rng(0).permutation(len(self.rows))[:PROBE]

    def top(self, query: np.ndarray, k: int, bar: float = -np.inf, without: int | None = None) -> tuple[np.ndarray, np.ndarray, float]:
        """The k best (ids, scores) that reach the bar, and the share of the lists that was read; ties go to the smaller id.

        A row's score is at least what is read of it plus the worst of each list where it is unread, and at most
        that plus the value which each such list has come to. Rows that cannot reach the bar or the k-th lower bound are closed; with k rows or fewer
        open, no other can qualify. without: an id that takes no part. Sums of whole numbers below 2**53 are exact.
        """
        n = len(self.rows)
        plus, minus = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        used = np.r_[plus, minus]
        q = query[used].astype(np.float64)
        open_rows = np.arange(n) if without is None else np.flatnonzero(self.ids != without)
        if not n or not len(open_rows):
            return self.ids[:0], np.empty(0, np.int64), 0.0
        place = self.place[np.r_[np.zeros(len(plus), int), np.ones(len(minus), int)], used]
        # better end first: from the top of the list for positive weights, from the bottom for negative ones
        end = lambda at: np.r_[self.values[plus, n - 1 - at], self.values[minus, at]] * q
        worst, read, at, step, probe = end(n - 1), np.zeros(n), 0, max(16, -(-n // STEPS)), place[:, self.probe]
        slack = 1e-5 * np.abs(np.stack([worst, end(0)])).sum()  # more than sums in single precision lose
        parts = None  # the components of a few open rows
        while at < n and len(q) and len(open_rows) > k:
            last, at = at, min(at + step, n)
            edge = end(at - 1)
            if parts is None:
                rows = np.concatenate([self.up[plus, n - at : n - last], self.up[minus, last:at]])
                gain = np.concatenate([self.values[plus, n - at : n - last], self.values[minus, last:at]]) * q[:, None]
                read += np.bincount(rows.ravel(), gain.ravel(), n)
                if bar > -np.inf and (read[self.probe] + edge @ (probe >= at)).min() >= bar:
                    continue
                both = np.stack([worst, edge]).astype(np.float32) @ (place[:, open_rows] >= at).astype(np.float32)
                lower, upper = read[open_rows] + both[0] - slack, read[open_rows] + both[1] + slack
            else:
                unread = place[:, open_rows] >= at
                seen = (parts * ~unread).sum(0)
                lower, upper = seen + worst @ unread, seen + edge @ unread
            bar = max(bar, np.partition(lower, len(lower) - k)[len(lower) - k])
            still = upper >= bar
            open_rows, parts = open_rows[still], parts if parts is None else parts[:, still]
            if parts is None and len(open_rows) <= FEW:
                parts = self.rows[open_rows][:, used].T * q[:, None]
        # partial sums and what is unread of the rows that are open
        if parts is None:
            parts = self.rows[open_rows][:, used].T * q[:, None]
        scores = parts.sum(0).astype(np.int64)
        open_rows, scores = open_rows[scores >= bar], scores[scores >= bar]
        best = np.lexsort((self.ids[open_rows], -scores))[:k]
        return self.ids[open_rows][best], scores[best], at / n


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) per component; rows without id or vector, or with null or non-finite components, are left out.

    Rows that repeat an id count once, with their smallest vector.
    """
    x = F.transform(embedding, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """vectors(vec_id, v array<long>) -> query_id, rank, vec_id, score of each query's k best rows, its own excepted.

    Score: inner product, a missing component of a shorter vector counting as 0; ties go
    to the smaller id; fewer candidates than k give fewer rows, an empty table none. A null is_query is no query; other columns
    are left out. A stripe of candidates meets a block of queries in one task; of each meeting only k rows a query go on.
    """
    n = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    stripes, groups = max(1, -(-n[0] // STRIPE_ROWS)), max(1, -(-n[1] // QUERY_ROWS))
    place = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    queries = vectors.where(is_query).select(place(groups).alias("g"), every(stripes).alias("b"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    rows = vectors.select(every(groups).alias("g"), place(stripes).alias("b"), "vec_id", "v")
    block_rows = BLOCK_ROWS

    def padded(vs: list, width: int) -> np.ndarray:
        out = np.zeros((len(vs), width), np.int64)
        for i, v in enumerate(vs):
            out[i, : len(v)] = v
        return out

    def meet(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        if not len(qs) or not len(cs):
            return none
        width = max(max(map(len, qs["q"])), max(map(len, cs["v"])), 1)
        query_ids, q = qs["query_id"].to_numpy(np.int64), padded(qs["q"].tolist(), width)
        ids, scores = [np.empty(0, np.int64)] * len(q), [np.empty(0, np.int64)] * len(q)
        for lo in range(0, len(cs), block_rows):
            block = cs.iloc[lo : lo + block_rows]
            lists = SortedLists(block["vec_id"].to_numpy(np.int64), padded(block["v"].tolist(), width))
            for i, query_id in enumerate(query_ids):
                bar = scores[i][-1] if len(scores[i]) == k else -np.inf
                new, s, _ = lists.top(q[i], k, bar, query_id)
                new, s = np.r_[ids[i], new], np.r_[scores[i], s]
                best = np.lexsort((new, -s))[:k]
                ids[i], scores[i] = new[best], s[best]
        sizes = [len(x) for x in ids]
        return pd.DataFrame({"query_id": np.repeat(query_ids, sizes), "vec_id": np.concatenate(ids), "score": np.concatenate(scores)}) if sum(sizes) else none

    best = queries.groupBy("g", "b").cogroup(rows.groupBy("g", "b")).applyInPandas(meet, "query_id long, vec_id long, score long")
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k)
    return best.groupBy("query_id").agg(ordered.alias("best")).select("query_id", F.posexplode("best").alias("i", "b")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.minus")).alias("score"))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
