"""Order MinHash fingerprints: sensitive to edit distance, not only to shared content.

A text's k-mers are numbered by occurrence, so each (k-mer, number) is distinct.
For each of M hash functions the L least of them are selected, put back into text
order and hashed as a tuple; two texts agree on a coordinate only if the selected
k-mers are the same and in the same order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import run_hashes, table

K, M, L = 6, 32, 2
_rng = np.random.default_rng(77)
_MULS = (_rng.integers(1, 2**63, M, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _numbered(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the occurrence-numbered k-mers, in text order; a text shorter than k is one k-mer."""
    k = min(K, len(codes))
    base = run_hashes(codes.astype(np.uint64), k, 11) if k > 1 else codes.astype(np.uint64) + np.uint64(1)
    bits = np.uint64(len(base).bit_length())
    s = np.sort((base >> bits << bits) | np.arange(len(base), dtype=np.uint64))  # by k-mer, then by place in the text
    place = s & ((np.uint64(1) << bits) - np.uint64(1))
    s >>= bits
    start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    number = np.empty(len(s), np.uint64)
    number[place] = np.arange(len(s)) - np.repeat(start, np.diff(np.r_[start, len(s)]))
    h = base ^ (number * np.uint64(0x9E3779B97F4A7C15))
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xD6E8FEB86659FD93)


def _least(h: np.ndarray) -> np.ndarray:
    """Positions (M, L) of the L least values under each hash function, in text order; ties go to the earlier position."""
    n = len(h)
    take = min(L, n)
    out = np.empty((M, take), np.int64)
    step = max(1, 400_000 // n)  # bounded memory for very long texts
    for lo in range(0, M, step):
        v = ((h[None, :] * _MULS[lo : lo + step, None]) >> np.uint64(32)).astype(np.uint32)
        rows = np.arange(len(v))
        for t in range(take):
            out[lo : lo + step, t] = at = v.argmin(axis=1)
            v[rows, at] = 0xFFFFFFFF
    out.sort(axis=1)
    return out


def signature(text: str) -> np.ndarray:
    """M 32-bit coordinates; those of the empty text are all 0."""
    if not text:
        return np.zeros(M, np.uint32)
    h = _numbered(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    picked = h[_least(h)]
    x = np.full(M, 0x51ED270B, np.uint64)
    for t in range(picked.shape[1]):
        x = (x ^ picked[:, t]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _show(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last floor(n/4) code points replaced by the first as many (or all) of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _ranges(cuts: list[int]):
    """Range of a doc_id: how many of the cuts lie below it; null ids come first."""

    @F.pandas_udf("int")
    def at(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, np.int64), ids.to_numpy(np.int64), "left").astype(np.int32))

    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(at(F.coalesce("doc_id", F.lit(0))))


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order -> each row with the one that follows in its range; a range's last row (ahead) only follows."""
    before = None
    for pdf in batches:
        out = []
        ids = [None if void else doc for doc, void in zip(pdf["doc_id"], pdf["doc_id"].isna())]
        for bucket, doc, text, ahead in zip(pdf["bucket"], ids, pdf["text"], pdf["ahead"]):
            sig = signature(text)
            if before is not None and before[0] == bucket:
                _, d, t, s = before
                new = edited(t, text)
                e = signature(new)
                out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), _show(s), _show(e), likeness(s, e), likeness(s, sig)))
            before = None if ahead else (bucket, doc, text, sig)
        out = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        yield out.astype({"doc_id": "Int64"})


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): the fingerprint of the text and of its edited text.

    The next document is the next by doc_id (null ids first; rows that repeat an id
    follow each other by text); after the last comes the first, and a single row
    follows itself. A null text counts as empty; the empty text's fingerprint is all
    zeros. Documents are range-partitioned by id once and streamed in order;
    the first row of each range is also sent to the range before it. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a few ranges for each partition of the shuffle: their number is the cluster's, not the data's
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(docs.where("doc_id is not null").agg(F.percentile_approx("doc_id", shares, 10 * ranges)).first()[0] or []))
    placed = docs.withColumn("bucket", _ranges(cuts))
    found = placed.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("void")).orderBy("bucket").collect()
    firsts = [(r.bucket, None if r.void else r.least) for r in found]
    to = [(firsts[i - 1][0], doc) for i, (_, doc) in enumerate(firsts)]
    ahead = F.broadcast(spark.createDataFrame(to, "to int, first long"))
    first = docs.join(ahead, F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("to", "doc_id").agg(F.min("text").alias("text"))
    rows = placed.select("bucket", "doc_id", "text", F.lit(False).alias("ahead")).unionByName(first.select(F.col("to").alias("bucket"), "doc_id", "text", F.lit(True).alias("ahead")))
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInPandas(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
