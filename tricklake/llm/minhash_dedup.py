"""Near-duplicate detection by a signature-coordinate inverted join.

Documents with equal shingle sets form one class. Each class posts its MinHash
signature under every (coordinate, value) pair; pairs of classes that agree on
fewer coordinates than a threshold are skipped without looking at them: a class
with too few shared coordinates can match nothing, and the others post only the
rarest coordinates that any match must touch. Candidates that pass the collision
count are confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordIds, connected_components, discard, run_hashes, table, word_ids, written

COORDS = 48
#: Posting lists up to this length give all their pairs; longer ones go by leaders and blocks.
SHORT, LEADERS, BLOCK = 16, 4, 512


def match_threshold(similarity: float, coords: int = COORDS) -> int:
    """Matches that a pair of the given similarity misses with a probability under 1e-7 (5.5 standard deviations below the mean)."""
    return max(1, math.floor(coords * similarity - 5.5 * math.sqrt(coords * similarity * (1 - similarity))))


def _hashers(coords: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240601)
    return rng.integers(1, 2**63, coords, dtype=np.uint64) | np.uint64(1), rng.integers(1, 2**63, coords, dtype=np.uint64)


def shingle_set(text: str | None, k: int, memo: WordIds) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of the text, A-Z lower-cased; fewer words: the whole sequence as one; none: empty."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = word_ids(words, memo)
    n = len(words)
    return np.unique(run_hashes(ids, k, 7)) if n >= k else run_hashes(ids, n, 7 + n)


def _signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for lo in range(0, len(s), 2048):
        out = np.minimum(out, ((s[lo : lo + 2048, None] * a + b) >> np.uint64(32)).min(axis=0))
    return out


def sketches(docs: DataFrame, k: int, coords: int = COORDS, with_sets: bool = False) -> DataFrame:
    """Per row: doc_id, n_shingles, digest (of the set, null when empty), keys (coordinate and value in one long) and, if asked for, the set."""
    a, b = _hashers(coords)
    base = np.arange(coords, dtype=np.uint64) << np.uint64(32)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordIds()
        for batch in batches:
            n, digests, keys, sets = [], [], [], []
            for text in batch["text"].to_pylist():
                s = shingle_set(text, k, memo)
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if with_sets:
                    sets.append(s.tobytes())
                else:
                    keys.append((_signature(s, a, b) | base).view(np.int64) if len(s) else None)
            last = pa.array(sets, pa.binary()) if with_sets else pa.array(keys, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), last], ["doc_id", "n_shingles", "digest", "sets" if with_sets else "keys"])

    last = "sets binary" if with_sets else "keys array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, f"doc_id long, n_shingles long, digest binary, {last}")


def _confirm(num: int, den: int):
    """Pairs grouped by a: keep those whose sets reach the similarity num/den."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["sets"], pdf["other"]):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return rows


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs(a, b) whose full shingle sets have den * intersection >= num * union."""
    one = sets.select(F.col("rep").alias("a"), "sets")
    two = sets.select(F.col("rep").alias("b"), F.col("sets").alias("other"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "sets", "other").mapInPandas(_confirm(num, den), "a long, b long")


def _cross(num: int, den: int):
    """A block of strays against a block of one posting list: a spanning forest of the links between different components.

    All intersections come from products of 0/1 matrices over the shingles that
    both blocks hold, so the block is compared whole and few rows leave it.
    """

    def links(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        ls, rs = ([np.frombuffer(x, np.uint64) for x in side["sets"]] for side in (left, right))
        ln, rn = np.array([len(x) for x in ls]), np.array([len(x) for x in rs])
        lv, rv = np.concatenate(ls), np.concatenate(rs)
        common = np.intersect1d(lv, rv)
        rows = []
        for v, n in ((lv, ln), (rv, rn)):
            at = np.minimum(np.searchsorted(common, v), len(common) - 1) if len(common) else np.zeros(len(v), int)
            hit = common[at] == v if len(common) else np.zeros(len(v), bool)
            rows.append((np.repeat(np.arange(len(n)), n)[hit], at[hit]))
        both = np.zeros((len(ls), len(rs)), np.float32)
        for lo in range(0, len(common), 4096):
            m = []
            for (r, c), n in zip(rows, (len(ls), len(rs))):
                x = np.zeros((n, min(4096, len(common) - lo)), np.float32)
                inside = (c >= lo) & (c < lo + 4096)
                x[r[inside], c[inside] - lo] = 1
                m.append(x)
            both += m[0] @ m[1].T
        both = both.astype(np.int64)
        linked = (den * both >= num * (ln[:, None] + rn[None, :] - both)) & (left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :])
        up: dict = {}

        def root(x):
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        lc, rc, li, ri = left["component"].tolist(), right["component"].tolist(), left["rep"].tolist(), right["rep"].tolist()
        out = []
        for i, j in zip(*np.nonzero(linked)):
            p, q = root(lc[i]), root(rc[j])
            if p != q:
                up[max(p, q)] = min(p, q)
                out.append((li[i], ri[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return links


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, coords: int = COORDS) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Documents are linked when den * |A and B| >= num * |A or B| for their sets of
    distinct k-word shingles; component_id is the smallest doc_id reachable by
    links. Texts that are null or without words have no shingles and no links. A
    null doc_id links with nothing: its component_id is null and it is kept. Rows
    that repeat a doc_id are one vertex. Equal sets are linked whatever their
    texts. Texts of any length are taken whole; an empty table gives no rows. Other columns are ignored.
    """
    least = match_threshold(num / den, coords)
    prefix = coords - least + 1
    sketch = written(sketches(docs, k, coords), "sketches")
    members = sketch.where("digest is not null and doc_id is not null")
    classes = members.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = written(members.join(classes, "digest").where("doc_id = rep").groupBy("digest").agg(F.first("rep").alias("rep"), F.first("keys").alias("keys")), "reps")

    posts = reps.select("rep", F.explode("keys").alias("key"))
    common = posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = posts.join(common, "key").groupBy("rep").agg(F.collect_set(F.struct("df", "key")).alias("found")).where(F.size("found") >= least)
    # of the prefix, the coordinates of one document alone come first, as the rarest
    alone = F.lit(coords) - F.size("found")
    entries = written(
        shared.select("rep", F.explode(F.slice(F.sort_array("found"), F.lit(1), F.greatest(F.lit(0), F.lit(prefix) - alone))).alias("e")).select("rep", "e.key"), "postings"
    )
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = entries.join(sizes, "key")
    lists = sized.where(F.col("size") <= SHORT).groupBy("key").agg(F.sort_array(F.collect_set("rep")).alias("reps"))
    short = lists.select("reps", F.posexplode("reps").alias("i", "a")).select("a", F.explode(F.slice("reps", F.col("i") + 2, F.lit(SHORT))).alias("b"))
    long = sized.where(F.col("size") > SHORT)
    leaders = long.groupBy("key", F.pmod(F.xxhash64("rep"), F.lit(LEADERS)).alias("salt")).agg(F.min("rep").alias("leader")).groupBy("key").agg(F.collect_set("leader").alias("leaders"))
    star = long.join(leaders, "key").select("rep", F.explode("leaders").alias("leader")).where("rep <> leader")
    pairs = short.unionByName(star.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b"))).distinct()
    keys = reps.join(entries.select("rep").distinct(), "rep", "left_semi")
    one, two = keys.select(F.col("rep").alias("a"), F.col("keys").alias("ka")), keys.select(F.col("rep").alias("b"), F.col("keys").alias("kb"))
    hits = F.aggregate(F.zip_with("ka", "kb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    pairs = pairs.join(one, "a").join(two, "b").where(hits >= least).select("a", "b")

    holders = entries.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(holders, "doc_id", "left_semi")
    sets = sketches(texts, k, coords, with_sets=True).join(reps.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    sets = written(sets.groupBy(F.col("doc_id").alias("rep"), "digest").agg(F.first("sets").alias("sets")).select("rep", "sets"), "sets")
    links = written(confirmed(pairs, sets, num, den), "links")
    first = connected_components(links)

    # what the leaders left over in long lists: everything outside a list's largest component against the whole list
    placed = written(long.join(first.withColumnRenamed("v", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component")), "placed")
    by = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    open_lists = by.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    block = lambda n: F.floor((n + BLOCK - 1) / BLOCK).cast("int")
    left_over = placed.join(open_lists.select("key", F.col("top.component").alias("major"), "n", (F.col("n") - F.col("top.n")).alias("strays")), "key")
    hashed = F.xxhash64("rep", F.lit(3))
    strays = left_over.where("component <> major").select("key", F.pmod(hashed, block(F.col("strays"))).alias("i"), F.explode(F.sequence(F.lit(0), block(F.col("n")) - 1)).alias("j"), "rep", "component")
    everyone = left_over.select("key", F.explode(F.sequence(F.lit(0), block(F.col("strays")) - 1)).alias("i"), F.pmod(hashed, block(F.col("n"))).alias("j"), "rep", "component")
    fresh = lambda x: x.join(sets, "rep").select(*(F.col(c).cast(t).alias(c) for c, t in (("key", "long"), ("i", "long"), ("j", "long"), ("rep", "long"), ("component", "long"), ("sets", "binary"))))
    cells = [fresh(x).groupBy("key", "i", "j") for x in (strays, everyone)]
    more = written(cells[0].cogroup(cells[1]).applyInPandas(_cross(num, den), "a long, b long"), "more-links")
    final = connected_components(links.unionByName(more)) if more.limit(1).count() else first
    discard(reps, entries, sets, links, placed, more)

    named = classes.join(final.withColumnRenamed("v", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return sketch.join(named, "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)
