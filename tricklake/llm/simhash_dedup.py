"""Near-duplicate detection by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint takes part in one table for each mask of a family that covers the radius: every position has a
code of radius + 1 bits, and mask v holds the positions whose code has an odd product with v. Positions in
which two fingerprints differ, radius of them at most, leave some v that is orthogonal to all their codes, so that
mask avoids them all and the two meet in its table: no pair within the radius is missed.

Fingerprints that are many in one bucket agree on its mask and are dealt on by a covering of the positions outside
it. Positions run out, so every bucket comes down to a bounded size, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, discard, table, written

BITS = 64
#: Fingerprints of a bucket that one task compares; fuller buckets are dealt on. Not below 2**radius.
MOST = 4096
#: Shingle hashes that are counted at once: a multiple of 255, up to which counts fit a byte.
_BLOCK = 255 * 64


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def covering_masks(radius: int, within: int = (1 << BITS) - 1) -> list[int]:
    """Masks inside `within` (a set of positions as bits) of which, for any radius positions, one at least holds none."""
    units = [1 << i for i in range(radius + 1)]
    codes = units + [c for c in range(1, 1 << (radius + 1)) if c not in units]
    positions = [p for p in range(BITS) if within >> p & 1]
    masks = set()
    for v in range(1, 1 << (radius + 1)):
        masks.add(sum(1 << p for i, p in enumerate(positions) if (codes[i % len(codes)] & v).bit_count() & 1))
    return sorted(masks)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 with seed 42 of each run of k words joined by one space, A-Z lower-cased; fewer words: of the whole sequence; none: empty."""
    words = (text or "").encode().lower().split()
    n = max(len(words) - k + 1, 1)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1  # of each word in joined
    starts = np.r_[0, ends[:-1] + 1]
    last = ends[min(k, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Fingerprint: the bits that are set in over half the hashes; 0 without any."""
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[lo : lo + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        ones += bits[:full].reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[full:].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's text as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((majority(shingle_hashes(t, k)) for t in batch["text"].to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, fp long")


def spanning_forest(prints: list[int], radius: int) -> list[tuple[int, int]]:
    """Links within the radius that connect what all such links of the bucket connect, at most one fewer than prints."""
    out, left = [], np.array(prints, np.int64)
    while len(left) > 1:
        open_, left = [int(left[0])], left[1:]
        while open_ and len(left):
            x = open_.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= radius
            if near.any():
                found = left[near].tolist()
                out += [(x, y) for y in found]
                open_ += found
                left = left[~near]
    return out


def _forests(radius: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [x for prints in batch["fps"].to_pylist() for x in spanning_forest(prints, radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows


def links_within(prints: DataFrame, radius: int, most: int = MOST) -> DataFrame:
    """prints(fp), distinct -> (a, b): pairs within the radius which connect all that are connected by such pairs."""
    if most < 1 << radius:
        raise ValueError("a bucket must be allowed 2**radius fingerprints")
    spark, tables = prints.sparkSession, []

    def keep(df: DataFrame, name: str) -> DataFrame:
        tables.append(written(df, name))
        return tables[-1]

    open_, masks = prints.select("fp", F.lit(0).cast("long").alias("mask")), [0]
    found = []
    while masks:
        cover = [(m, _signed(m % (1 << BITS) | sub)) for m in masks for sub in covering_masks(radius, ~m % (1 << BITS))]
        if masks == [0]:
            dealt = open_.withColumn("next", F.explode(F.array(*(F.lit(x).cast("long") for _, x in cover))))
        else:  # 2**(radius + 1) - 1 rows a mask, whatever the data
            dealt = open_.join(F.broadcast(spark.createDataFrame(cover, "mask long, next long")), "mask")
        posts = dealt.select("fp", F.col("next").alias("mask"), F.col("fp").bitwiseAND(F.col("next")).alias("key"))
        if masks != [0]:
            posts = posts.distinct()  # two masks may have the same next one
        sizes = keep(posts.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
        found.append(keep(sizes.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b").distinct(), "pairs"))
        full = posts.join(sizes.where("n > 2").select("mask", "key", "n"), ["mask", "key"])
        lists = full.where(F.col("n") <= most).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        found.append(keep(lists.select("fps").mapInArrow(_forests(radius), "a long, b long").distinct(), "links"))
        masks = [r.mask for r in sizes.where(F.col("n") > most).select("mask").distinct().collect()]  # masks, not buckets: 31, 961 ... at radius 4
        open_ = keep(full.where(F.col("n") > most).select("fp", "mask"), "open") if masks else None
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = written(out.distinct(), "links")
    discard(*tables)
    return out


def simhash_duplicates(docs: DataFrame, k: int = 5, radius: int = 4) -> DataFrame:
    """docs(doc_id, text, ...) -> one row per row: doc_id, fp (signed long), component_id.

    Rows are linked when their fingerprints differ in radius bits or fewer; component_id is the smallest doc_id
    reachable. Rows of one fingerprint are one vertex from the start, so copies are never paired. Texts that are null, empty or without words have
    fingerprint 0 and are linked like others. A row without doc_id is linked too; its component_id is the smallest doc_id that it reaches, null if
    there is none. Rows that repeat a doc_id are rows of their own. Whole texts; other columns are ignored; an empty table gives no rows.
    """
    prints = written(fingerprints(docs, k), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    links = links_within(classes.select("fp"), radius)
    parts = connected_components(links)
    named = classes.join(parts.withColumnRenamed("v", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("part"), "first")
    firsts = named.groupBy("part").agg(F.min("first").alias("component_id"))
    of_print = written(named.join(firsts, "part").select("fp", "component_id"), "components")
    discard(links, classes)
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def op11_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash_duplicates(table(spark, sf_dir, "documents"), k=4, radius=4)
    return done.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
