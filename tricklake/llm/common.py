"""Shared helpers: scratch tables, word rules, window hashes, connected components."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..sources.folders import remove, shared_folder

#: Words are maximal runs of anything but the six ASCII white-space characters; bytes.split() splits at the same six.
WORD = r"[^\x20\x09-\x0D]+"
_MUL1, _MUL2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def scratch(spark: SparkSession, name: str) -> str:
    """A path that nothing has used before, in the folder that driver and executors share."""
    return shared_folder(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that written() made and nothing reads any more; other frames are left alone."""
    for df in tables:
        if path := getattr(df, "scratch", None):
            remove(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(df: DataFrame, least: int = 1) -> int:
    """Partitions for a keyed shuffle: those of the session or of the input, whichever are more."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


class WordIds(dict):
    """64-bit id of a word (bytes) under a seed; a bounded memo in front of the hash."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h


def word_ids(words: list[bytes], memo: WordIds) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def _mix(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of the pair (a, b), order kept."""
    h = (a + np.uint64(seed)) * _MUL1
    h ^= h >> np.uint64(32)
    h = (h + b) * _MUL2
    h ^= h >> np.uint64(29)
    h *= _MUL1
    h ^= h >> np.uint64(32)
    return h


def run_hashes(ids: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive ids, by doubling; len(ids) - k + 1 values (none if there are fewer ids)."""
    n = len(ids)
    if n < k:
        return np.empty(0, np.uint64)
    h, size = ids, 1
    while size * 2 <= k:
        h = _mix(h[:-size], h[size:], seed + size)
        size *= 2
    if size < k:
        m = n - k + 1
        h = _mix(h[:m], h[k - size : k - size + m], seed + 1000 + k)
    return h[: n - k + 1]


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    m, size = values, 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < w:
        m = np.minimum(m[: len(values) - w + 1], m[w - size :])
    return m


def connected_components(links: DataFrame) -> DataFrame:
    """Components of the graph of links(a, b): rows (v, component), component being the smallest vertex reachable."""
    return components(links, scratch(links.sparkSession, "cc"))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df, written, with a dense index 0, 1, 2 ... by order (nulls first, strings bytewise); rows that tie are numbered in any order.

    A range sort deals the rows out, each keeps its place in its partition, and only the partitions' sizes, a row each, come to the driver. No task sees all rows.
    Rows that tie in all of order are spread by a random number, so a third of all rows may tie; the number is written with its row before the sort, so a task that is run again deals its rows out as before.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in order]
    base = written(df.withColumn("_tie", F.rand(11)), "unranked")
    spread = base.repartitionByRange(shuffle_parts(df), *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    placed = written(spread.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    discard(base)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    starts, total = [], 0
    for p, n in sorted(map(tuple, placed.groupBy(part.alias("p")).count().collect())):
        starts.append((p, total))
        total += n
    begin = spark.createDataFrame(starts, "_p long, _start long")  # a row for each partition of the sort
    return placed.withColumn("_p", part).join(F.broadcast(begin), "_p").withColumn(name, F.col("_start") + place).drop("_p", "_start", "_at")
