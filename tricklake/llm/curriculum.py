"""Mixing sources to target weights along a time-varying curriculum.

Each source's weight changes linearly over training time. Its integral is the
source's demand up to a time; inverting it gives the training position of each of the source's words, so documents get
the time interval in which the mix consumes them, and are range-sorted by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

#: Weights of the sources in code-point order, repeating; schedule slopes likewise: a source's weight goes from (1 - slope) to (1 + slope) times its mean.
WEIGHTS, SLOPES = (5, 2, 1), (-0.5, 0.0, 0.5)
SHARE, MOST = 1.5, 2
BIN_ROWS, FEW_SOURCES = 2000, 10_000


def _cycle(i: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (i % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes(source, size) of documents -> per source: source_size, target, weight, slope.

    Targets share `share` of all sizes by weight; none exceeds `most` times its
    source's size, the excess going to the others by weight until none is above.
    That is target = least(most * size, level * weight) for the level at which the
    sum fits: sources are ordered by the level at which they fill up, and running
    sums over that order give it. The windows run over one row a source.
    """
    by = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = by.withColumn("place", rank).select("source", "source_size", "n", _cycle(F.col("place"), weights).alias("weight"), _cycle(F.col("place"), slopes).alias("slope"), "place")
    full = F.col("source_size") * most / F.col("weight")
    order = Window.orderBy(full, "place")
    s = s.withColumn("need", F.sum("source_size").over(Window.partitionBy(F.lit(0))) * share)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("need") - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # the first source in that order which its level does not fill sets the level of all
    level = F.min(F.when(F.col("level") <= full, F.struct(full.alias("at"), F.col("place"), F.col("level"))))
    level = level.over(Window.partitionBy(F.lit(0)))["level"]
    return s.withColumn("water", level).select("source", "source_size", F.least(F.col("source_size") * float(most), F.coalesce(F.col("water") * F.col("weight"), F.col("source_size") * float(most))).alias("target"), "weight", "slope", "n")


def position(share: Column, slope: Column) -> Column:
    """Training time (0 to 1) at which a source has given the share (0 to 1) of its demand.

    The demand up to t is t * (1 - slope) + slope * t * t; this is its inverse.
    """
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(slope == 0, share).otherwise(F.try_divide(2 * share, (1 - slope) + root))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, share: float = SHARE, most: int = MOST) -> DataFrame:
    """docs(doc_id, text, source, ...) -> doc_id, size, source_size, target, taken, passes, and row: the input row as a struct.

    size: words of the text (null: 0). A source is read in a fixed shuffled order
    (md5 of the id), round after round, up to its target; taken is the words of
    the document that are read, the last document of the target in part. passes
    lists, per round that reads it, words and the training time at which it begins. Rows
    that repeat an id (null ids are one id) follow each other by size and md5 of the text. No
    source or a null source is a source like others, last in code-point order; a source without
    words takes nothing. An empty table gives none.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.struct(*docs.columns).alias("row"))
    d = d.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("tie", F.md5("text"))
    targets = source_targets(d.select("source", "size"), weights, slopes, share, most)
    # running sums without one task for a large source: bins of the shuffled order, sums of bins, then sums inside a bin
    # a source as a key without null; one row a source is broadcast if they are few, else the join is left to adaptive execution
    known = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))
    targets = written(targets.select(known.alias("part"), "source_size", "target", "slope", F.ceil(F.col("n") / BIN_ROWS).alias("bins")), "targets")
    d = d.withColumn("part", known).join(F.broadcast(targets) if targets.count() <= FEW_SOURCES else targets, "part")
    d = d.withColumn("bin", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("bins") / F.lit(2**32)))
    # source and bin as one key: partitioning by the source alone must not serve for it
    d = d.withColumn("cell", F.concat_ws("#", F.col("bin").cast("string"), "part"))
    sums = d.groupBy("part", "bin", "cell").agg(F.sum("size").alias("words"))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("part").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(sums.select("cell", ahead.alias("ahead")), "cell")
    inside = Window.partitionBy("cell").orderBy("key", "doc_id", "size", F.col("tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    d = d.withColumn("start", start).withColumn("whole", F.floor("target").cast("long"))
    words = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), F.col("whole") - k * F.col("source_size") - F.col("start")))
    when = lambda k: position(F.try_divide(k * F.col("source_size") + F.col("start"), F.col("target")), F.col("slope"))
    passes = F.filter(F.array(*[F.struct(words(k).cast("long").alias("words"), when(k).alias("position")) for k in range(most)]), lambda p: p["words"] > 0)
    return d.withColumn("passes", passes).select("doc_id", "size", "source_size", "target", F.aggregate("passes", F.lit(0).cast("long"), lambda s, p: s + p["words"]).alias("taken"), "passes", "source", "row")


def first_position(passes: Column) -> Column:
    """The training time at which a document is first read; null if it is not."""
    return F.try_element_at(passes, F.lit(1))["position"]


def in_order(rows: DataFrame, position: Column) -> DataFrame:
    """Rows range-sorted by a position, then by doc_id and size; rows without one come last. Equal positions may lie in several ranges, so none is hot."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.coalesce(position, F.lit(2.0)), F.col("doc_id"), F.col("size")]
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def schedule(mixed: DataFrame) -> DataFrame:
    """The training order: one row per reading (position, doc_id, size, words, row), range-sorted by position."""
    rows = mixed.select("doc_id", "size", "row", F.explode("passes").alias("p")).select("p.position", "doc_id", "size", "p.words", "row")
    return in_order(rows, F.col("position"))


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in training order, range-sorted by the position of their first reading."""
    mixed = mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", first_position(F.col("passes")).alias("first_position"))
    return in_order(mixed, F.col("first_position")).withColumn("first_position", F.round("first_position", 6))


ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, text, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + place % 3]::DOUBLE AS weight, [-0.5, 0.0, 0.5][1 + place % 3]::DOUBLE AS slope FROM s),
n AS (SELECT *, source_size * 2 / weight AS fill, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS need FROM w),
l AS (SELECT *, (need - coalesce(sum(source_size * 2) OVER (ORDER BY fill, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / sum(weight) OVER (ORDER BY fill, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n),
t AS (SELECT source, source_size, slope, least(source_size * 2.0::DOUBLE, coalesce((SELECT arg_min(level, (fill, place)) FROM l WHERE level <= fill) * weight, source_size * 2.0::DOUBLE)) AS target FROM l),
r AS (SELECT doc_id, size, source_size, target, slope, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size, md5(text) NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - start)) AS one, greatest(0, least(size, floor(target)::BIGINT - source_size - start)) AS two FROM r),
q AS (SELECT *, CASE WHEN one > 0 THEN start / target WHEN two > 0 THEN (source_size + start) / target END AS share FROM p)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
  round(CASE WHEN slope = 0 THEN share ELSE 2 * share / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) END, 6) AS first_position FROM q
"""
