"""Stored tables: scans, upserts, compaction, read-through caches, record files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.canonical import keep_first

CACHE_SCHEMA = T.StructType(
    [T.StructField("PBN", T.StringType()), T.StructField("Dealer", T.StringType()), T.StructField("Vul", T.StringType()), T.StructField("DD", T.MapType(T.StringType(), T.ByteType())), T.StructField("ParScore", T.ShortType()), T.StructField("Probs_Trials", T.LongType())]
)


def save(df: DataFrame, path: str) -> DataFrame:
    """Write to a fresh folder below path and read it back; what df itself reads is never overwritten."""
    target = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def scan(spark: SparkSession, path: str, columns: list[str], where: Column | None = None, rows: int | None = None) -> DataFrame:
    """Projected, filtered scan; both reach Parquet. rows is the caller's own limit."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    df = df.select(*columns)
    return df if rows is None else df.limit(rows)


def narrow(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """NaN and null to 0, then the narrow type given for columns by name prefix (longest prefix first)."""
    def kind(c):
        return next((kinds[p] for p in sorted(kinds, key=len, reverse=True) if c.startswith(p)), None)

    out = {}
    for c, t in df.dtypes:
        if k := kind(c):
            x = F.nanvl(c, F.lit(None).cast(t)) if t in ("double", "float") else F.col(c)
            out[c] = F.coalesce(x, F.lit(0)).cast(k)
    return df.withColumns(out)


def require(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Check that columns are there and of the type given."""
    have = dict(df.dtypes)
    if wrong := {c: have.get(c) for c, t in types.items() if have.get(c) != t}:
        raise TypeError(f"expected {types}, found {wrong}")
    return df


def with_index(df: DataFrame, order: list[str], name: str = "index", bucket_rows: int = 100_000) -> DataFrame:
    """Dense index 0, 1, 2 ... by order, whose first column is integer and unique per row group.

    Counts of value ranges are summed first, and rows are numbered inside their range, so no task sees all rows.
    """
    from pyspark.sql import Window

    n = df.count()
    parts = max(1, n // bucket_rows)
    low, high = df.agg(F.min(order[0]), F.max(order[0])).first()
    width = max(1, (int(high or 0) - int(low or 0) + parts) // parts)
    d = df.withColumn("_b", F.floor((F.col(order[0]) - F.lit(int(low or 0))) / width))
    sizes = d.groupBy("_b").count().withColumn("_start", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.join(sizes.select("_b", "_start"), "_b")
    return d.withColumn(name, F.col("_start") + F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1).drop("_b", "_start")


def aligned_union(one: DataFrame, two: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """Union by name with columns sorted; missing columns are null, but required ones must be in both."""
    for c in required:
        if c not in one.columns or c not in two.columns:
            raise ValueError(f"column {c} must not be made up")
    both = one.unionByName(two, allowMissingColumns=True)
    return both.select(*sorted(both.columns))


def compact(parts: list[DataFrame], valid: Column, required: tuple[str, ...] = ()) -> DataFrame:
    """Parts and the existing table as one, invalid rows gone."""
    out = parts[0]
    for p in parts[1:]:
        out = aligned_union(out, p, required)
    return out.where(valid)


def upsert(cache: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Update rows of equal keys with the new non-null values, insert the others.

    An inserted row takes what new lacks from the first cached row (by all keys) of the same first key. Types must agree.
    """
    have = dict(cache.dtypes)
    if wrong := [c for c, t in new.dtypes if have.get(c) != t]:
        raise TypeError(f"columns {wrong} are unknown or of another type")
    values = [c for c in cache.columns if c not in keys]
    fresh = [c for c in new.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fresh])
    updated = cache.join(renamed, keys, "left").select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) if c in fresh else F.col(c) for c in values])
    seed = keep_first(cache, keys[:1], [F.col(k) for k in keys]).select(keys[0], *[F.col(c).alias(f"_old_{c}") for c in values])
    inserted = new.join(cache, keys, "left_anti").join(seed, keys[0], "left").select(*keys, *[F.coalesce(c, f"_old_{c}").alias(c) if c in fresh else F.col(f"_old_{c}").alias(c) for c in values])
    return updated.unionByName(inserted)


def migrate_null_keys(cache: DataFrame, wanted: DataFrame, first: str, others: list[str]) -> DataFrame:
    """Cached rows with null in the other keys are replaced by a copy for each wanted key of the same first key that isn't there yet."""
    null = F.lit(False)
    for c in others:
        null = null | F.col(c).isNull()
    templates, rest = cache.where(null), cache.where(~null)
    keys = [first, *others]
    missing = wanted.select(*keys).distinct().join(rest.select(*keys), keys, "left_anti")
    copies = missing.join(templates.drop(*others), first).select(*cache.columns)
    return rest.unionByName(templates.join(wanted.select(first).distinct(), first, "left_anti").select(*cache.columns)).unionByName(copies)


def missing_work(wanted: DataFrame, cache: DataFrame, keys: list[str], result: str, most: int | None = None) -> DataFrame:
    """Wanted keys absent from the cache or cached without a result, in order; most caps the work list."""
    want = wanted.select(*keys).distinct()
    absent = want.join(cache, keys, "left_anti")
    empty = want.join(cache.where(F.col(result).isNull()), keys, "left_semi")
    out = absent.unionByName(empty).distinct()
    return out if most is None else out.orderBy(*keys).limit(most)


def open_cache(spark: SparkSession, given: DataFrame | None = None, schema: T.StructType = CACHE_SCHEMA) -> DataFrame:
    """An empty table of the schema, or the given one if its columns and types are those."""
    if given is None:
        return spark.createDataFrame([], schema)
    if [(f.name, f.dataType) for f in given.schema] != [(f.name, f.dataType) for f in schema]:
        raise TypeError(f"the cache has {given.schema.simpleString()}")
    return given


def read_through(spark: SparkSession, path: str, key: str, compute) -> DataFrame:
    """The table saved under the key, or what compute() gives, saved."""
    target = f"{path.rstrip('/')}/key={key}"
    jvm = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        compute().write.parquet(target)
    return spark.read.parquet(target)
