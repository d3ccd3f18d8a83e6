"""Connected components of a graph given by its links."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import remove


def components(links: DataFrame, folder: str) -> DataFrame:
    """links(a, b) -> (v, component): each vertex with the smallest one it can reach; without links no rows.

    A round gives each vertex the least label among its neighbours, aggregated before the shuffle so that a
    vertex with very many links is no hot spot, and then that label's own label. Rounds are tables below folder and end when no label changes; all but
    the last are removed.
    """
    spark, path = links.sparkSession, f"{folder.rstrip('/')}/components-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    both = links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
    edges = kept(both.select("x.a", "x.b").distinct(), "edges")
    labels = kept(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "0")
    n = 0
    while True:
        n += 1
        near = edges.join(labels, edges.b == labels.v).groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near"))
        step = labels.join(near, "v").select("v", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = step.select(F.col("v").alias("w"), F.col("mid").alias("jumped"))
        new = kept(step.join(jump, step.mid == jump.w).select("v", "old", F.least("mid", "jumped").alias("component")), str(n))
        labels = new.select("v", "component")
        remove(spark, f"{path}/{n - 1}")
        if not new.where("old <> component").limit(1).count():
            remove(spark, f"{path}/edges")
            return labels
