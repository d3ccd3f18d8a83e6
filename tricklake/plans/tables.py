"""Queries SRC1 to SRC4 and SRC9 to SRC15 and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..sources import tables as S
from ..sources.folders import shared_folder as folder
from ..sources.stored import StoredTable

Q, O = {}, {}


def reg(name, run, sql, *ctes):
    Q[name] = run
    O[name] = X.oracle(sql, *ctes)


orders = lambda s, d: X.table(s, d, "orders")
reg("src1_save", lambda s, d: S.save(orders(s, d).select("o_orderkey", "o_totalprice"), folder(s, "save")), "SELECT o_orderkey, o_totalprice FROM orders")


def narrowed(spark, sf):
    df = S.scan(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice", "o_custkey"], F.col("o_orderkey") > 5)
    df = df.withColumns({"QT_a": F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_orderkey") / 2), "Score_b": F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey") % 4000)})
    return S.narrow(df.select("o_orderkey", "QT_a", "Score_b"), {"QT_": "float", "Score_": "smallint"})


reg("src2_narrow_scan", narrowed, "SELECT o_orderkey, (CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey / 2 END)::FLOAT AS QT_a, (CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 4000 ELSE 0 END)::SMALLINT AS Score_b FROM orders WHERE o_orderkey > 5")
reg("src3_indexed_scan", lambda s, d: S.with_index(S.require(orders(s, d).select("o_orderkey", "o_orderstatus"), {"o_orderkey": "bigint", "o_orderstatus": "string"}), ["o_orderkey"], bucket_rows=1000), "SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders")
reg("src4_filtered_scan", lambda s, d: S.scan(s, f"{d}/orders.parquet", ["o_orderkey", "o_orderpriority"], F.col("o_orderstatus") == "F"), "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")


reg("src9_aligned_union", lambda s, d: S.aligned_union(orders(s, d).where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey"), orders(s, d).where("o_orderkey % 2 = 1").select("o_orderkey", "o_orderstatus"), ("o_orderkey",)),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS o_orderstatus FROM orders")


def merged(spark, sf):
    """Parts with columns of their own, appended to a stored table and packed into fewer files, without invalid rows."""
    o = orders(spark, sf).select("o_orderkey", "o_custkey")
    parts = [o.where(F.col("o_orderkey") % 3 == i).withColumns({f"x{i}": F.lit(i)}) for i in range(3)]
    t = StoredTable(spark, folder(spark, "compact")).create(parts[0], ["o_orderkey"])
    for p in parts[1:]:
        t.append(p)
    t.compact(valid=F.col("o_custkey") % 2 == 0)
    return t.read()


reg("src10_compaction", merged, "SELECT o_orderkey, o_custkey, " + ", ".join(f"CASE WHEN o_orderkey % 3 = {i} THEN {i} END AS x{i}" for i in range(3)) + " FROM orders WHERE o_custkey % 2 = 0")


def cache(spark, sf):
    """Two of three deals, some without results, some without dealer; a deal for every three orders."""
    o = orders(spark, sf).where("o_orderkey % 3 <> 0")
    k = F.col("o_orderkey")
    return o.select(F.concat(F.lit("d"), F.floor(k / 3).cast("string")).alias("PBN"), F.when(k % 7 > 0, F.substring(F.lit("NESW"), (k % 4 + 1).cast("int"), F.lit(1))).alias("Dealer"), k.alias("key"), F.when(k % 5 > 0, k % 100).alias("par"), (k % 11).alias("trials")).groupBy("PBN", "Dealer").agg(F.max("par").alias("par"), F.max("trials").alias("trials"))


CACHE = "(SELECT 'd' || o_orderkey // 3 AS PBN, CASE WHEN o_orderkey % 7 > 0 THEN substr('NESW', (o_orderkey % 4 + 1)::INTEGER, 1) END AS Dealer, max(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 100 END) AS par, max(o_orderkey % 11) AS trials FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2)"


def new_rows(spark, sf):
    k = F.col("o_orderkey")
    return orders(spark, sf).where("o_orderkey % 4 = 1").select(F.concat(F.lit("d"), F.floor(k / 3 + k % 5 / 4).cast("string")).alias("PBN"), F.substring(F.lit("NESW"), (k % 3 + 1).cast("int"), F.lit(1)).alias("Dealer"), F.when(k % 6 > 0, k % 50).alias("par")).groupBy("PBN", "Dealer").agg(F.max("par").alias("par"))


NEW = "(SELECT 'd' || floor(o_orderkey / 3 + o_orderkey % 5 / 4)::BIGINT AS PBN, substr('NESW', (o_orderkey % 3 + 1)::INTEGER, 1) AS Dealer, max(CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 50 END) AS par FROM orders WHERE o_orderkey % 4 = 1 GROUP BY 1, 2)"
KEYS = ["PBN", "Dealer"]


def upserted(spark, sf):
    """In place, in a stored table."""
    t = StoredTable(spark, folder(spark, "stored")).create(cache(spark, sf), KEYS)
    t.upsert(new_rows(spark, sf))
    return t.read()


def migrated(spark, sf):
    t = StoredTable(spark, folder(spark, "stored")).create(cache(spark, sf), KEYS)
    t.migrate_null_keys(new_rows(spark, sf))
    return t.read()


reg("src11_upsert", upserted,
    f"""SELECT c.PBN, c.Dealer, coalesce(n.par, c.par) AS par, c.trials FROM {CACHE} c LEFT JOIN {NEW} n ON c.PBN = n.PBN AND c.Dealer = n.Dealer UNION ALL
  SELECT n.PBN, n.Dealer, coalesce(n.par, f.par), f.trials FROM {NEW} n LEFT JOIN {CACHE} c ON c.PBN = n.PBN AND c.Dealer = n.Dealer
  LEFT JOIN (SELECT * FROM {CACHE} QUALIFY row_number() OVER (PARTITION BY PBN ORDER BY Dealer NULLS FIRST) = 1) f ON f.PBN = n.PBN WHERE c.PBN IS NULL""")
reg("src12_migrate_null_keys", migrated,
    f"""SELECT * FROM {CACHE} WHERE Dealer IS NOT NULL UNION ALL SELECT * FROM {CACHE} WHERE Dealer IS NULL AND PBN NOT IN (SELECT PBN FROM {NEW}) UNION ALL
  SELECT n.PBN, n.Dealer, c.par, c.trials FROM {NEW} n JOIN {CACHE} c ON c.PBN = n.PBN AND c.Dealer IS NULL WHERE NOT EXISTS (SELECT 1 FROM {CACHE} x WHERE x.PBN = n.PBN AND x.Dealer = n.Dealer)""")
reg("src13_missing_work", lambda s, d: S.missing_work(new_rows(s, d), cache(s, d), ["PBN", "Dealer"], "par", 300),
    f"SELECT PBN, Dealer FROM (SELECT n.PBN, n.Dealer FROM {NEW} n LEFT JOIN {CACHE} c ON c.PBN = n.PBN AND c.Dealer = n.Dealer WHERE c.par IS NULL) ORDER BY PBN, Dealer LIMIT 300")


def fixed(spark, sf):
    k = F.col("o_orderkey")
    rows = orders(spark, sf).select(k.cast("string").alias("PBN"), F.lit("N").alias("Dealer"), F.lit("None").alias("Vul"), F.create_map(F.lit("NS"), (k % 14).cast("tinyint")).alias("DD"), (k % 1000).cast("smallint").alias("ParScore"), k.alias("Probs_Trials"))
    both = S.open_cache(spark).unionByName(S.open_cache(spark, rows))
    return both.select("PBN", F.col("DD")["NS"].cast("int").alias("NS"), F.col("ParScore").cast("int").alias("par"))


reg("src14_fixed_schema_cache", fixed, "SELECT o_orderkey::VARCHAR AS PBN, (o_orderkey % 14)::INTEGER AS NS, (o_orderkey % 1000)::INTEGER AS par FROM orders")


def through(spark, sf):
    path = folder(spark, "through")
    S.read_through(spark, path, "a", lambda: orders(spark, sf).select("o_orderkey", "o_custkey"))
    return S.read_through(spark, path, "a", lambda: orders(spark, sf).limit(0).select("o_orderkey", "o_custkey"))


reg("src15_read_through", through, "SELECT o_orderkey, o_custkey FROM orders")
