"""Queries MLF1 to MLF11 and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import features as M
from .tables import folder

Q, O = {}, {}


def reg(name, run, sql=None):
    Q[name] = run
    if sql:
        O[name] = sql


def table(spark, sf):
    """Customers with what they ordered; segment is the class, total the value to predict."""
    o = X.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.max(F.to_date("o_orderdate")).alias("last_day"), F.min("o_orderpriority").alias("priority"))
    c = X.table(spark, sf, "customer").join(o, "c_custkey", "left")
    return c.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", F.col("c_mktsegment").alias("segment"), "n_orders", "total", "last_day", F.when(F.col("c_custkey") % 9 > 0, F.col("priority")).alias("priority"), (F.col("c_acctbal") > 0).alias("in_credit"))


T = """(SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment AS segment, n_orders, total, last_day, CASE WHEN c_custkey % 9 > 0 THEN priority END AS priority, c_acctbal > 0 AS in_credit FROM customer LEFT JOIN
  (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total, max(o_orderdate::DATE) AS last_day, min(o_orderpriority) AS priority FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""
NUM = ["c_nationkey", "c_acctbal", "n_orders", "last_day", "in_credit"]


def schema_rows(spark, sf):
    t = table(spark, sf)
    s = M.infer_schema(t, "total", (*M.BLACKLIST, "custkey"))
    pairs = [(c, "numeric") for c in s["numeric"]] + [(c, "categorical") for c in s["categorical"]]
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(k).alias("kind"), F.col(c).isNotNull().alias("there")) for c, k in pairs]))
    return t.select(kinds.alias("r")).groupBy("r.feature", "r.kind").agg(F.count(F.when(F.col("r.there"), 1)).alias("values")).withColumn("model", F.lit(s["model"]))


ALLC = [("c_nationkey", "numeric"), ("c_acctbal", "numeric"), ("segment", "categorical"), ("n_orders", "numeric"), ("last_day", "numeric"), ("priority", "categorical"), ("in_credit", "numeric")]
reg("mlf1_schema", schema_rows, " UNION ALL ".join(f"SELECT '{c}' AS feature, '{k}' AS kind, count({c}) AS values, 'regression' AS model FROM {T}" for c, k in ALLC))
DN = {"last_day": "(last_day - DATE '1970-01-01')::DOUBLE", "in_credit": "in_credit::INTEGER::DOUBLE"}
reg("mlf2_scaling", lambda s, d: (lambda x: x.select("feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std")))(M.scaling(table(s, d), NUM)),
    " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({DN.get(c, c)}), 4) AS mean, round(coalesce(nullif(stddev_samp({DN.get(c, c)}), 0), 1), 4) AS std FROM {T}" for c in NUM))


def cleaned(spark, sf):
    e = X.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 7 == 0, float("inf")).when(F.col("event_id") % 11 == 0, float("-inf")).otherwise((F.col("user_id") % 90).cast("double")).alias("x"), F.when(F.col("event_id") % 3 > 0, F.col("user_id") % 5 - 2).alias("y"))
    return M.clean_features(e, ["x"], clip=50.0).withColumn("y", M.clean_target(F.col("y")))


reg("mlf3_cleaning", cleaned, "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 7 = 0 THEN 50 WHEN event_id % 11 = 0 THEN -50 ELSE least(50, user_id % 90) END::DOUBLE AS x, CASE WHEN event_id % 3 > 0 THEN greatest(0, least(1, user_id % 5 - 2)) ELSE 0.5 END::DOUBLE AS y FROM events")
CATS = f"""(SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS code FROM (SELECT DISTINCT 'segment' AS feature, segment AS value FROM {T} UNION SELECT 'priority', priority FROM {T}) WHERE value IS NOT NULL)"""


def coded(spark, sf):
    t = table(spark, sf)
    return M.encode(t, ["segment", "priority"], M.categories(t, ["segment", "priority"])).select("c_custkey", "segment_code", "priority_code")


reg("mlf4_encoding", coded, f"SELECT c_custkey, s.code AS segment_code, coalesce(p.code, (SELECT count(*) FROM {CATS} WHERE feature = 'priority')) AS priority_code FROM {T} t LEFT JOIN {CATS} s ON s.feature = 'segment' AND s.value = segment LEFT JOIN {CATS} p ON p.feature = 'priority' AND p.value = priority")
reg("mlf5_validation", lambda s, d: (lambda r: r[0].select("c_custkey", "c_name", "n_orders").withColumn("problems", F.lit("; ".join(sorted(r[1])))))(M.validate(table(s, d).select("c_custkey", "c_name", "n_orders"), {"c_custkey": "bigint", "c_name": "int", "n_orders": "double", "gone": "int"})),
    f"SELECT c_custkey, NULL::INTEGER AS c_name, n_orders::DOUBLE AS n_orders, 'c_name: string for int; missing gone; n_orders: bigint for double' AS problems FROM {T}")


def shards(spark, sf):
    """Shards of a hundred rows with codes of their own, stored, read back, given the global codes, with their manifest."""
    t, num, cat = table(spark, sf), ["c_nationkey", "n_orders", "in_credit"], ["segment", "priority"]
    rows, vocabulary = M.raw_shards(t, "c_custkey", num, cat, "n_orders", 100)
    path = folder(spark, "shards")
    M.write_shards(rows, f"{path}/rows", 100)
    vocabulary.write.parquet(f"{path}/vocabulary")
    rows, vocabulary = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/vocabulary")
    out = M.global_codes(rows, vocabulary, M.categories(t, cat), cat).join(M.manifest(rows, "c_custkey"), "shard")
    return out.select("c_custkey", "shard", "n", "first_id", "last_id", F.array_join(F.transform("continuous", lambda x: x.cast("int").cast("string")), ",").alias("continuous"), F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"), "target")


reg("mlf6_shards", shards, f"""SELECT c_custkey, shard, count(*) OVER w AS n, min(c_custkey) OVER w AS first_id, max(c_custkey) OVER w AS last_id, c_nationkey || ',' || coalesce(n_orders, 0) || ',' || in_credit::INTEGER AS continuous, s.code || ',' || coalesce(p.code, (SELECT count(*) FROM {CATS} WHERE feature = 'priority')) AS codes, n_orders AS target
  FROM (SELECT *, ((row_number() OVER (ORDER BY c_custkey) - 1) // 100)::INTEGER AS shard FROM {T}) t LEFT JOIN {CATS} s ON s.feature = 'segment' AND s.value = segment LEFT JOIN {CATS} p ON p.feature = 'priority' AND p.value = priority WINDOW w AS (PARTITION BY shard)""")
# the same through codes that are global from the start
reg("mlf6_feature_rows", lambda s, d: (lambda t: M.feature_rows(t, "c_custkey", ["c_nationkey", "n_orders"], ["segment", "priority"], "n_orders", M.categories(t, ["segment", "priority"])).select("c_custkey", F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"), "target"))(table(s, d)),
    f"SELECT c_custkey, s.code || ',' || coalesce(p.code, (SELECT count(*) FROM {CATS} WHERE feature = 'priority')) AS codes, n_orders AS target FROM {T} t LEFT JOIN {CATS} s ON s.feature = 'segment' AND s.value = segment LEFT JOIN {CATS} p ON p.feature = 'priority' AND p.value = priority")


def trained(spark, sf):
    """Classes told apart by the sign and size of the balance; predictions for every customer."""
    t = M.clean_features(table(spark, sf), ["c_acctbal", "n_orders", "c_nationkey"]).withColumn("band", F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high"))
    model, labels = M.train_classifier(t, ["c_acctbal", "n_orders", "c_nationkey"], "band")
    p = M.predict_classes(t, model, labels, "band", 2).withColumnRenamed("y_Pred", "band_Pred")
    r = M.train_regressor(t.withColumn("total", F.coalesce("total", F.lit(0.0))), ["n_orders", "c_acctbal"], "total")
    return M.predict_values(p, r, 0.0, 1e9).select("c_custkey", "band", F.col("y_Pred").cast("long").alias("value"), "y_Match", F.array_join("y_Top_Preds", ",").alias("top"))


reg("mlf7_train_predict", trained)
reg("mlf8_strict_codes", lambda s, d: M.strict_codes(table(s, d).select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("in_credit").cast("string")).alias("flag")), "flag", {"NULL": 2, "true": 1, "false": 0}).select("c_custkey", "flag_code"), f"SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE in_credit::INTEGER END AS flag_code FROM {T}")
reg("mlf9_recentre", lambda s, d: M.recentre(X.table(s, d, "events").select("event_id", ((F.col("user_id") % 97 + 1) / 130).alias("p")), "p", 0.1).select("event_id", F.round("Recentred", 6).alias("p")))


def guesses(spark, sf):
    return X.table(spark, sf, "orders").select(((F.col("o_orderkey") % 100) / 100).alias("y"), F.when(F.col("o_orderkey") % 13 > 0, (F.col("o_custkey") % 90) / 100).alias("pred"))


G = "(SELECT o_orderkey % 100 / 100 AS y, CASE WHEN o_orderkey % 13 > 0 THEN o_custkey % 90 / 100 END AS pred FROM orders)"
Rd = lambda q: q.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in q.dtypes])
MOMENTS = ", ".join(f"{f}({c}) FILTER (y IS NOT NULL AND pred IS NOT NULL) AS {k}_{name}" for name, c in (("y", "y"), ("pred", "pred")) for k, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in [f"{k}_{n}" for n in ("y", "pred") for k in ("mean", "std", "min", "max")] + ["mean_error", "std_error", "mae", "rmse"])
reg("mlf10_regression_quality", lambda s, d: Rd(M.regression_quality(guesses(s, d), "y", "pred")),
    f"""SELECT n, null_y, null_pred, n_errors, {ROUNDED}, "over", under, within, round(100 * "over" / n_errors, 6) AS over_pct, round(100 * under / n_errors, 6) AS under_pct, round(100 * within / n_errors, 6) AS within_pct, round(mae / std_y, 6) AS mae_over_std,
  CASE WHEN std_pred / std_y < 0.3 THEN 'severe underfit' WHEN std_pred / std_y < 0.5 THEN 'moderate underfit' WHEN std_pred / std_y > 1.2 THEN 'possibly overfit' ELSE 'healthy' END AS variance, round(mae, 6) AS r_mse
  FROM (SELECT count(*) AS n, count(*) - count(y) AS null_y, count(*) - count(pred) AS null_pred, count(y - pred) AS n_errors, {MOMENTS}, avg(y - pred) AS mean_error, stddev_pop(y - pred) AS std_error, avg(abs(pred - y)) AS mae, sqrt(avg((pred - y) * (pred - y))) AS rmse,
  count(*) FILTER (pred > y) AS "over", count(*) FILTER (pred < y) AS under, count(*) FILTER (abs(y - pred) < 0.01::DOUBLE) AS within FROM {G})""")
CLASSES = """(SELECT k AS class, count(*) FILTER (toxic = k) AS support, count(*) FILTER (toxic = k AND doc_id % 2 = k) AS hits, count(*) FILTER (doc_id % 2 = k) AS predicted FROM labels, (SELECT unnest([0, 1])::INTEGER AS k) GROUP BY k)"""
RATES = f"(SELECT *, hits / predicted AS p, hits / support AS r, coalesce(2 * (hits / predicted) * (hits / support) / nullif(hits / predicted + hits / support, 0), 0) AS f FROM {CLASSES})"
guessed = lambda s, d: X.table(s, d, "labels").select("doc_id", "toxic", (F.col("doc_id") % 2).cast("int").alias("pred"))
reg("mlf11_classification_quality", lambda s, d: Rd(M.classification_quality(guessed(s, d), "toxic", "pred")),
    f"""SELECT class, support, hits, predicted, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(avg(p) OVER (), 6) AS macro_precision, round(avg(r) OVER (), 6) AS macro_recall, round(avg(f) OVER (), 6) AS macro_f1, count(*) OVER () AS n_classes,
  round(sum(hits) OVER () / sum(support) OVER (), 6) AS accuracy, round(max(support) OVER () / sum(support) OVER (), 6) AS majority, round((sum(hits) OVER () / sum(support) OVER ()) / (max(support) OVER () / sum(support) OVER ()), 6) AS lift FROM {RATES}""")
reg("mlf11_confusion", lambda s, d: M.confusion(guessed(s, d), "toxic", "pred"), "SELECT toxic AS truth, (doc_id % 2)::INTEGER AS pred, count(*) AS n FROM labels GROUP BY ALL")
reg("mlf11_top_k", lambda s, d: Rd(M.top_k_accuracy(X.table(s, d, "orders").select("o_orderpriority", F.array(F.lit("1-URGENT"), F.when(F.col("o_orderkey") % 2 == 0, "2-HIGH").otherwise("5-LOW")).alias("top")), "o_orderpriority", "top")),
    "SELECT round(avg((o_orderpriority = '1-URGENT' OR o_orderpriority = CASE WHEN o_orderkey % 2 = 0 THEN '2-HIGH' ELSE '5-LOW' END)::INTEGER), 6) AS top_k_accuracy FROM orders")
