"""Feature tables for models: schema, scaling, encoding, shards, training, quality."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLACKLIST = (r"(?i)name$", r"(?i)(^|_)id$", r"(?i)split")
NUMERIC = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
SHARD_ROWS = 500_000


def infer_schema(df: DataFrame, target: str, blacklist: tuple = BLACKLIST) -> dict:
    """Columns but the target and blacklisted ones, as numeric or categorical by type; a floating target means regression. Only the frame's schema is read."""
    out = {"target": target, "model": "regression" if isinstance(df.schema[target].dataType, (T.FloatType, T.DoubleType, T.DecimalType)) else "classification", "numeric": [], "categorical": []}
    for f in df.schema.fields:
        if f.name == target or any(re.search(p, f.name) for p in blacklist):
            continue
        if isinstance(f.dataType, NUMERIC):
            out["numeric"].append(f.name)
        elif isinstance(f.dataType, T.StringType):
            out["categorical"].append(f.name)
    return out


def as_number(df: DataFrame, column: str) -> Column:
    """Booleans as 0 and 1, dates as days since 1970, timestamps as seconds, the rest as double."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_timestamp(column).cast("double")
    return F.col(column).cast("double")


def scaling(df: DataFrame, columns: list[str], population: bool = False) -> DataFrame:
    """(feature, mean, std) in one aggregate; a deviation that is not finite or is 0 becomes 1. NaN doesn't count."""
    dev = F.stddev_pop if population else F.stddev_samp
    x = {c: F.nanvl(as_number(df, c), F.lit(None).cast("double")) for c in columns}
    one = df.agg(*[F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(columns)], *[dev(x[c]).alias(f"s{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i, c in enumerate(columns)]))
    out = one.select(rows.alias("r")).select("r.*")
    good = F.col("std").isNotNull() & ~F.isnan("std") & (F.col("std") > 0) & (F.col("std") < float("inf"))
    return out.withColumn("std", F.when(good, F.col("std")).otherwise(1.0))


def clean_number(x: Column) -> Column:
    """NaN and null to 0, infinities to one million."""
    x = F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0))
    return F.when(x == float("inf"), 1e6).when(x == float("-inf"), -1e6).otherwise(x)


def clean_features(df: DataFrame, columns: list[str], scale: DataFrame | None = None, clip: float | None = None) -> DataFrame:
    """Cleaned, clipped and scaled columns; scale holds one row a feature."""
    par = {r.feature: (r["mean"], r["std"]) for r in scale.collect()} if scale is not None else {}
    out = {}
    for c in columns:
        x = clean_number(as_number(df, c))
        x = F.greatest(F.lit(-clip), F.least(F.lit(clip), x)) if clip else x
        if c in par:
            x = (x - (par[c][0] or 0.0)) / par[c][1]
        out[c] = x
    return df.withColumns(out)


def clean_target(y: Column) -> Column:
    """NaN and null to one half, then within 0 and 1."""
    y = F.coalesce(F.nanvl(y.cast("double"), F.lit(None).cast("double")), F.lit(0.5))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), y))


def categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, code): the values of each column in order, codes from 0 a feature."""
    from pyspark.sql import Window

    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])).alias("r")).select("r.*").where("value is not null").distinct()
    return rows.withColumn("code", F.row_number().over(Window.partitionBy("feature").orderBy("value")) - 1)


def encode(df: DataFrame, columns: list[str], cats: DataFrame, strict: bool = True) -> DataFrame:
    """column_code for each column: the value's code; null gets the index after the last. Unknown values are an error if strict, else like null.

    Two jobs for all columns: the number of categories of each, and the first unknown value of any.
    """
    sizes = {r.feature: r["count"] for r in cats.where(F.col("feature").isin(columns)).groupBy("feature").count().collect()}
    if strict:
        rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])).alias("r")).select("r.*").where("value is not null").distinct()
        unknown = rows.join(cats, ["feature", "value"], "left_anti").limit(1).collect()
        if unknown:
            raise ValueError(f"{unknown[0].feature} has values that are no category")
    for c in columns:
        mine = cats.where(F.col("feature") == c).select(F.col("value").alias(c), F.col("code").alias(f"{c}_code"))
        df = df.join(mine, c, "left").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(sizes.get(c, 0))))
    return df


def embedding_sizes(cats: DataFrame) -> DataFrame:
    """(feature, n with the null index, size): half of n, fifty at most."""
    return cats.groupBy("feature").agg((F.count(F.lit(1)) + 1).alias("n")).withColumn("size", F.least(F.lit(50), F.floor(F.col("n") / 2)).cast("int"))


def validate(df: DataFrame, expected: dict[str, str], strict: bool = False) -> tuple[DataFrame, list[str]]:
    """The frame cast to the expected types, and what was wrong: missing, extra and mismatched columns; strict raises instead of casting."""
    have = dict(df.dtypes)
    problems = [f"missing {c}" for c in expected if c not in have] + [f"extra {c}" for c in have if c not in expected]
    wrong = {c: t for c, t in expected.items() if c in have and have[c] != t}
    problems += [f"{c}: {have[c]} for {t}" for c, t in wrong.items()]
    if strict and problems:
        raise TypeError("; ".join(problems))
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in wrong.items()}), problems


def write_shards(df: DataFrame, path: str, rows: int = SHARD_ROWS) -> None:
    """Parquet files of at most so many rows each."""
    df.write.option("maxRecordsPerFile", rows).parquet(path)


def feature_rows(df: DataFrame, row_id: str, numeric: list[str], categorical: list[str], target: str, cats: DataFrame) -> DataFrame:
    """row_id, continuous array<float>, codes array<int>, target: what shards hold."""
    coded = encode(df, categorical, cats)
    cont = F.array(*[clean_number(as_number(df, c)).cast("float") for c in numeric])
    return coded.select(row_id, cont.alias("continuous"), F.array(*[F.col(f"{c}_code").cast("int") for c in categorical]).alias("codes"), F.col(target).alias("target"))


def raw_shards(df: DataFrame, row_id: str, numeric: list[str], categorical: list[str], target: str, rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """Shards of so many rows in order of an integer row_id, each with codes of its own: (shard, row_id, continuous, codes, target) and the vocabularies (shard, feature, value, code).

    A shard's codes number its own values from 0; null is the number after the last.
    """
    from pyspark.sql import Window

    from ..sources.tables import with_index

    d = with_index(df, [row_id], "_n").withColumn("shard", F.floor(F.col("_n") / rows).cast("int")).drop("_n")
    seen = d.select("shard", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in categorical])).alias("r")).select("shard", "r.*").where("value is not null").distinct()
    vocabulary = seen.withColumn("code", F.row_number().over(Window.partitionBy("shard", "feature").orderBy("value")) - 1)
    sizes = vocabulary.groupBy("shard").agg(*[F.count(F.when(F.col("feature") == c, 1)).alias(f"_size_{c}") for c in categorical])
    out = d.join(sizes, "shard", "left")
    for c in categorical:
        mine = vocabulary.where(F.col("feature") == c).select("shard", F.col("value").alias(c), F.col("code").alias(f"_code_{c}"))
        out = out.join(mine, ["shard", c], "left")
    codes = F.array(*[F.coalesce(f"_code_{c}", f"_size_{c}", F.lit(0)).cast("int") for c in categorical])
    cont = F.array(*[clean_number(as_number(df, c)).cast("float") for c in numeric])
    return out.select("shard", row_id, cont.alias("continuous"), codes.alias("codes"), F.col(target).alias("target")), vocabulary


def manifest(shards: DataFrame, row_id: str) -> DataFrame:
    """(shard, n, first_id, last_id): what each shard holds."""
    return shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first_id"), F.max(row_id).alias("last_id"))


def global_codes(shards: DataFrame, vocabulary: DataFrame, cats: DataFrame, categorical: list[str]) -> DataFrame:
    """Shards with the codes of cats instead of each shard's own; what stands for null in a shard gets the index after the last, values that are no category too."""
    sizes = {r.feature: r["count"] for r in cats.groupBy("feature").count().collect()}
    table = vocabulary.join(cats.withColumnRenamed("code", "to"), ["feature", "value"], "left").select("shard", "feature", "code", "to")
    for i, c in enumerate(categorical):
        mine = table.where(F.col("feature") == c).select("shard", F.col("code").alias("_from"), F.col("to").alias(f"_to_{c}"))
        shards = shards.withColumn("_from", F.col("codes")[i]).join(mine, ["shard", "_from"], "left").drop("_from")
    codes = F.array(*[F.coalesce(f"_to_{c}", F.lit(sizes.get(c, 0))).cast("int") for c in categorical])
    return shards.withColumn("codes", codes).drop(*[f"_to_{c}" for c in categorical])


def train_classifier(df: DataFrame, numeric: list[str], target: str, hidden: int = 16, seed: int = 7, iterations: int = 40):
    """Multi-layer perceptron on scaled numeric features; (fitted pipeline, labels)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler

    labels = StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc").fit(df)
    net = MultilayerPerceptronClassifier(featuresCol="_scaled", labelCol="_label", layers=[len(numeric), hidden, len(labels.labels)], seed=seed, maxIter=iterations, probabilityCol="_p", predictionCol="_y", rawPredictionCol="_raw")
    return Pipeline(stages=[labels, VectorAssembler(inputCols=numeric, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_scaled", withMean=True), net]).fit(df), labels.labels


def predict_classes(df: DataFrame, model, labels: list[str], target: str, k: int = 3) -> DataFrame:
    """y_Pred, y_Probs, the k best labels and codes, and whether the first is right."""
    from pyspark.ml.functions import vector_to_array

    names = F.array(*[F.lit(x) for x in labels])
    out = model.transform(df).withColumn("y_Probs", vector_to_array("_p"))
    ranked = F.slice(F.array_sort(F.transform("y_Probs", lambda p, i: F.struct((-p).alias("m"), i.alias("i")))), 1, k)
    out = out.withColumn("y_Top_Pred_Codes", F.transform(ranked, lambda x: x["i"]))
    out = out.withColumn("y_Top_Preds", F.transform("y_Top_Pred_Codes", lambda i: F.get(names, i))).withColumn("y_Pred", F.col("y_Top_Preds")[0])
    return out.withColumn("y_Match", F.col("y_Pred") == F.col(target)).drop("_label", "_x", "_scaled", "_p", "_y", "_raw")


def train_regressor(df: DataFrame, numeric: list[str], target: str, seed: int = 7):
    """Gradient-boosted trees, a family that Spark trains in parallel."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    return Pipeline(stages=[VectorAssembler(inputCols=numeric, outputCol="_x"), GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="y_Pred", maxIter=10, maxDepth=4, seed=seed)]).fit(df)


def predict_values(df: DataFrame, model, low: float, high: float) -> DataFrame:
    return model.transform(df).withColumn("y_Pred", F.greatest(F.lit(low), F.least(F.lit(high), F.col("y_Pred")))).drop("_x")


def strict_codes(df: DataFrame, column: str, codes: dict[str, int]) -> DataFrame:
    """column_code by a fixed map; null takes the NULL class if there is one, else it and unknown values are errors naming the value."""
    from ..functions.bridge import lookup

    value = F.coalesce(F.col(column), F.lit("NULL"))
    bad = df.where(~value.isin(*codes)).select(value.alias("v")).limit(1).collect()
    if bad:
        raise ValueError(f"{column} has the unknown value {bad[0].v!r}")
    return df.withColumn(f"{column}_code", lookup(codes, value))


def recentre(df: DataFrame, probability: str, spread: float, bins: int = 2000) -> DataFrame:
    """Shift and stretch logits so that probabilities have mean one half and the given deviation; null stays null.

    The bisection runs over a table of binned logits, whose size is the number of bins.
    """
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(probability)))
    logit = F.log(p / (1 - p))
    low, width = -14.0, 28.0 / bins
    table = df.where(F.col(probability).isNotNull()).groupBy(F.floor((logit - low) / width).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg(logit).alias("x")).orderBy("b").collect()
    n = sum(r.n for r in table)
    if not n:
        return df.withColumn("Recentred", F.col(probability))

    def moments(shift: float, heat: float) -> tuple[float, float]:
        q = [(r.n, 1 / (1 + math.exp(-(r.x - shift) / heat))) for r in table]
        mean = sum(k * v for k, v in q) / n
        return mean, math.sqrt(sum(k * (v - mean) ** 2 for k, v in q) / n)

    def shift_for(heat: float) -> float:
        a, b = -20.0, 20.0
        for _ in range(60):
            mid = (a + b) / 2
            a, b = (mid, b) if moments(mid, heat)[0] > 0.5 else (a, mid)
        return (a + b) / 2

    a, b = 0.02, 50.0
    for _ in range(50):
        heat = (a + b) / 2
        a, b = (heat, b) if moments(shift_for(heat), heat)[1] > spread else (a, heat)
    heat = (a + b) / 2
    return df.withColumn("Recentred", F.when(F.col(probability).isNotNull(), 1 / (1 + F.exp(-(logit - shift_for(heat)) / heat))))


def regression_quality(df: DataFrame, y: str, pred: str) -> DataFrame:
    """One row: counts, moments and ranges of rows with both values, errors (truth less prediction), numbers and shares over (prediction above truth), under and within 0.01, MAE, RMSE, MAE over deviation, a label for the ratio of deviations."""
    e = F.col(y) - F.col(pred)
    n = lambda c: F.count(F.when(c, 1))
    q = df.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(y).isNull(), 1)).alias("null_y"), F.count(F.when(F.col(pred).isNull(), 1)).alias("null_pred"), F.count(e).alias("n_errors"),
        *[f(F.when(e.isNotNull(), F.col(c))).alias(f"{k}_{name}") for name, c in (("y", y), ("pred", pred)) for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))],
        F.avg(e).alias("mean_error"), F.stddev_pop(e).alias("std_error"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), n(e < 0).alias("over"), n(e > 0).alias("under"), n(F.abs(e) < 0.01).alias("within"),
    )
    q = q.withColumns({f"{k}_pct": F.try_divide(F.col(k) * 100, F.col("n_errors")) for k in ("over", "under", "within")})
    ratio = F.try_divide(F.col("std_pred"), F.col("std_y"))
    label = F.when(ratio.isNull(), "unknown").when(ratio < 0.3, "severe underfit").when(ratio < 0.5, "moderate underfit").when(ratio <= 1.2, "healthy").otherwise("possibly overfit")
    return q.withColumns({"mae_over_std": F.try_divide(F.col("mae"), F.col("std_y")), "variance": label, "r_mse": F.round("mae", 6)})


def confusion(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def classification_quality(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Per class: support, precision, recall, f1; and on each row their means over the classes, the number of classes, accuracy, the majority class's share and the lift over it."""
    from pyspark.sql import Window

    c = confusion(df, y, pred)
    true = c.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits"))
    said = c.groupBy(F.col("pred").alias("class")).agg(F.sum("n").alias("predicted"))
    k = true.join(said, "class", "full").na.fill(0)
    k = k.withColumns({"precision": F.coalesce(F.try_divide(F.col("hits"), F.col("predicted")), F.lit(0.0)), "recall": F.coalesce(F.try_divide(F.col("hits"), F.col("support")), F.lit(0.0))})
    every = Window.partitionBy(F.lit(0))  # one row a class
    k = k.withColumns({"f1": F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)), "accuracy": F.sum("hits").over(every) / F.sum("support").over(every), "majority": F.max("support").over(every) / F.sum("support").over(every)})
    k = k.withColumns({f"macro_{c}": F.avg(c).over(every) for c in ("precision", "recall", "f1")}).withColumn("n_classes", F.count(F.lit(1)).over(every))
    return k.withColumn("lift", F.try_divide(F.col("accuracy"), F.col("majority")))


def top_k_accuracy(df: DataFrame, y: str, top: str) -> DataFrame:
    return df.agg(F.avg(F.array_contains(F.col(top), F.col(y)).cast("int")).alias("top_k_accuracy"))
