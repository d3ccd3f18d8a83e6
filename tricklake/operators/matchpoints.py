"""Matchpoints and field percentages.

Everything goes through frequencies (board, score, count): a board of a very large
event is aggregated before the shuffle, and running counts touch distinct scores only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOARD = ["session_id", "section_id", "Board"]
#: a board over all sections that play the same deal
DEAL = ["session_id", "deal_id", "Board"]


def frequencies(df: DataFrame, keys: list[str] = BOARD, score: str = "Score_NS") -> DataFrame:
    """(keys, score, n) without null scores."""
    # null scores go after the count: a filter before it would repeat the whole rule of the score
    return df.groupBy(*keys, F.col(score).alias("score")).agg(F.count(score).alias("n")).where("n > 0")


def score_frequencies(freq: DataFrame, keys: list[str] = BOARD) -> DataFrame:
    """freq(keys, score, n) -> beats, ties, mp, pairs, pct; pct is mp itself where one pair played."""
    order = Window.partitionBy(*keys).orderBy("score")
    below = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = freq.withColumns({"beats": below, "ties": F.col("n") - 1, "pairs": F.sum("n").over(Window.partitionBy(*keys))})
    df = df.withColumn("mp", F.col("beats") + F.col("ties") / 2)
    return df.withColumn("pct", F.when(F.col("pairs") > 1, F.try_divide(F.col("mp"), F.col("pairs") - 1)).otherwise(F.col("mp")))


def score_points(df: DataFrame, keys: list[str] = BOARD, score: str = "Score_NS") -> DataFrame:
    """(keys, score) -> MP_NS, MP_EW, MP_Top: average rank less one for both sides."""
    f = score_frequencies(frequencies(df, keys, score), keys)
    return f.select(*keys, F.col("score").alias(score), F.col("mp").alias("MP_NS"), (F.col("pairs") - 1 - F.col("mp")).alias("MP_EW"), (F.col("pairs") - 1).alias("MP_Top"))


def matchpoints(df: DataFrame, keys: list[str] = BOARD, score: str = "Score_NS") -> DataFrame:
    """MP_NS, MP_EW, MP_Top as by score_points; rows without a score get null and don't count."""
    return df.join(score_points(df, keys, score), [*keys, score], "left")


def board_top(df: DataFrame, keys: list[str] = BOARD, score: str = "Score_NS") -> DataFrame:
    """Rows whose board has a top (scores less one, a given MP_Top if that is lower) above 0.

    Percentages that are given make the matchpoints anew, rounded to two places; else given matchpoints of both sides make the top, their rounded sum.
    """
    n = df.where(F.col(score).isNotNull()).groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_top"))
    df = df.join(n, keys, "left")
    field = F.coalesce("_top", F.lit(-1))  # a board without any score has no field, whatever top is given
    df = df.withColumn("MP_Top", F.least("MP_Top", field) if "MP_Top" in df.columns else field).drop("_top")
    if {"Pct_NS", "Pct_EW"} <= set(df.columns):
        df = df.withColumns({f"MP_{p}": F.round(F.col(f"Pct_{p}") * F.col("MP_Top"), 2) for p in ("NS", "EW")})
    elif {"MP_NS", "MP_EW"} <= set(df.columns):
        df = df.withColumn("MP_Top", F.round(F.col("MP_NS") + F.col("MP_EW")).cast("long"))
    return df.where("MP_Top > 0")


def percentages(df: DataFrame) -> DataFrame:
    """Pct_NS, Pct_EW; Pct_Declarer where Declarer_Pair is known."""
    df = df.withColumns({f"Pct_{p}": F.try_divide(F.col(f"MP_{p}"), F.col("MP_Top")) for p in ("NS", "EW")})
    if "Declarer_Pair" in df.columns:
        df = df.withColumn("Pct_Declarer", F.when(F.col("Declarer_Pair") == "NS", F.col("Pct_NS")).when(F.col("Declarer_Pair") == "EW", F.col("Pct_EW")))
    return df


def fields(freq: DataFrame, keys: list[str] = BOARD) -> DataFrame:
    """(keys, field): the distinct scores of a board with counts, as one array; its length is bounded by the scores there are."""
    return freq.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("score", "n"))).alias("field"))


def _sum(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + value(x))


def hypothetical(df: DataFrame, freq: DataFrame, score: str, keys: list[str] = BOARD) -> DataFrame:
    """Hypo_Pct: what the score would get on its board: an equal score's percentage; else the share of pairs below it (1 above all); null without a field."""
    x, f = F.col(score).cast("double"), F.col("field")
    df = df.join(fields(freq, keys), keys, "left")
    pairs, below = _sum(f, lambda s: s["n"]), _sum(f, lambda s: F.when(s["score"] < x, s["n"]).otherwise(0))
    same = _sum(f, lambda s: F.when(s["score"] == x, s["n"]).otherwise(0))
    exact = F.when(pairs > 1, F.try_divide(below + (same - 1) / 2, pairs - 1)).otherwise(below + (same - 1) / 2)
    return df.withColumn("Hypo_Pct", F.when(f.isNotNull(), F.when(same > 0, exact).otherwise(F.try_divide(below, pairs)))).drop("field")


def beaten(df: DataFrame, freq: DataFrame, value: str, out: str, keys: list[str] = BOARD) -> DataFrame:
    """out: the share of the field's distinct scores (of 1 at least) that are below the value, equal ones half; null for null values."""
    x, f = F.col(value), F.col("field")
    points = _sum(f, lambda s: F.when(s["score"] < x, 1.0).when(s["score"] == x, 0.5).otherwise(0.0))
    df = df.join(fields(freq, keys), keys, "left")
    return df.withColumn(out, F.when(x.isNotNull() & f.isNotNull(), F.try_divide(points, F.greatest(F.lit(1), F.size(f))))).drop("field")


def all_pairs(df: DataFrame, value: str, out: str, keys: list[str] = DEAL, score: str = "Score_NS") -> DataFrame:
    """out: over all rows of the board, scores below the value count 1, equal ones a half. A null value or score counts as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    freq = df.groupBy(*keys, zero(score).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    points = _sum(F.col("field"), lambda s: F.when(s["score"] < zero(value), s["n"].cast("double")).when(s["score"] == zero(value), s["n"] / 2).otherwise(0.0))
    return df.join(fields(freq, keys), keys, "left").withColumn(out, points).drop("field")


def own_score_matchpoints(df: DataFrame, columns: list[str], score: str = "Score_NS", keys: list[str] = DEAL) -> DataFrame:
    """MP_c for each column c: over the rows of the session's deal and board, in all sections, 1, a half or 0 as the row's c is above, equal to or below the row's own score, summed; null compares as 0."""
    points = lambda c: F.when(F.col(c) > F.col(score), 1.0).when(F.col(c) == F.col(score), 0.5).otherwise(0.0)
    by = df.groupBy(*keys).agg(*[F.sum(points(c)).alias(f"MP_{c}") for c in columns])
    return df.join(by, keys)


def insert_score(freq: DataFrame, extra: DataFrame, keys: list[str] = BOARD) -> DataFrame:
    """Boards of extra(keys, score) with that score added: the whole board's beats, ties and pct (two places) again."""
    touched = freq.join(extra.select(*keys).distinct(), keys, "left_semi")
    both = touched.unionByName(extra.select(*keys, "score", F.lit(1).cast("long").alias("n"))).groupBy(*keys, "score").agg(F.sum("n").alias("n"))
    return score_frequencies(both, keys).withColumn("pct", F.round("pct", 2))


def capped(mp: Column, top: Column) -> Column:
    share = F.try_divide(mp, top + 1)
    return F.when(share > 1, F.lit(1.0)).otherwise(share)


def best_of(columns: list[str], top: Column) -> Column:
    """Best of a family of matchpoint columns as a share of top: null counts 0, at most 1, 0 where top is 0."""
    best = F.greatest(F.lit(0.0), *[F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    return F.when(top > 0, F.least(F.try_divide(best, top), F.lit(1.0))).otherwise(0.0)


def differences(df: DataFrame) -> DataFrame:
    """Six differences a row: Pct less EV_Pct_Max, Pct less DD_Pct_Max and DD_Pct_Max less EV_Pct_Max of both sides; null counts as 0."""
    less = lambda a, b: F.coalesce(F.col(a), F.lit(0.0)) - F.coalesce(F.col(b), F.lit(0.0))
    out = {}
    for p in ("NS", "EW"):
        out |= {f"EV_Pct_Max_Diff_{p}": less(f"Pct_{p}", f"EV_Pct_Max_{p}"), f"DD_Pct_Max_Diff_{p}": less(f"Pct_{p}", f"DD_Pct_Max_{p}"), f"DD_EV_Pct_Max_Diff_{p}": less(f"DD_Pct_Max_{p}", f"EV_Pct_Max_{p}")}
    return df.withColumns(out)
