"""Score table, theoretical scores, par, trick histograms and expected values, in long form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bridge as B
from ..functions.rows import computed


def score_table(spark: SparkSession) -> DataFrame:
    """(level, strain, dbl, vul, tricks, score, score_set, step): 2 940 rows, a bound that makes it safe to broadcast.

    score_set: the score if every failing contract is doubled; step: score gained by the last trick (null at 0).
    """
    arr = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    t = spark.range(1, 8).select(F.col("id").cast("int").alias("level")).withColumn("strain", arr("CDHSN")).withColumn("dbl", arr(["", "X", "XX"])).withColumn("vul", arr([False, True])).withColumn("tricks", arr(range(14)))
    score = lambda dbl, down: B.contract_score(F.col("level"), F.col("strain"), dbl, F.col("vul"), F.col("tricks") - 6 - F.col("level") - down)
    doubled = F.when((F.col("tricks") < F.col("level") + 6) & (F.col("dbl") == ""), F.lit("X")).otherwise(F.col("dbl"))
    step = F.when(F.col("tricks") > 0, score(F.col("dbl"), 0) - score(F.col("dbl"), 1))
    return t.withColumns({"score": score(F.col("dbl"), 0), "score_set": score(doubled, 0), "step": step})


def score_lists(spark: SparkSession) -> DataFrame:
    """(strain, nv, v): per level the scores at 0 to 13 tricks, failing contracts doubled, 5 rows."""
    t = score_table(spark).where("dbl = ''").groupBy("strain", "level", "vul").agg(F.sort_array(F.collect_list(F.struct("tricks", "score_set"))).alias("s"))
    t = t.groupBy("strain", "vul").agg(F.sort_array(F.collect_list(F.struct("level", F.transform("s", lambda x: x["score_set"]).alias("s")))).alias("s"))
    rows = F.transform("s", lambda x: x["s"])
    return t.groupBy("strain").agg(F.max(F.when(~F.col("vul"), rows)).alias("nv"), F.max(F.when(F.col("vul"), rows)).alias("v"))


CELLS = [(seat, strain) for seat in B.SEATS for strain in B.TRICK_STRAINS]


def deal_cells(dd: DataFrame) -> DataFrame:
    """dd(deal_id, Board, seat, strain, tricks) -> (deal_id, Board, cells): one row a deal, tricks in the order of CELLS, null where there are none."""
    cell = lambda seat, strain: F.max(F.when((F.col("seat") == seat) & (F.col("strain") == strain), F.col("tricks")))
    return dd.groupBy("deal_id", "Board").agg(F.array(*[cell(*c) for c in CELLS]).alias("cells"))


def cell_of(cells: Column, seat: Column, strain: Column) -> Column:
    """The tricks of a seat and strain; null for unknown ones."""
    known = (F.instr(F.lit(B.SEATS), seat) > 0) & (F.instr(F.lit(B.TRICK_STRAINS), strain) > 0)
    return F.when(known, F.get(cells, (F.instr(F.lit(B.SEATS), seat) - 1) * 5 + F.instr(F.lit(B.TRICK_STRAINS), strain) - 1))


def pair_tricks(dd: DataFrame) -> DataFrame:
    """dd(deal_id, Board, seat, strain, tricks) -> the better seat of each side."""
    return dd.groupBy("deal_id", "Board", B.side_of(F.col("seat")).alias("side"), "strain").agg(F.max("tricks").alias("tricks"))


def with_levels(dd: DataFrame) -> DataFrame:
    return dd.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(7))))


def contract_scores(cells: DataFrame) -> DataFrame:
    """cells(deal_id, Board, cells) -> a row for each seat, side and strain: the scores S1 to S7 of the levels, failing ones doubled, and their best."""
    c = F.col("cells")
    rows = [F.struct(F.lit(who).alias("who"), F.lit(strain).alias("strain"), (c[i * 5 + j] if len(who) == 1 else F.greatest(c[i * 5 + j], c[(i + 2) * 5 + j])).alias("tricks"))
            for i, who in [*enumerate(B.SEATS), (0, "NS"), (1, "EW")] for j, strain in enumerate(B.TRICK_STRAINS)]
    r = cells.select("deal_id", "Board", F.explode(F.array(*rows)).alias("r")).select("deal_id", "Board", "r.*")
    vul = B.seat_is_vulnerable(B.vul_code(F.col("Board")), F.col("who"))
    r = r.withColumns({f"S{n}": B.set_score(F.lit(n), F.col("strain"), vul, F.col("tricks")) for n in range(1, 8)})
    return r.withColumn("best", F.greatest(*[f"S{n}" for n in range(1, 8)]))


def making_and_sacrifice(dd: DataFrame) -> DataFrame:
    """Per seat and strain the highest making level and all above it, failing ones doubled; place orders a deal's scores, best first, then lower bids."""
    vul = B.seat_is_vulnerable(B.vul_code(F.col("Board")), F.col("seat"))
    made = F.col("tricks") >= F.col("level") + 6
    rows = with_levels(dd).where(F.col("level") >= F.greatest(F.lit(1), F.col("tricks") - 6))
    rows = rows.withColumn("score", B.contract_score(F.col("level"), F.col("strain"), F.when(made, "").otherwise("X"), vul, F.col("tricks") - 6 - F.col("level")))
    order = Window.partitionBy("deal_id").orderBy(F.col("score").desc(), "level", F.instr(F.lit(B.STRAINS), F.col("strain")), F.instr(F.lit(B.SEATS), F.col("seat")))
    return rows.withColumn("place", F.row_number().over(order))


def par(dd: DataFrame) -> DataFrame:
    """(deal_id, par_score for NS, contracts) of a trick table, long or with cells, with Board giving dealer and vulnerability. Other columns of a table with cells are kept.

    Every contract stands for its score if made, doubled if not. From the highest
    bid down, a side's bid is worth what the opponents leave of it: they pass or take their best higher bid. The side that deals speaks first;
    each seat may pass in turn. contracts: all that give exactly par, as level, strain, X, side and result; none for a passed-out board.
    """
    by = dd if "cells" in dd.columns else deal_cells(dd)
    tricks = F.array(*[F.greatest(F.col("cells")[side * 5 + B.TRICK_STRAINS.index(s)], F.col("cells")[(side + 2) * 5 + B.TRICK_STRAINS.index(s)]) for s in B.STRAINS for side in (0, 1)])
    # what par depends on, as a text: a letter for each side's tricks in a strain, the vulnerability, the dealer's side
    table = F.concat(F.array_join(F.transform(tricks, lambda t: F.when(t.between(0, 13), B.nth("0123456789ABCD", t))), "", "-"), B.vul_code(F.col("Board")).cast("string"), B.side_of(B.dealer_of(F.col("Board"))))
    # one generated struct a row: the join's test for nulls is not copied to below what makes the deals distinct
    by = computed(by, *by.columns, table.alias("_table"))
    solved = par_of_tables(by.select("_table").distinct())
    out = by.join(solved, "_table")
    return out.select(*(c for c in by.columns if c != "_table"), "par_score", "contracts") if "cells" in dd.columns else out.select("deal_id", "par_score", "contracts")


def par_of_tables(tables: DataFrame) -> DataFrame:
    """(_table, par_score, contracts) of distinct texts as par makes them: the bids are folded once for all deals that share a table."""
    at = lambda i: F.substring("_table", i + 1, 1)
    tricks = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.nullif(F.instr(F.lit("0123456789ABCD"), F.substring("_table", i + 1, F.lit(1))), F.lit(0)) - 1)
    by = tables.withColumns({"_tricks": tricks, "_code": at(10).cast("int"), "_ns": F.substring("_table", 12, 2) == "NS"})

    def bid(i: Column) -> Column:
        """The i-th of 70: levels and strains from the top, NS before EW."""
        level, place, ns = (7 - F.floor(i / 10)).cast("int"), (4 - F.floor(i % 10 / 2)).cast("int"), i % 2 == 0
        strain, over = B.nth(B.STRAINS, place), F.get("_tricks", place * 2 + i % 2) - 6 - level
        value = B.set_score(level, strain, F.col("_code").bitwiseAND(F.when(ns, 1).otherwise(2)) > 0, over + 6 + level)
        return F.struct((level * 5 + place + 1).alias("rank"), F.when(ns, "NS").otherwise("EW").alias("side"), F.when(ns, value).otherwise(-value).alias("value"), level.alias("level"), strain.alias("strain"), over.alias("over"))

    # sides without tricks in a strain cannot bid it
    by = by.withColumn("bids", F.filter(F.transform(F.sequence(F.lit(0), F.lit(69)), bid), lambda b: b["over"].isNotNull()))

    # sorted by descending rank, NS before EW within a rank; best values over strictly higher bids are kept until the rank changes
    start = F.struct(F.lit(-99999).alias("ns"), F.lit(99999).alias("ew"), F.lit(-99999).alias("ns_at"))

    def step(a, b):
        ns = b["side"] == "NS"
        worth = F.when(ns, F.least(b["value"], a["ew"])).otherwise(F.greatest(b["value"], a["ns"]))
        # NS comes first at a rank: its worth waits in ns_at until EW's bid of the same rank is done
        return F.struct(
            F.when(ns, a["ns"]).otherwise(F.greatest(a["ns"], a["ns_at"])).alias("ns"), F.when(ns, a["ew"]).otherwise(F.least(a["ew"], worth)).alias("ew"), F.when(ns, worth).otherwise(F.lit(-99999)).alias("ns_at"),
        )

    best = by.withColumn("best", F.aggregate("bids", start, step))
    ns, ew = F.col("best.ns"), F.col("best.ew")
    first = F.greatest(ns, F.least(ew, F.greatest(ns, F.least(ew, F.lit(0)))))
    second = F.least(ew, F.greatest(ns, F.least(ew, F.greatest(ns, F.lit(0)))))
    score = F.when(F.col("_ns"), first).otherwise(second)
    best = best.withColumn("par_score", score)
    text = lambda b: F.concat(b["level"].cast("string"), b["strain"], F.when(b["over"] < 0, "X").otherwise(""), F.lit(" "), b["side"], F.lit(" "), b["over"].cast("string"))
    par_bids = F.when(F.col("par_score") == 0, F.array().cast("array<string>")).otherwise(F.transform(F.filter("bids", lambda b: b["value"] == F.col("par_score")), text))
    return best.select("_table", "par_score", F.sort_array(par_bids).alias("contracts"))


def same_par(one: Column, two: Column) -> Column:
    """Whether two arrays of par contracts (as of par) mean the same: strain, doubling, side and tricks taken agree; 3N +1 is 4N 0."""
    def plain(text: Column) -> Column:
        part = F.split(text, " ")
        return F.concat_ws(" ", F.substring(part[0], F.lit(2), F.length(part[0])), part[1], (F.substring(part[0], 1, 1).cast("int") + part[2].cast("int")).cast("string"))

    return F.sort_array(F.transform(one, plain)) == F.sort_array(F.transform(two, plain))


def differing_pars(one: DataFrame, two: DataFrame) -> DataFrame:
    """Deals of two par tables (deal_id, par_score, contracts) whose score or contracts differ, or that one of them lacks."""
    a, b = (t.select("deal_id", F.col("par_score").alias(f"score_{n}"), F.col("contracts").alias(f"contracts_{n}")) for t, n in ((one, "one"), (two, "two")))
    same = F.coalesce((F.col("score_one") == F.col("score_two")) & same_par(F.col("contracts_one"), F.col("contracts_two")), F.lit(False))
    return a.join(b, "deal_id", "full").where(~same)


def differing(one: DataFrame, two: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of two tables whose values differ (null-safe) or that one of them lacks."""
    a = one.select(*keys, F.struct(*values).alias("one"))
    b = two.select(*keys, F.struct(*values).alias("two"))
    return a.join(b, keys, "full").where(~F.col("one").eqNullSafe(F.col("two")))


def par_sides(pars: DataFrame) -> DataFrame:
    return pars.withColumns({"Par_NS": F.col("par_score"), "Par_EW": -F.col("par_score")})


def trick_counts(samples: DataFrame) -> DataFrame:
    """samples(deal_id, Board, seat, strain, tricks) -> per deal, seat and strain: trials and counts, how often each trick count 0 to 13 came up. Tables of further samples go together by merge_counts."""
    n = F.count("tricks")
    return samples.groupBy("deal_id", "Board", "seat", "strain").agg(n.cast("long").alias("trials"), F.array(*[F.count(F.when(F.col("tricks") == t, 1)) for t in range(14)]).alias("counts"))


def merge_counts(*tables: DataFrame) -> DataFrame:
    """The table of trick_counts over all samples of several ones: counts and trials are added, so the order and the number of tables do not matter. Deals of one table alone are kept."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.groupBy("deal_id", "Board", "seat", "strain").agg(F.sum("trials").alias("trials"), F.array(*[F.sum(F.col("counts")[t]) for t in range(14)]).alias("counts"))


def trick_probabilities(counts: DataFrame) -> DataFrame:
    """probs, the share of each trick count in the trials; null without any."""
    return counts.withColumn("probs", F.array(*[F.try_divide(F.col("counts")[t], F.col("trials")) for t in range(14)])).drop("counts")


def trick_histograms(samples: DataFrame) -> DataFrame:
    """samples(deal_id, Board, seat, strain, tricks) -> per deal, seat and strain: trials and probs, the share of each trick count 0 to 13."""
    return trick_probabilities(trick_counts(samples))


#: by tricks and strain: the scores of levels 1 to 7 not vulnerable, then vulnerable, failing contracts doubled
_SET_SCORES = np.array([[[B.score_rule(level, B.STRAINS.index(s), int(t < level + 6), vul, t) for vul in (False, True) for level in range(1, 8)] for s in B.TRICK_STRAINS] for t in range(14)], float)


@F.arrow_udf(T.StructType([T.StructField(v, T.ArrayType(T.DoubleType())) for v in ("nv", "v")]))
def _mean_scores(strain: pa.Array, probs: pa.Array) -> pa.Array:
    """Means of a batch's rows, fourteen a row; nulls where a probability is missing."""
    n, whole = len(probs), pc.fill_null(pc.equal(pc.list_value_length(probs), 14), False)
    values = probs.filter(whole).flatten()
    rows, p = np.flatnonzero(whole.to_numpy(zero_copy_only=False)), values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, 14)
    lacks = values.is_null().to_numpy(zero_copy_only=False).reshape(-1, 14).any(axis=1)
    place = pc.index_in(strain, pa.array(list(B.TRICK_STRAINS))).to_numpy(zero_copy_only=False)[rows].astype(int)
    mean = np.zeros((len(rows), 14))
    for t in range(14):
        mean += p[:, t, None] * _SET_SCORES[t][place]
    out, none = np.zeros((n, 14)), np.ones(n, bool)
    out[rows], none[rows] = np.copysign(np.floor(np.abs(mean) * 1e6 + 0.5) / 1e6, mean) + 0.0, lacks
    ends = pa.array(np.arange(n + 1, dtype=np.int32) * 7)
    side = lambda x: pa.ListArray.from_arrays(ends, pa.array(x.ravel(), mask=np.repeat(none, 7)))
    return pa.StructArray.from_arrays([side(out[:, :7]), side(out[:, 7:])], ["nv", "v"])


def ev_lists(hist: DataFrame) -> DataFrame:
    """hist(..., strain, probs) with nv and v: per level the mean score over the trick probabilities, rounded to six places. Rows of unknown strains are left out."""
    both = hist.where(F.col("strain").isin(*B.TRICK_STRAINS)).withColumn("_means", _mean_scores("strain", "probs"))
    return both.withColumns({v: F.col(f"_means.{v}") for v in ("nv", "v")}).drop("_means")


def expected_values(hist: DataFrame) -> DataFrame:
    """Per deal, seat, strain: NV1 to NV7 and V1 to V7, the expected values of the levels."""
    e = ev_lists(hist)
    return e.select("deal_id", "Board", "seat", "strain", *[F.col(v)[n - 1].alias(f"{v.upper()}{n}") for v in ("nv", "v") for n in range(1, 8)])


#: expected values are packed above the place of their contract, so that one number holds both and is aggregated by hash
_SHIFT, _ZERO = 256, 2**34


def _best_level(evs: Column) -> Column:
    """The best of a seat and strain's levels, packed: its value in millionths, then its contract; of equal values the first in generation order (side, seat, strain with spades first, level) is largest."""
    cell = (F.instr(F.lit("NSEW"), F.col("seat")) - 1) * 35 + (F.instr(F.lit(B.TRICK_STRAINS), F.col("strain")) - 1) * 7
    # values have six places, so there are no halves to round
    return F.greatest(*[(F.rint(F.get(evs, F.lit(i)) * 1e6).cast("long") + _ZERO) * _SHIFT + (_SHIFT - 1 - i) - cell for i in range(7)])


def _value(packed: Column) -> Column:
    return (F.floor(packed / _SHIFT) - _ZERO) / 1e6


def _contract(packed: Column) -> Column:
    """The packed contract, like 4S N."""
    place = (_SHIFT - 1) - F.pmod(packed, F.lit(_SHIFT))
    return F.concat((place % 7 + 1).cast("int").cast("string"), B.nth(B.TRICK_STRAINS, F.floor(place / 7) % 5), F.lit(" "), B.nth("NSEW", F.floor(place / 35)))


def best_contracts(evs: DataFrame) -> DataFrame:
    """evs of ev_lists -> best expected value and its contract per deal and vulnerability at five grains: deal, side, seat, strain, seat and strain; ties go to the first in generation order."""
    rows = evs.select("deal_id", "seat", "strain", _best_level(F.col("nv")).alias("nv"), _best_level(F.col("v")).alias("v"))
    # a deal's twenty cells, and no more, side by side; the grains are maxima over some of them
    cell = lambda who, strain, c: F.max(F.when((F.col("seat") == who) & (F.col("strain") == strain), F.col(c)))
    places = [(who, strain) for who in B.SEATS for strain in B.TRICK_STRAINS]
    by = rows.groupBy("deal_id").agg(*[F.array(*[cell(who, strain, c) for who, strain in places]).alias(c) for c in ("nv", "v")])
    grains = [(None, None, None), *[(p, None, None) for p in ("NS", "EW")], *[(None, w, None) for w in B.SEATS], *[(None, None, s) for s in B.TRICK_STRAINS], *[(None, w, s) for w, s in places]]

    def top(c: str, side: str | None, seat: str | None, strain: str | None) -> Column:
        own = [F.col(c)[i] for i, (w, s) in enumerate(places) if (side is None or w in side) and seat in (None, w) and strain in (None, s)]
        return own[0] if len(own) == 1 else F.greatest(*own)

    text = lambda x: F.lit(x).cast("string")
    out = [F.struct(F.lit(vul).alias("vul"), *[text(x).alias(k) for k, x in zip(("side", "seat", "strain"), g)], top(c, *g).alias("top")) for vul, c in ((False, "nv"), (True, "v")) for g in grains]
    g = by.select("deal_id", F.inline(F.array(*out))).where("top is not null")
    return g.select("deal_id", "vul", "side", "seat", "strain", _value(F.col("top")).alias("ev"), _contract(F.col("top")).alias("contract"))


def applicable_ev(evs: DataFrame) -> DataFrame:
    """evs of ev_lists at the board's own vulnerability -> per deal the best of each side and its contract, the best of all and its side (NS on ties)."""
    own = F.when(B.seat_is_vulnerable(B.vul_code(F.col("Board")), F.col("seat")), F.col("v")).otherwise(F.col("nv"))
    rows = evs.select("deal_id", "seat", _best_level(own).alias("b"))
    top = lambda p: F.max(F.when(B.side_of(F.col("seat")) == p, F.col("b")))
    by = rows.groupBy("deal_id").agg(top("NS").alias("n"), top("EW").alias("e"))
    by = by.select("deal_id", _value(F.col("n")).alias("EV_Max_NS"), _value(F.col("e")).alias("EV_Max_EW"), _contract(F.col("n")).alias("EV_Contract_NS"), _contract(F.col("e")).alias("EV_Contract_EW"))
    return by.withColumns({"EV_Max": F.greatest("EV_Max_NS", "EV_Max_EW"), "EV_Side": F.when(F.col("EV_Max_NS") >= F.col("EV_Max_EW"), "NS").otherwise("EW")})


def declarer_ev(df: DataFrame) -> DataFrame:
    """EV_Max_Declarer and its contract: those of the declarer's side; EW's where no side declares."""
    ns = F.col("Declarer_Pair") == "NS"
    return df.withColumns({"EV_Max_Declarer": F.when(ns, F.col("EV_Max_NS")).otherwise(F.col("EV_Max_EW")), "EV_Contract_Declarer": F.when(ns, F.col("EV_Contract_NS")).otherwise(F.col("EV_Contract_EW"))})


def type_of_tricks(tricks: Column, strain: Column) -> Column:
    game = F.when(strain.isin("C", "D"), 11).when(strain == "N", 9).otherwise(10)
    return F.when(tricks < 7, "Pass").when(tricks == 13, "GSlam").when(tricks == 12, "SSlam").when(tricks >= game, "Game").otherwise("Partial")


def type_of_bid(level: Column, strain: Column) -> Column:
    """Type of a bid contract; null level is a pass."""
    game = F.when(strain.isin("C", "D"), 5).when(strain == "N", 3).otherwise(4)
    return F.when(level.isNull(), "Pass").when(level == 7, "GSlam").when(level == 6, "SSlam").when(level >= game, "Game").otherwise("Partial")


TYPES = ("Pass", "Partial", "Game", "SSlam", "GSlam")


def contract_type_flags(dd: DataFrame) -> DataFrame:
    """Per deal, side and strain whether a seat of the side can make each contract type."""
    kind = type_of_tricks(F.col("tricks"), F.col("strain"))
    return dd.groupBy("deal_id", B.side_of(F.col("seat")).alias("side"), "strain").agg(*[F.max(kind == t).alias(f"CT_{t}") for t in TYPES])


def filter_boards(df: DataFrame, vul: str | None = None, side: str | None = None, strain: str | None = None, kind: str | None = None, doubled: bool | None = None) -> DataFrame:
    """Rows with the given vulnerability name, declaring side, strain, contract type and doubling; parameters left out don't filter."""
    if vul:
        df = df.where(F.col("Vul") == vul)
    for column, value in (("Declarer_Pair", side), ("BidSuit", strain), ("ContractType", kind)):
        if value:
            df = df.where(F.col(column) == value)
    return df if doubled is None else df.where((F.col("Dbl") != "") == doubled)


def score_predictions(df: DataFrame, prefix: str) -> DataFrame:
    """prefix_Tricks (predicted), actual Tricks, strain, vul -> prefix_Level, Bid, Result, Type, Score by rule; under seven tricks is a pass."""
    level = F.greatest(F.col(f"{prefix}_Tricks") - 6, F.lit(0))
    df = df.withColumn(f"{prefix}_Level", level)
    lv, bid = F.col(f"{prefix}_Level"), F.col(f"{prefix}_Level") > 0
    result = F.when(bid, F.col("Tricks") - F.col(f"{prefix}_Tricks"))
    return df.withColumns({
        f"{prefix}_Bid": F.when(bid, F.concat(lv.cast("string"), F.col("strain"))).otherwise("PASS"), f"{prefix}_Result": result,
        f"{prefix}_Type": type_of_tricks(F.col(f"{prefix}_Tricks"), F.col("strain")), f"{prefix}_Score": F.when(bid, B.contract_score(lv, F.col("strain"), F.lit(""), F.col("vul"), result)).otherwise(0),
    })
