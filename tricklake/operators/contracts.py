"""Final contract and result columns of board results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bridge as B
from .scoring import type_of_bid


def split_contract(df: DataFrame) -> DataFrame:
    """Contract (like 4HXN) -> BidLvl, BidSuit, Dbl, Declarer_Direction, Declarer_Pair, Declarer_Vul, LHO, Dummy, RHO, ContractType; null for PASS and null, only the type of PASS is Pass."""
    c = F.col("Contract")
    bid = c.isNotNull() & (c != "PASS")
    seat = F.when(bid, F.right(c, F.lit(1)))
    df = df.withColumns({"BidLvl": F.when(bid, F.substring(c, 1, 1).try_cast("int")), "BidSuit": F.when(bid, F.substring(c, 2, 1)), "Dbl": F.when(bid, F.substring(c, F.lit(3), F.length(c) - 3)), "Declarer_Direction": seat})
    d = F.col("Declarer_Direction")
    return df.withColumns({
        "Declarer_Pair": B.side_of(d), "Declarer_Vul": B.seat_is_vulnerable(B.vul_code(F.col("Board")), d), "LHO": B.lookup(B.NEXT, d), "Dummy": B.lookup(B.PARTNER, d),
        "RHO": B.lookup({v: k for k, v in B.NEXT.items()}, d), "ContractType": F.when(bid | (c == "PASS"), type_of_bid(F.col("BidLvl"), F.col("BidSuit"))),
    })


def of_seat(prefix: str, seat: Column) -> Column:
    """The value of one of four columns prefix_N .. prefix_W."""
    return F.when(seat == "N", F.col(f"{prefix}_N")).when(seat == "E", F.col(f"{prefix}_E")).when(seat == "S", F.col(f"{prefix}_S")).when(seat == "W", F.col(f"{prefix}_W"))


def declarer_id(df: DataFrame) -> DataFrame:
    return df.withColumn("Declarer_ID", of_seat("Player_ID", F.col("Declarer_Direction")))


def pair_arrays(df: DataFrame) -> DataFrame:
    """Player_IDs_NS and Player_IDs_EW from the four seats."""
    return df.withColumns({f"Player_IDs_{p}": F.array(*[F.col(f"Player_ID_{d}") for d in p]) for p in ("NS", "EW")})


def seats_of_arrays(df: DataFrame) -> DataFrame:
    """The seats again from the arrays."""
    return df.withColumns({f"Player_ID_{d}": F.col(f"Player_IDs_{p}")[i] for p in ("NS", "EW") for i, d in enumerate(p)})


def result_from_score(df: DataFrame) -> DataFrame:
    """Result_From_Score: the smallest trick count whose score is the declaring side's, less level and six; null if no count gives it. Result_Consistent compares it with Result.

    The contract's fourteen scores are computed in the row, so there is no join.
    """
    own = F.when(F.col("Declarer_Pair") == "NS", F.col("Score_NS")).otherwise(-F.col("Score_NS"))
    results = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda t: t - 6 - F.col("BidLvl"))
    found = F.filter(results, lambda r: B.contract_score(F.col("BidLvl"), F.col("BidSuit"), F.col("Dbl"), F.col("Declarer_Vul"), r) == own)
    df = df.withColumn("Result_From_Score", F.when(F.col("BidLvl").isNotNull(), F.try_element_at(found, F.lit(1))))
    return df.withColumn("Result_Consistent", F.col("Result_From_Score").isNull() | F.col("Result_From_Score").eqNullSafe(F.col("Result")))


def result_from_tricks(df: DataFrame) -> DataFrame:
    return df.withColumn("Result_From_Tricks", F.col("Tricks") - 6 - F.col("BidLvl"))


def tricks_from_result(df: DataFrame) -> DataFrame:
    return df.withColumn("Tricks_From_Result", F.col("BidLvl") + 6 + F.col("Result"))


def side_scores(df: DataFrame) -> DataFrame:
    """Score_NS where it is given, else by rule (0 for PASS); Score_EW is its negative; Score_Declarer the declarer's side's."""
    rule = B.contract_score(F.col("BidLvl"), F.col("BidSuit"), F.col("Dbl"), F.col("Declarer_Vul"), F.col("Result"))
    rule = F.when(F.col("Contract") == "PASS", 0).otherwise(F.when(F.col("Declarer_Pair") == "NS", rule).otherwise(-rule))
    df = df.withColumn("Score_NS", F.coalesce(F.col("Score_NS"), rule)) if "Score_NS" in df.columns else df.withColumn("Score_NS", rule)
    return df.withColumns({"Score_EW": -F.col("Score_NS"), "Score_Declarer": F.when(F.col("Declarer_Pair") == "NS", F.col("Score_NS")).when(F.col("Declarer_Pair") == "EW", -F.col("Score_NS"))})


def join_deals(df: DataFrame, deals: DataFrame) -> DataFrame:
    """Add DD_Tricks and DD_Tricks_Dummy of the contract, and what else deals(deal_id, Board, cells, ...) holds; one join on the deal, one row a deal."""
    from .scoring import cell_of

    df = df.join(deals.drop("Board"), "deal_id", "left")
    return df.withColumns({"DD_Tricks": cell_of(F.col("cells"), F.col("Declarer_Direction"), F.col("BidSuit")), "DD_Tricks_Dummy": cell_of(F.col("cells"), F.col("Dummy"), F.col("BidSuit"))}).drop("cells")


def dd_score(df: DataFrame) -> DataFrame:
    """DD_Score_Declarer: the score of the contract's level and strain at DD_Tricks, doubled if it fails, whatever the contract's own doubling; DD_Score_Max_Declarer the best of all levels; DD_Score_NS and EW, 0 without a declarer."""
    df = df.withColumns({
        "DD_Score_Declarer": B.set_score(F.col("BidLvl"), F.col("BidSuit"), F.col("Declarer_Vul"), F.col("DD_Tricks")),
        "DD_Score_Max_Declarer": B.best_set_score(F.col("BidSuit"), F.col("Declarer_Vul"), F.col("DD_Tricks")),
    })
    own = F.col("DD_Score_Declarer")
    return df.withColumns({"DD_Score_NS": F.when(F.col("Declarer_Pair") == "NS", own).when(F.col("Declarer_Pair") == "EW", -own).otherwise(0), "DD_Score_EW": F.when(F.col("Declarer_Pair") == "EW", own).when(F.col("Declarer_Pair") == "NS", -own).otherwise(0)})


def differences(df: DataFrame) -> DataFrame:
    """Par_Diff_NS, Par_Diff_EW and DD_Tricks_Diff; EV_Max_Diff_NS, EV_Max_Diff_EW where the best expected values are there. Needs Par_NS and DD_Tricks."""
    out = {"Par_Diff_NS": F.col("Score_NS") - F.col("Par_NS"), "Par_Diff_EW": F.col("Par_NS") - F.col("Score_NS"), "DD_Tricks_Diff": F.col("Tricks") - F.col("DD_Tricks")}
    if "EV_Max_NS" in df.columns:
        out |= {"EV_Max_Diff_NS": F.col("Score_NS") - F.col("EV_Max_NS"), "EV_Max_Diff_EW": -F.col("Score_NS") - F.col("EV_Max_EW")}
    return df.withColumns(out)


def roles(df: DataFrame) -> DataFrame:
    """OnLead, NotOnLead, their ids, the reference to the contract's expected value, and whether the strain's best (Is_Par_Suit) or the contract's theoretical score (Is_Par_Contract) is par, the latter below 0 (Is_Sacrifice), and the declarer's score at most par (Defender_Par_GE). Needs Par_NS and dd_score."""
    par = F.when(F.col("Declarer_Pair") == "NS", F.col("Par_NS")).otherwise(-F.col("Par_NS"))
    score = F.when(F.col("Contract") == "PASS", 0).otherwise(F.col("Score_Declarer"))
    at_par = par == F.col("DD_Score_Declarer")
    ref = F.concat_ws("_", F.lit("EV"), "Declarer_Pair", "Declarer_Direction", "BidSuit", F.col("BidLvl").cast("string"), F.when(F.col("Declarer_Vul"), "V").otherwise("NV"))
    return df.withColumns({
        "OnLead": F.col("LHO"), "NotOnLead": F.col("RHO"), "OnLead_ID": of_seat("Player_ID", F.col("LHO")), "NotOnLead_ID": of_seat("Player_ID", F.col("RHO")), "Dummy_ID": of_seat("Player_ID", F.col("Dummy")), "EV_Score_Col_Declarer": F.when(F.col("BidLvl").isNotNull(), ref),
        "Is_Par_Suit": par == F.col("DD_Score_Max_Declarer"), "Is_Par_Contract": at_par, "Is_Sacrifice": at_par & (F.col("DD_Score_Declarer") < 0), "Defender_Par_GE": score <= par,
    })


def declarer_probabilities(df: DataFrame, deals: DataFrame) -> DataFrame:
    """probs, the trick probabilities of the contract's own declarer and strain, from deals(deal_id, hists): a row a deal, hists having seats N, E, S, W by strains S, H, D, C, N. One join; null without a bid or a deal."""
    cell = (F.instr(F.lit(B.SEATS), F.col("Declarer_Direction")) - 1) * 5 + F.instr(F.lit(B.TRICK_STRAINS), F.col("BidSuit")) - 1
    joined = df.join(deals.select("deal_id", F.col("hists").alias("_hists")), "deal_id", "left")
    return joined.withColumn("probs", F.when(F.col("Declarer_Direction").isNotNull() & F.col("BidSuit").isNotNull(), F.get("_hists", cell.cast("int")))).drop("_hists")


def trick_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({"OverTricks": F.col("Result") > 0, "JustMade": F.col("Result") == 0, "UnderTricks": F.col("Result") < 0})


def player_means(df: DataFrame) -> DataFrame:
    """Mean trick difference of each declarer and mean Defender_Par_GE of each leader and other defender, on every row; rows without such a player have their own mean.

    All three means come from one aggregate, so a busy player is no hot window; it goes to a table in the shared folder that three joins read.
    """
    from ..sources.folders import shared_folder

    good = F.col("Defender_Par_GE").cast("double")
    means = [("Declarer_ID", F.col("DD_Tricks_Diff").cast("double"), "Declarer_Rating"), ("OnLead_ID", good, "Defender_OnLead_Rating"), ("NotOnLead_ID", good, "Defender_NotOnLead_Rating")]
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(name).alias("mean"), F.col(key).alias("id"), value.alias("value")) for key, value, name in means])).alias("r")).select("r.*")
    by, path = rows.groupBy("mean", "id").agg(F.avg("value").alias("value")), shared_folder(df.sparkSession, "player-means")
    by.write.parquet(path)
    by = df.sparkSession.read.schema(by.schema).parquet(path)
    for key, _, name in means:
        df = df.join(by.where(F.col("mean") == name).select(F.col("id").alias("_k"), F.col("value").alias(name)), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    return df


def parse_dates(df: DataFrame, column: str) -> DataFrame:
    """Timestamp text -> date; other text gives null."""
    return df.withColumn("Date", F.to_date(F.try_to_timestamp(F.col(column), F.lit("yyyy-MM-dd HH:mm:ss"))))


def viewpoint(df: DataFrame, side: str, pair: int, seat: str) -> DataFrame:
    """Flags from a pair's and player's view."""
    mine = F.coalesce(F.col(f"Pair_Number_{side}") == pair, F.lit(False))
    d = F.coalesce(F.col("Declarer_Direction"), F.lit(""))
    return df.withColumns({
        "Boards_We_Played": mine, "Boards_I_Declared": mine & (d == seat), "Boards_Partner_Declared": mine & (d == B.PARTNER[seat]), "Boards_We_Declared": mine & d.isin(*side),
        "Boards_Opponent_Declared": mine & ~d.isin(*side) & F.coalesce(F.col("Contract") != "PASS", F.lit(False)),
    })


def canonical(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns; an error if every contract is null."""
    if not df.where("Contract is not null").limit(1).count():
        raise ValueError("every Contract is null")
    return df.select(columns)
