"""Deal and hand features: projections over the deal text, without shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bridge as B

PAIRS = {"NS": "NS", "EW": "EW"}


def parse_hands(df: DataFrame) -> DataFrame:
    """PBN -> Hands (array by seat of arrays by suit), Hand_N.. and Suit_N_S..; suits that are void are empty strings."""
    df = df.withColumn("Hands", B.hands(F.col("PBN")))
    cols = {f"Hand_{d}": F.array_join(F.col("Hands")[i], ".") for i, d in enumerate(B.SEATS)}
    cols |= {f"Suit_{d}_{s}": F.col("Hands")[i][j] for i, d in enumerate(B.SEATS) for j, s in enumerate(B.SUITS)}
    return df.withColumns(cols)


def suits_long(df: DataFrame) -> DataFrame:
    """PBN -> one row a seat and suit: all other columns, seat, suit, cards. The long form of every suit metric."""
    keep = [c for c in df.columns if c != "PBN"]
    seats = df.select(*keep, F.posexplode(B.hands(F.col("PBN"))).alias("_i", "_h"))
    rows = seats.select(*keep, B.nth(B.SEATS, F.col("_i")).alias("seat"), F.posexplode("_h").alias("_j", "cards"))
    return rows.select(*keep, "seat", B.nth(B.SUITS, F.col("_j")).alias("suit"), "cards")


def add_dealer(df: DataFrame) -> DataFrame:
    """Dealer from Board, if absent."""
    return df if "Dealer" in df.columns else df.withColumn("Dealer", B.dealer_of(F.col("Board")))


def add_vulnerability(df: DataFrame) -> DataFrame:
    """iVul, Vul (name), Vul_NS, Vul_EW; from Vul where it is given (unknown names give null), else from Board."""
    if "Vul" in df.columns:
        code = B.lookup({v: i for i, v in enumerate(B.VULS)}, F.col("Vul"))
    else:
        code = B.vul_code(F.col("Board"))
    df = df.withColumn("iVul", code)
    return df.withColumns({"Vul": B.vul_name(F.col("iVul")), "Vul_NS": B.seat_is_vulnerable(F.col("iVul"), F.lit("N")), "Vul_EW": B.seat_is_vulnerable(F.col("iVul"), F.lit("E"))})


def add_default_keys(df: DataFrame) -> DataFrame:
    """group_id and session_id, 0 where the frame lacks them."""
    return df.withColumns({c: F.lit(0) for c in ("group_id", "session_id") if c not in df.columns})


def add_card_flags(df: DataFrame) -> DataFrame:
    """Cards: array<boolean>(208), seat by seat (N, E, S, W), suit by suit (S, H, D, C), ace to two."""
    flags = F.transform(F.split(F.lit(B.RANKS), ""), lambda r: r)
    return df.withColumn("Cards", F.flatten(F.transform(F.flatten(B.hands(F.col("PBN"))), lambda s: F.transform(flags, lambda r: F.contains(s, r)))))


def card_flag(seat: str, suit: str, rank: str) -> Column:
    """One flag of the Cards array."""
    return F.col("Cards")[B.SEATS.index(seat) * 52 + B.SUITS.index(suit) * 13 + B.RANKS.index(rank)]


def hand_mask(hand: Column) -> Column:
    """52-bit mask of a hand (array of suits S, H, D, C): ace 1 << 12 ... two 1, spades highest."""
    suit = lambda s: F.aggregate(F.split(s, ""), F.lit(0).cast("long"), lambda a, r: a + F.when(r == "", F.lit(0)).otherwise(F.pow(F.lit(2), 13 - F.instr(F.lit(B.RANKS), r))).cast("long"))
    return F.aggregate(F.transform(hand, suit), F.lit(0).cast("long"), lambda a, m: a * 8192 + m)


def mask_to_hand(mask: Column) -> Column:
    """The hand text (suits joined by dots) of a mask."""
    bit = lambda i: F.lit(1 << i).cast("long")
    suits = [F.concat(*[F.when(mask.bitwiseAND(bit(13 * (3 - j) + 12 - i)) != 0, r).otherwise("") for i, r in enumerate(B.RANKS)]) for j in range(4)]
    return F.concat_ws(".", *suits)


def add_hand_masks(df: DataFrame) -> DataFrame:
    """Mask_d (bigint), Bin_d (52 binary digits), Hex_d (13 hexadecimal digits)."""
    h = B.hands(F.col("PBN"))
    df = df.withColumns({f"Mask_{d}": hand_mask(h[i]) for i, d in enumerate(B.SEATS)})
    return df.withColumns({f"Bin_{d}": F.lpad(F.bin(f"Mask_{d}"), 52, "0") for d in B.SEATS} | {f"Hex_{d}": F.lpad(F.hex(f"Mask_{d}"), 13, "0") for d in B.SEATS})


def metric_columns(df: DataFrame, name: str, of_suit) -> DataFrame:
    """A suit metric as columns name_d_s, name_d, name_NS, name_EW, name_NS_s, name_EW_s."""
    # the sixteen suits are cut out once, in a projection of their own
    df = df.withColumn("_suits", F.split(F.substring("PBN", F.lit(3), F.length("PBN")), "[ .]", -1))
    by = {f"{name}_{d}_{s}": of_suit(F.get("_suits", F.lit(4 * i + j))) for i, d in enumerate(B.SEATS) for j, s in enumerate(B.SUITS)}
    df = df.withColumns(by).drop("_suits")
    total = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0]))
    df = df.withColumns({f"{name}_{d}": total([f"{name}_{d}_{s}" for s in B.SUITS]) for d in B.SEATS})
    pairs = {f"{name}_{p}": total([f"{name}_{d}" for d in p]) for p in PAIRS}
    pairs |= {f"{name}_{p}_{s}": total([f"{name}_{d}_{s}" for d in p]) for p in PAIRS for s in B.SUITS}
    return df.withColumns(pairs)


def add_hcp(df: DataFrame) -> DataFrame:
    return metric_columns(df, "HCP", B.suit_hcp)


def add_quick_tricks(df: DataFrame) -> DataFrame:
    return metric_columns(df, "QT", B.suit_quick_tricks)


def add_losers(df: DataFrame, prefix: str = "LTC") -> DataFrame:
    """Losing trick count; with prefix QL the quick losers, which are the same formula."""
    return metric_columns(df, prefix, B.suit_losers)


def add_suit_lengths(df: DataFrame) -> DataFrame:
    return metric_columns(df, "SL", F.length)


def add_distribution_points(df: DataFrame) -> DataFrame:
    return metric_columns(df, "DP", B.suit_distribution)


def add_total_points(df: DataFrame) -> DataFrame:
    return metric_columns(df, "Total_Points", lambda s: B.suit_hcp(s) + B.suit_distribution(s))


def add_shapes(df: DataFrame, seat: str) -> DataFrame:
    """SL_d_CDHS (lengths, clubs first), SL_d_ML (longest first), SL_d_ML_I (suit numbers, longest first, lower suit first), both also joined by dashes."""
    h = B.hands(F.col("PBN"))[B.SEATS.index(seat)]
    lengths = F.transform(F.reverse(h), F.length)
    order = F.array_sort(F.transform(lengths, lambda n, i: F.struct((-n).alias("n"), i.alias("i"))))
    df = df.withColumns({f"SL_{seat}_CDHS": lengths, f"SL_{seat}_ML": F.sort_array(lengths, asc=False), f"SL_{seat}_ML_I": F.transform(order, lambda x: x["i"])})
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), "-")
    return df.withColumns({f"SL_{seat}_CDHS_SJ": text(f"SL_{seat}_CDHS"), f"SL_{seat}_ML_SJ": text(f"SL_{seat}_ML"), f"SL_{seat}_ML_I_SJ": text(f"SL_{seat}_ML_I")})


def add_longest_suit(df: DataFrame) -> DataFrame:
    """SL_Max_p and the name of the first suit column that equals it, S before H before D before C; needs suit lengths."""
    out = {}
    for p in PAIRS:
        names = [f"SL_{p}_{s}" for s in B.SUITS]
        top = F.greatest(*names)
        first = F.coalesce(*[F.when(F.col(n) == top, F.lit(n)) for n in names])
        out |= {f"SL_Max_{p}": top, f"SL_Max_{p}_Col": first}
    return df.withColumns(out)


# fixed values: choices of (least length, least points, least sum of both); one choice must hold
QUALITY = {
    "Biddable": ((5, 0, 0), (4, 3, 0)), "Rebiddable": ((6, 0, 0), (5, 3, 0)), "Twice_Rebiddable": ((7, 0, 0), (6, 3, 0)), "Strong_Rebiddable": ((6, 9, 0),), "Solid": ((0, 9, 0),),
    "Partial_Stop_In": ((0, 0, 4),), "Likely_Stop_In": ((0, 0, 5),), "Stop_In": ((0, 4, 0), (0, 0, 6)), "At_Best_Stop_In": ((0, 0, 7),), "Two_Stops_In": ((0, 0, 8),),
}
#: fixed values: flags that hold where the sum of length and points is below a bound
QUALITY_BELOW = {"At_Best_Partial_Stop_In": 4}
FORCING = ("Forcing_One_Round", "Opponents_Cannot_Play_Undoubled_Below_2N", "Forcing_To_2N", "Forcing_To_3N")


def suit_flags(cards: Column, rules: dict | None = None) -> dict[str, Column]:
    """The flags of a suit: those of a table of choices, by default QUALITY and QUALITY_BELOW."""
    return quality_flags(F.length(cards), B.suit_hcp(cards), rules)


def quality_flags(n: Column, p: Column, rules: dict | None = None) -> dict[str, Column]:
    """The flags of a suit by its length and high card points."""
    out = {}
    for name, choices in (QUALITY if rules is None else rules).items():
        out[name] = F.lit(False)
        for length, points, total in choices:
            out[name] = out[name] | ((n >= length) & (p >= points) & (n + p >= total))
    return out | ({name: n + p < bound for name, bound in QUALITY_BELOW.items()} if rules is None else {})


def add_suit_quality(df: DataFrame, rules: dict | None = None) -> DataFrame:
    """rule_d_s flags for each rule of a table, and the constant forcing flags by seat."""
    h = B.hands(F.col("PBN"))
    flags = {f"{k}_{d}_{s}": c for i, d in enumerate(B.SEATS) for j, s in enumerate(B.SUITS) for k, c in suit_flags(h[i][j], rules).items()}
    return df.withColumns(flags | {f"{k}_{d}": F.lit(True) for k in FORCING for d in B.SEATS})


def balanced(hand: Column) -> Column:
    """4-3-3-3 or 4-4-3-2; 5-3-3-2 or 5-4-2-2 if the five-card suit is a minor: no suit shorter than two, none longer than four but a minor of five."""
    n = [F.length(hand[j]) for j in range(4)]
    minor = (n[2] == 5) | (n[3] == 5)
    top = F.greatest(*n)
    return (n[0] + n[1] + n[2] + n[3] == 13) & (F.least(*n) >= 2) & ((top == 4) | (top == 5) & minor)


def add_balanced(df: DataFrame) -> DataFrame:
    h = F.col("_hands")
    return df.withColumn("_hands", B.hands(F.col("PBN"))).withColumns({f"Balanced_{d}": balanced(h[i]) for i, d in enumerate(B.SEATS)}).drop("_hands")


def expand_metric(df: DataFrame, nested: str, name: str) -> DataFrame:
    """A nested metric array<struct<total, suits>> by seat -> name_d, name_d_s and pair sums."""
    c = F.col(nested)
    out = {f"{name}_{d}": c[i]["total"] for i, d in enumerate(B.SEATS)} | {f"{name}_{d}_{s}": c[i]["suits"][j] for i, d in enumerate(B.SEATS) for j, s in enumerate(B.SUITS)}
    out |= {f"{name}_{p}": c[B.SEATS.index(p[0])]["total"] + c[B.SEATS.index(p[1])]["total"] for p in PAIRS}
    out |= {f"{name}_{p}_{s}": c[B.SEATS.index(p[0])]["suits"][j] + c[B.SEATS.index(p[1])]["suits"][j] for p in PAIRS for j, s in enumerate(B.SUITS)}
    return df.withColumns(out)


def add_pair_length_sums(df: DataFrame) -> DataFrame:
    """LoTT_NS, LoTT_EW: the sum of a side's four suit lengths, always 26; kept under the name it is known by."""
    return df.withColumns({f"LoTT_{p}": sum((F.col(f"SL_{p}_{s}") for s in "HDC"), F.col(f"SL_{p}_S")) for p in PAIRS})


def total_tricks(dd: DataFrame, lengths: DataFrame) -> DataFrame:
    """dd(deal_id, seat, strain, tricks), lengths(deal_id, side, suit, length) -> per deal: tricks, trumps, difference of both sides' best suits.

    A side's best suit is the longest; of equal ones that with more tricks, then the higher suit. Both sides of the join have rows of deals, which are never
    broadcast: their files are small for what they hold.
    """
    best = dd.where("strain <> 'N'").groupBy("deal_id", B.side_of(F.col("seat")).alias("side"), F.col("strain").alias("suit")).agg(F.max("tricks").alias("tricks"))
    top = best.join(lengths.hint("merge"), ["deal_id", "side", "suit"]).groupBy("deal_id", "side").agg(F.max(F.struct("length", "tricks", F.instr(F.lit("CDHS"), F.col("suit")))).alias("top"))
    out = top.groupBy("deal_id").agg(F.sum("top.tricks").alias("tricks"), F.sum("top.length").alias("trumps"))
    return out.withColumn("difference", F.col("tricks") - F.col("trumps"))
