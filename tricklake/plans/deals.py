"""Queries HND1 to HND20 and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import bridge as B
from ..operators import deals as D

Q, O = {}, {}


def reg(name, run, sql, *ctes):
    Q[name] = run
    if sql:
        O[name] = X.oracle(sql, *ctes)


def by_seat(expr: str, name: str, seats="NESW", suits="") -> str:
    """DuckDB: max of expr over the suits table, per seat (and suit)."""
    if suits:
        return ", ".join(f"max({expr}) FILTER (seat = {B.SEATS.index(d)} AND suit = {B.SUITS.index(s)}) AS {name}_{d}_{s}" for d in seats for s in suits)
    return ", ".join(f"sum({expr}) FILTER (seat = {B.SEATS.index(d)}) AS {name}_{d}" for d in seats)


def metric_sql(expr: str, name: str, kind: str = "INTEGER") -> str:
    """All columns of a suit metric."""
    e = f"({expr})"
    cols = [f"sum{e} FILTER (seat = {i} AND suit = {j})::{kind} AS {name}_{d}_{s}" for i, d in enumerate(B.SEATS) for j, s in enumerate(B.SUITS)]
    cols += [f"sum{e} FILTER (seat = {i})::{kind} AS {name}_{d}" for i, d in enumerate(B.SEATS)]
    cols += [f"sum{e} FILTER (seat % 2 = {i})::{kind} AS {name}_{p}" for i, p in enumerate(("NS", "EW"))]
    cols += [f"sum{e} FILTER (seat % 2 = {i} AND suit = {j})::{kind} AS {name}_{p}_{s}" for i, p in enumerate(("NS", "EW")) for j, s in enumerate(B.SUITS)]
    return f"SELECT deal_id, {', '.join(cols)} FROM suits GROUP BY deal_id"


HCP = "length(replace(translate(cards, 'KQJT98765432', ''), ' ', '')) * 4 + length(translate(cards, 'AQJT98765432', '')) * 3 + length(translate(cards, 'AKJT98765432', '')) * 2 + length(translate(cards, 'AKQT98765432', ''))"
QT = "CASE WHEN cards LIKE 'AK%' THEN 2.0 WHEN cards LIKE 'AQ%' THEN 1.5 WHEN cards LIKE 'A%' OR cards LIKE 'KQ%' THEN 1.0 WHEN cards LIKE 'K%' THEN 0.5 ELSE 0.0 END"
HAS = {r: f"contains(cards, '{r}')::INTEGER" for r in "AKQ"}
LTC = f"""CASE length(cards) WHEN 0 THEN 0 WHEN 1 THEN 1 - {HAS['A']} WHEN 2 THEN CASE WHEN cards LIKE 'AK%' THEN 0 WHEN cards LIKE 'A%' OR cards LIKE 'K%' THEN 1 ELSE 2 END
 ELSE 3 - {HAS['A']} - {HAS['K']} - {HAS['Q']} END"""
DP = "greatest(0, 3 - length(cards))"


def metric(name, add, sql, kind="INTEGER", prefix=None):
    def run(spark, sf):
        out = add(X.deals(spark, sf))
        return out.select("deal_id", *[c for c in out.columns if c not in ("deal_id", "Board", "PBN")])

    reg(name, run, metric_sql(sql, prefix or name, kind), "suits")


reg(
    "hnd1_parse_hands", lambda s, d: D.parse_hands(X.deals(s, d)).drop("Hands", "Board"),
    "SELECT p.deal_id, PBN, " + ", ".join(f"Hand_{d}" for d in B.SEATS) + ", " + ", ".join(f"Suit_{d}_{s}" for d in B.SEATS for s in B.SUITS)
    + " FROM deals p JOIN (SELECT deal_id, " + by_seat("cards", "Suit", suits=B.SUITS) + ", "
    + ", ".join(f"string_agg(cards, '.' ORDER BY suit) FILTER (seat = {i}) AS Hand_{d}" for i, d in enumerate(B.SEATS)) + " FROM suits GROUP BY deal_id) q ON p.deal_id = q.deal_id", "deals",
)
reg("hnd2_dealer", lambda s, d: D.add_dealer(X.board_results(s, d)).select("session_id", "Board", "Dealer"), "SELECT session_id, Board, substr('NESW', (Board - 1) % 4 + 1, 1) AS Dealer FROM br", "br")
reg(
    "hnd3_vulnerability", lambda s, d: D.add_vulnerability(X.board_results(s, d)).select("session_id", "Board", "iVul", "Vul", "Vul_NS", "Vul_EW"),
    f"SELECT session_id, Board, {X._VUL}::INTEGER AS iVul, ['None', 'N_S', 'E_W', 'Both'][{X._VUL} + 1] AS Vul, {X._VUL} & 1 > 0 AS Vul_NS, {X._VUL} & 2 > 0 AS Vul_EW FROM br".replace("& 1 > 0", "IN (1, 3)").replace("& 2 > 0", "IN (2, 3)"), "br",
)


def hnd4(spark, sf):
    b = X.board_results(spark, sf)
    grid = b.select("session_id", "Board", F.explode(F.array(*[F.lit(x) for x in "NESW"])).alias("seat"))
    return grid.select("session_id", "Board", "seat", (F.instr(F.lit("NESW"), F.col("seat")) - 1).alias("seat_index"), B.seat_is_vulnerable(B.vul_code(F.col("Board")), F.col("seat")).alias("vulnerable"), (B.dealer_of(F.col("Board")) == F.col("seat")).alias("deals"))


reg("hnd4_seat_lookups", hnd4, f"SELECT session_id, Board, seat, (instr('NESW', seat) - 1)::INTEGER AS seat_index, {X.vul_sql(X._VUL, 'seat')} AS vulnerable, substr('NESW', (Board - 1) % 4 + 1, 1) = seat AS deals FROM br, (SELECT unnest(['N', 'E', 'S', 'W']) AS seat)", "br")
reg("hnd5_default_keys", lambda s, d: D.add_default_keys(X.board_results(s, d)).select("group_id", "session_id", "Board"), "SELECT 0 AS group_id, session_id, Board FROM br", "br")
reg("hnd6_card_flags", lambda s, d: D.add_card_flags(X.deals(s, d)).select("deal_id", F.col("Cards").cast("array<int>").cast("array<string>").alias("c")).select("deal_id", F.array_join("c", "").alias("Cards")),
    "SELECT deal_id, string_agg(CASE WHEN contains(cards, rank) THEN '1' ELSE '0' END, '' ORDER BY seat, suit, n) AS Cards FROM suits, (SELECT unnest(string_split('AKQJT98765432', '')) AS rank, unnest(range(13)) AS n) GROUP BY deal_id", "suits")
reg("hnd7_hand_masks", lambda s, d: (lambda x: x.select("deal_id", *[c for c in x.columns if c[:3] in ("Mas", "Bin", "Hex")], D.mask_to_hand(F.col("Mask_N")).alias("Back_N")))(D.add_hand_masks(X.deals(s, d))),
    "SELECT q.*, Back_N FROM (SELECT deal_id, " + ", ".join(f"sum(m) FILTER (seat = {i})::BIGINT AS Mask_{d}, lpad(bin(sum(m) FILTER (seat = {i})::BIGINT), 52, '0') AS Bin_{d}, lpad(hex(sum(m) FILTER (seat = {i})::BIGINT), 13, '0') AS Hex_{d}" for i, d in enumerate(B.SEATS))
    + " FROM (SELECT deal_id, seat, 1::BIGINT << (51 - i)::INTEGER AS m FROM cards) GROUP BY deal_id) q JOIN (SELECT deal_id, string_agg(cards, '.' ORDER BY suit) FILTER (seat = 0) AS Back_N FROM suits GROUP BY deal_id) b ON q.deal_id = b.deal_id", "suits")
metric("hnd8_high_card_points", D.add_hcp, HCP, prefix="HCP")
metric("hnd9_quick_tricks", D.add_quick_tricks, QT, "DOUBLE", "QT")
metric("hnd10_losing_trick_count", D.add_losers, LTC, prefix="LTC")
metric("hnd10_quick_losers", lambda x: D.add_losers(x, "QL"), LTC, prefix="QL")
metric("hnd11_suit_lengths", D.add_suit_lengths, "length(cards)", prefix="SL")


def shape_sql(d: str) -> str:
    i = B.SEATS.index(d)
    return (f"string_agg(length(cards)::VARCHAR, '-' ORDER BY suit DESC) FILTER (seat = {i}) AS SL_{d}_CDHS_SJ, string_agg(length(cards)::VARCHAR, '-' ORDER BY length(cards) DESC) FILTER (seat = {i}) AS SL_{d}_ML_SJ, "
            f"string_agg((3 - suit)::VARCHAR, '-' ORDER BY length(cards) DESC, suit DESC) FILTER (seat = {i}) AS SL_{d}_ML_I_SJ")


def hnd12(spark, sf):
    out = X.deals(spark, sf)
    for d in B.SEATS:
        out = D.add_shapes(out, d)
    return out.select("deal_id", *[c for c in out.columns if c.endswith("_SJ")])


reg("hnd12_shapes", hnd12, "SELECT deal_id, " + ", ".join(map(shape_sql, B.SEATS)) + " FROM suits GROUP BY deal_id", "suits")
reg("hnd13_longest_suit", lambda s, d: D.add_longest_suit(D.add_suit_lengths(X.deals(s, d))).select("deal_id", "SL_Max_NS", "SL_Max_NS_Col", "SL_Max_EW", "SL_Max_EW_Col"),
    "SELECT deal_id, " + ", ".join(f"max(n) FILTER (side = {i}) AS SL_Max_{p}, 'SL_{p}_' || substr('SHDC', (arg_max(suit, n * 10 - suit) FILTER (side = {i}))::INTEGER + 1, 1) AS SL_Max_{p}_Col" for i, p in enumerate(("NS", "EW")))
    + " FROM (SELECT deal_id, seat % 2 AS side, suit, sum(length(cards))::INTEGER AS n FROM suits GROUP BY ALL) GROUP BY deal_id", "suits")
metric("hnd14_distribution_points", D.add_distribution_points, DP, prefix="DP")
metric("hnd15_total_points", D.add_total_points, f"{HCP} + {DP}", prefix="Total_Points")


def hnd16(spark, sf):
    rows = D.suits_long(X.deals(spark, sf))
    return rows.select("deal_id", "seat", "suit", *[c.alias(k) for k, c in D.suit_flags(F.col("cards")).items()], *[F.lit(True).alias(k) for k in D.FORCING])


# n: length of the suit, p: its high card points
reg("hnd16_suit_quality", hnd16, f"""SELECT deal_id, substr('NESW', seat::INTEGER + 1, 1) AS seat, substr('SHDC', suit::INTEGER + 1, 1) AS suit, n > 4 OR (n = 4 AND p > 2) AS Biddable, n > 5 OR (n = 5 AND p > 2) AS Rebiddable,
  n > 6 OR (n = 6 AND p > 2) AS Twice_Rebiddable, n > 5 AND p > 8 AS Strong_Rebiddable, p > 8 AS Solid, n + p < 4 AS At_Best_Partial_Stop_In, NOT n + p < 4 AS Partial_Stop_In, n + p > 4 AS Likely_Stop_In, p > 3 OR n + p > 5 AS Stop_In,
  n + p > 6 AS At_Best_Stop_In, n + p > 7 AS Two_Stops_In, true AS Forcing_One_Round, true AS Opponents_Cannot_Play_Undoubled_Below_2N, true AS Forcing_To_2N, true AS Forcing_To_3N FROM (SELECT *, length(cards) AS n, {HCP} AS p FROM suits)""", "suits")
_SHAPE = "string_agg(length(cards)::VARCHAR, '' ORDER BY length(cards) DESC) FILTER (seat = {i})"
reg("hnd17_balanced", lambda s, d: D.add_balanced(X.deals(s, d)).select("deal_id", *[f"Balanced_{x}" for x in B.SEATS]),
    "SELECT deal_id, " + ", ".join(f"{_SHAPE.format(i=i)} IN ('4333', '4432') OR ({_SHAPE.format(i=i)} IN ('5332', '5422') AND bool_or(length(cards) = 5 AND suit >= 2) FILTER (seat = {i})) AS Balanced_{d}" for i, d in enumerate(B.SEATS)) + " FROM suits GROUP BY deal_id", "suits")


def hnd18(spark, sf):
    nested = F.transform(B.hands(F.col("PBN")), lambda h: F.struct(F.aggregate(F.transform(h, B.suit_hcp), F.lit(0), lambda a, x: a + x).alias("total"), F.transform(h, B.suit_hcp).alias("suits")))
    return D.expand_metric(X.deals(spark, sf).select("deal_id", nested.alias("m")), "m", "HCP").drop("m")


reg("hnd18_expand_metric", hnd18, metric_sql(HCP, "HCP"), "suits")
reg("hnd19_pair_length_sums", lambda s, d: D.add_pair_length_sums(D.add_suit_lengths(X.deals(s, d))).select("deal_id", "LoTT_NS", "LoTT_EW"),
    "SELECT deal_id, " + ", ".join(f"sum(length(cards)) FILTER (seat % 2 = {i})::INTEGER AS LoTT_{p}" for i, p in enumerate(("NS", "EW"))) + " FROM suits GROUP BY deal_id", "suits")


def hnd20(spark, sf):
    lengths = D.suits_long(X.deals(spark, sf)).groupBy("deal_id", B.side_of(F.col("seat")).alias("side"), "suit").agg(F.sum(F.length("cards")).cast("int").alias("length"))
    return D.total_tricks(X.dd_long(spark, sf), lengths)


reg("hnd20_total_tricks", hnd20,
    """SELECT deal_id, sum(tricks)::BIGINT AS tricks, sum(n)::BIGINT AS trumps, (sum(tricks) - sum(n))::BIGINT AS difference FROM (
  SELECT b.deal_id, b.side, n, tricks, row_number() OVER (PARTITION BY b.deal_id, b.side ORDER BY n DESC, tricks DESC, b.suit) AS r
  FROM (SELECT deal_id, (instr('NESW', seat) - 1) % 2 AS side, instr('SHDC', strain) - 1 AS suit, max(tricks) AS tricks FROM dd WHERE strain <> 'N' GROUP BY ALL) b
  JOIN (SELECT deal_id, seat % 2 AS side, suit, sum(length(cards)) AS n FROM suits GROUP BY ALL) l ON b.deal_id = l.deal_id AND b.side = l.side AND b.suit = l.suit) WHERE r = 1 GROUP BY deal_id""", "dd", "suits")
