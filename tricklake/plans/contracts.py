"""Queries FIN1 to FIN18 and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import contracts as C
from ..operators import scoring as S
from .scoring import BT, SPLIT, sv, with_par

Q, O = {}, {}


def reg(name, run, sql, *ctes):
    Q[name] = run
    if sql:
        O[name] = X.oracle(sql, *ctes) if ctes else sql


KEYS = ["session_id", "section_id", "Board", "Pair_Number_NS", "Pair_Number_EW"]
K = ", ".join(KEYS)


def nxt(seat, steps):
    return f"substr('NESW', (instr('NESW', {seat}) - 1 + {steps}) % 4 + 1, 1)"


def pick(seat):
    return f"CASE {seat} WHEN 'N' THEN Player_ID_N WHEN 'E' THEN Player_ID_E WHEN 'S' THEN Player_ID_S WHEN 'W' THEN Player_ID_W END"


DSIDE = "CASE WHEN D IN ('N', 'S') THEN 'NS' WHEN D IN ('E', 'W') THEN 'EW' END"
DVUL = f"CASE WHEN D IS NOT NULL THEN {sv('D')} END"


def split(spark, sf):
    return C.split_contract(X.board_results(spark, sf))


reg("fin1_split_contract", lambda s, d: split(s, d).select(*KEYS, "Contract", "BidLvl", "BidSuit", "Dbl", "Declarer_Direction", "Declarer_Pair", "Declarer_Vul", "LHO", "Dummy", "RHO", "ContractType"),
    f"SELECT {K}, Contract, BidLvl, BidSuit, Dbl, D AS Declarer_Direction, {DSIDE} AS Declarer_Pair, {DVUL} AS Declarer_Vul, {nxt('D', 1)} AS LHO, {nxt('D', 2)} AS Dummy, {nxt('D', 3)} AS RHO, {BT} AS ContractType FROM {SPLIT}", "br")
reg("fin2_declarer_id", lambda s, d: C.declarer_id(split(s, d)).select(*KEYS, "Declarer_Direction", "Declarer_ID"), f"SELECT {K}, D AS Declarer_Direction, {pick('D')} AS Declarer_ID FROM {SPLIT}", "br")
reg("fin3_pair_arrays", lambda s, d: C.seats_of_arrays(C.pair_arrays(X.board_results(s, d)).drop(*[f"Player_ID_{x}" for x in "NESW"])).select(*KEYS, F.array_join("Player_IDs_NS", "+").alias("ns"), F.array_join("Player_IDs_EW", "+").alias("ew"), *[f"Player_ID_{x}" for x in "NESW"]),
    f"SELECT {K}, Player_ID_N || '+' || Player_ID_S AS ns, Player_ID_E || '+' || Player_ID_W AS ew, Player_ID_N, Player_ID_E, Player_ID_S, Player_ID_W FROM br", "br")
RFS = f"""(SELECT min(t.tricks) FROM scores t WHERE t.level = BidLvl AND t.strain = BidSuit AND t.dbl = x.Dbl AND t.vul = x.V AND t.score = CASE WHEN D IN ('N', 'S') THEN Score_NS ELSE -Score_NS END) - 6 - BidLvl"""
reg("fin4_result_from_score", lambda s, d: C.result_from_score(split(s, d)).select(*KEYS, "Contract", "Score_NS", "Result_From_Score", "Result_Consistent"),
    f"SELECT {K}, Contract, Score_NS, r::INTEGER AS Result_From_Score, r IS NULL OR r IS NOT DISTINCT FROM Result AS Result_Consistent FROM (SELECT *, {RFS} AS r FROM (SELECT *, {DVUL} AS V FROM {SPLIT}) x)", "br", "scores")
reg("fin5_result_from_tricks", lambda s, d: C.result_from_tricks(split(s, d)).select(*KEYS, "Contract", "Tricks", "Result_From_Tricks"), f"SELECT {K}, Contract, Tricks, Tricks - 6 - BidLvl AS Result_From_Tricks FROM {SPLIT}", "br")
reg("fin6_tricks_from_result", lambda s, d: C.tricks_from_result(split(s, d)).select(*KEYS, "Contract", "Result", "Tricks_From_Result"), f"SELECT {K}, Contract, Result, BidLvl + 6 + Result AS Tricks_From_Result FROM {SPLIT}", "br")
SD = "CASE WHEN D IN ('N', 'S') THEN Score_NS WHEN D IN ('E', 'W') THEN -Score_NS END"
reg("fin7_side_scores", lambda s, d: C.side_scores(split(s, d).drop("Score_NS")).select(*KEYS, "Contract", "Score_NS", "Score_EW", "Score_Declarer"), f"SELECT {K}, Contract, Score_NS, -Score_NS AS Score_EW, {SD} AS Score_Declarer FROM {SPLIT}", "br")


def result_deals(spark, sf):
    """(deal_id, Board, cells) of the results' own deals, by the same formula. Without null deals, which no join finds, so that all joins of a query read one and the same shuffle."""
    return X.trick_cells(X.board_results(spark, sf).select("deal_id", "Board").where("deal_id is not null").distinct())


DDR = X.CTES["dd"][1].replace("FROM deal_ids", "FROM (SELECT DISTINCT deal_id, Board FROM br)")
DD = f"""(SELECT s.*, a.tricks AS DD_Tricks, b.tricks AS DD_Tricks_Dummy FROM {SPLIT} s LEFT JOIN ddr a ON a.deal_id = s.deal_id AND a.seat = D AND a.strain = BidSuit LEFT JOIN ddr b ON b.deal_id = s.deal_id AND b.seat = {nxt('D', 2)} AND b.strain = BidSuit)"""


def with_dd(main):
    # tables of their own, not text that is put into each use
    return X.oracle("", "br").rstrip().replace("br AS (", "br AS MATERIALIZED (", 1) + f",\nddr AS MATERIALIZED ({DDR})\n" + main


def with_dd_par(main):
    head = X.oracle("", "br").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f",\nddr AS ({DDR}),\ndd AS (SELECT * FROM ddr)"
    par = with_par("").split("FROM deal_ids, range(4) a(seat), range(5) b(st))", 1)[1]
    return head + par + main


def joined(spark, sf):
    return C.side_scores(C.join_deals(split(spark, sf), result_deals(spark, sf)))


def with_pars(spark, sf):
    """Results with trick counts, par and theoretical scores; trick table and par come from one row a deal."""
    deals = S.par_sides(S.par(result_deals(spark, sf))).select("deal_id", "Board", "cells", "Par_NS")
    return C.differences(C.dd_score(C.side_scores(C.join_deals(split(spark, sf), deals))))


reg("fin8_dd_tricks", lambda s, d: joined(s, d).select(*KEYS, "Contract", "DD_Tricks", "DD_Tricks_Dummy"), with_dd(f"SELECT {K}, Contract, DD_Tricks, DD_Tricks_Dummy FROM {DD}"))


def dds(level):
    """The score of a level in the contract's strain at the tricks of the trick table; failing ones are doubled."""
    return f"CASE WHEN bid THEN {X.score_sql(level, 'BidSuit', f'(CASE WHEN DD_Tricks < {level} + 6 THEN {chr(39)}X{chr(39)} ELSE {chr(39)}{chr(39)} END)', sv('D'), f'(DD_Tricks - 6 - {level})')} END"


MAXS = f"greatest({', '.join(dds(str(n)) for n in range(1, 8))})"
SIGN = "CASE WHEN D IN ('N', 'S') THEN 1 ELSE -1 END"
reg("fin9_dd_score", lambda s, d: C.dd_score(joined(s, d)).select(*KEYS, "Contract", "DD_Score_Declarer", "DD_Score_Max_Declarer", "DD_Score_NS", "DD_Score_EW"),
    with_dd(f"SELECT {K}, Contract, own AS DD_Score_Declarer, m AS DD_Score_Max_Declarer, CASE WHEN D IS NULL THEN 0 ELSE own * {SIGN} END AS DD_Score_NS, CASE WHEN D IS NULL THEN 0 ELSE -own * {SIGN} END AS DD_Score_EW FROM (SELECT *, {dds('BidLvl')} AS own, {MAXS} AS m FROM {DD})"))


def ev_diffs(spark, sf):
    evs = S.applicable_ev(S.ev_lists(result_histograms(spark, sf)))
    b = C.join_deals(split(spark, sf), S.par_sides(S.par(result_deals(spark, sf))).select("deal_id", "Board", "cells", "Par_NS"))
    return C.differences(C.side_scores(b.join(evs, "deal_id", "left"))).select(*KEYS, "Contract", "Par_Diff_NS", "Par_Diff_EW", "DD_Tricks_Diff", *[F.round(f"EV_Max_Diff_{p}", 6).alias(f"EV_Max_Diff_{p}") for p in ("NS", "EW")])


HIST = "h AS (SELECT deal_id, seat, strain, t, count(*)::DOUBLE / 40 AS p FROM (SELECT *, ((deal_id * 13 + n * n * 7 + tricks) % 14)::INTEGER AS t FROM ddr, range(40) x(n)) GROUP BY ALL)"
RSET = "CASE WHEN t < level + 6 THEN 'X' ELSE '' END"
REV = f"""g AS (SELECT h.deal_id, h.seat, round(sum(p * score), 6) AS ev FROM h JOIN (SELECT DISTINCT deal_id, Board FROM br) d ON d.deal_id = h.deal_id JOIN scores s ON s.strain = h.strain AND s.tricks = t AND s.dbl = {RSET} AND s.vul = {sv('h.seat')} GROUP BY h.deal_id, h.seat, h.strain, level),
q AS (SELECT deal_id, max(ev) FILTER (seat IN ('N', 'S')) AS ens, max(ev) FILTER (seat IN ('E', 'W')) AS eew FROM g GROUP BY deal_id)"""
Q["fin10_differences"] = ev_diffs
O["fin10_differences"] = with_dd_par(f", {HIST}, scores AS ({X.CTES['scores'][1]}), {REV} SELECT {K.replace('session_id', 'x.session_id')}, Contract, Score_NS - par_score AS Par_Diff_NS, par_score - Score_NS AS Par_Diff_EW, Tricks - DD_Tricks AS DD_Tricks_Diff, round(Score_NS - ens, 6) AS EV_Max_Diff_NS, round(-Score_NS - eew, 6) AS EV_Max_Diff_EW FROM {DD} x LEFT JOIN b ON b.deal_id = x.deal_id LEFT JOIN q ON q.deal_id = x.deal_id")
# the declarer's par is East-West's where nobody declares; a passed-out board scores 0
OP = "CASE WHEN D IN ('N', 'S') THEN par_score ELSE -par_score END"
ROLES = f"""(SELECT *, own_par = best_in_strain AS Is_Par_Suit, own_par = own_dds AS Is_Par_Contract, own_par = own_dds AND own_dds < 0 AS Is_Sacrifice FROM (
  SELECT x.*, {nxt('D', 1)} AS OnLead, {nxt('D', 3)} AS NotOnLead, {pick(nxt('D', 1))} AS OnLead_ID, {pick(nxt('D', 3))} AS NotOnLead_ID, {pick(nxt('D', 2))} AS Dummy_ID, {pick('D')} AS Declarer_ID, {OP} AS own_par, {dds('BidLvl')} AS own_dds, {MAXS} AS best_in_strain,
  'EV_' || {DSIDE} || '_' || D || '_' || BidSuit || '_' || BidLvl || '_' || CASE WHEN {sv('D')} THEN 'V' ELSE 'NV' END AS EV_Score_Col_Declarer,
  CASE WHEN Contract = 'PASS' THEN 0 ELSE {SD} END <= {OP} AS Defender_Par_GE, Tricks - DD_Tricks AS DD_Tricks_Diff FROM {DD} x LEFT JOIN b ON b.deal_id = x.deal_id))"""
FLAGS = ["Contract", "OnLead", "NotOnLead", "OnLead_ID", "NotOnLead_ID", "Dummy_ID", "EV_Score_Col_Declarer", "Defender_Par_GE", "Is_Sacrifice", "Is_Par_Contract", "Is_Par_Suit"]
reg("fin11_roles", lambda s, d: C.roles(with_pars(s, d)).select(*KEYS, *FLAGS), with_dd_par(f"SELECT {K}, {', '.join(FLAGS)} FROM {ROLES}"))


def _probs(tricks):
    """Stored trick probabilities: of forty layouts half take one count and half another."""
    one = (F.col("deal_id") * 13 + tricks) % 14
    return F.array(*[F.when((one == t) | (one == (t + 7) % 14), 0.5).otherwise(0.0) for t in range(14)])


def result_hists(spark, sf):
    """(deal_id, Board, hists) of the results' deals, a row a deal."""
    return result_deals(spark, sf).select("deal_id", "Board", F.transform("cells", _probs).alias("hists"))


def result_histograms(spark, sf):
    """The same with a row a seat and strain: (deal_id, Board, seat, strain, probs)."""
    from ..functions import bridge as B

    rows = result_deals(spark, sf).select("deal_id", "Board", F.posexplode_outer("cells").alias("g", "tricks"))
    return rows.select("deal_id", "Board", B.nth("NESW", F.floor(F.col("g") / 5)).alias("seat"), B.nth("SHDCN", F.col("g") % 5).alias("strain"), _probs(F.col("tricks")).alias("probs"))


def probabilities(spark, sf):
    """P(t) of the contract's own declarer and strain."""
    return C.declarer_probabilities(split(spark, sf), result_hists(spark, sf))


reg("fin12_trick_probabilities", lambda s, d: probabilities(s, d).select(*KEYS, "Contract", *[F.col("probs")[t].alias(f"P_{t}") for t in range(14)]),
    with_dd("").rstrip() + f",\n{HIST}\nSELECT {K.replace('session_id', 's.session_id')}, Contract, " + ", ".join(f"CASE WHEN D IS NOT NULL THEN coalesce(P_{t}, 0) END AS P_{t}" for t in range(14)) + f" FROM {SPLIT} s LEFT JOIN (SELECT deal_id, seat, strain, " + ", ".join(f"max(p) FILTER (t = {t}) AS P_{t}" for t in range(14)) + " FROM h GROUP BY ALL) g ON g.deal_id = s.deal_id AND g.seat = D AND g.strain = BidSuit")


def contract_ev(spark, sf):
    from ..functions import bridge as B

    sc = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda t: B.set_score(F.col("BidLvl"), F.col("BidSuit"), F.col("Declarer_Vul"), t))
    ev = F.aggregate(F.zip_with("probs", sc, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    rule = B.contract_score(F.col("BidLvl"), F.col("BidSuit"), F.col("Dbl"), F.col("Declarer_Vul"), F.col("Result"))
    out = probabilities(spark, sf).withColumns({"EV_Score_Declarer": F.round(ev, 6), "Computed_Score_Declarer": F.when(F.col("Contract") == "PASS", 0).otherwise(rule)})
    sign = lambda p: F.when(F.col("Declarer_Pair") == p, F.col("EV_Score_Declarer")).otherwise(-F.col("EV_Score_Declarer"))
    return out.select(*KEYS, "Contract", "EV_Score_Declarer", "Computed_Score_Declarer", sign("NS").alias("EV_Score_NS"), sign("EW").alias("EV_Score_EW"))


reg("fin13_contract_ev", contract_ev,
    with_dd("").rstrip() + f",\n{HIST},\nscores AS ({X.CTES['scores'][1]}),\nx AS (SELECT *, {DVUL} AS V FROM {SPLIT}),\ne AS (SELECT DISTINCT deal_id, D, BidSuit, BidLvl, V FROM x WHERE bid),\n"
    f"f AS (SELECT e.*, round(sum(p * score), 6) AS ev FROM e JOIN h ON h.deal_id = e.deal_id AND h.seat = D AND h.strain = BidSuit JOIN scores s ON s.level = BidLvl AND s.strain = BidSuit AND s.dbl = {RSET} AND s.vul = V AND s.tricks = t GROUP BY ALL)\n"
    f"SELECT {', '.join('x.' + k for k in KEYS)}, Contract, ev AS EV_Score_Declarer, CASE WHEN Contract = 'PASS' THEN 0 ELSE {SD.replace('D IN', 'x.D IN')} END AS Computed_Score_Declarer, CASE WHEN x.D IN ('N', 'S') THEN ev ELSE -ev END AS EV_Score_NS, CASE WHEN x.D IN ('N', 'S') THEN -ev ELSE ev END AS EV_Score_EW FROM x LEFT JOIN f ON f.deal_id = x.deal_id AND f.D = x.D AND f.BidSuit = x.BidSuit AND f.BidLvl = x.BidLvl")
reg("fin14_trick_flags", lambda s, d: C.trick_flags(X.board_results(s, d)).select(*KEYS, "Result", "OverTricks", "JustMade", "UnderTricks"), f"SELECT {K}, Result, Result > 0 AS OverTricks, Result = 0 AS JustMade, Result < 0 AS UnderTricks FROM br", "br")
MEANS = {"Declarer_Rating": ("DD_Tricks_Diff", "Declarer_ID"), "Defender_OnLead_Rating": ("Defender_Par_GE::INTEGER", "OnLead_ID"), "Defender_NotOnLead_Rating": ("Defender_Par_GE::INTEGER", "NotOnLead_ID")}
reg("fin15_player_means", lambda s, d: C.player_means(C.roles(C.declarer_id(with_pars(s, d)))).select(*KEYS, "Declarer_ID", "OnLead_ID", "NotOnLead_ID", *[F.round(m, 8).alias(m) for m in MEANS]),
    with_dd_par(f"SELECT {K}, Declarer_ID, OnLead_ID, NotOnLead_ID, {', '.join(f'round(avg({v}) OVER (PARTITION BY {k}), 8) AS {m}' for m, (v, k) in MEANS.items())} FROM {ROLES}"))
reg("fin16_parse_dates", lambda s, d: C.parse_dates(X.table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 17 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("t")), "t").select("o_orderkey", "Date"),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate::DATE END AS Date FROM orders")
reg("fin17_viewpoint", lambda s, d: C.viewpoint(split(s, d), "NS", 3, "N").select(*KEYS, "Contract", *[f"Boards_{x}" for x in ("We_Played", "I_Declared", "Partner_Declared", "We_Declared", "Opponent_Declared")]),
    f"""SELECT {K}, Contract, m AS Boards_We_Played, m AND coalesce(D = 'N', false) AS Boards_I_Declared, m AND coalesce(D = 'S', false) AS Boards_Partner_Declared, m AND coalesce(D IN ('N', 'S'), false) AS Boards_We_Declared,
  m AND NOT coalesce(D IN ('N', 'S'), false) AND bid AS Boards_Opponent_Declared FROM (SELECT *, Pair_Number_NS = 3 AS m FROM {SPLIT})""", "br")
reg("fin18_canonical", lambda s, d: C.canonical(X.board_results(s, d), ["Date", *KEYS, "Contract", "Result", "Score_NS"]), f"SELECT Date, {K}, Contract, Result, Score_NS FROM br", "br")
