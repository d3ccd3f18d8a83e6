"""Queries SCO1 to SCO15 and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import bridge as B
from ..operators import contracts as C
from ..operators import scoring as S

Q, O = {}, {}
VUL = X._VUL


def reg(name, run, sql, *ctes):
    Q[name] = run
    if sql:
        O[name] = X.oracle(sql, *ctes)


def sv(seat):
    return X.vul_sql(VUL, seat)


#: board results with the contract split, for the oracles
SPLIT = f"""(SELECT *, CASE WHEN bid THEN substr(Contract, 1, 1)::INTEGER END AS BidLvl, CASE WHEN bid THEN substr(Contract, 2, 1) END AS BidSuit, CASE WHEN bid THEN substr(Contract, 3, length(Contract) - 3) END AS Dbl, CASE WHEN bid THEN right(Contract, 1) END AS D
 FROM (SELECT *, coalesce(Contract <> 'PASS', false) AS bid FROM br))"""


def used_scores(spark, sf):
    used = C.split_contract(X.board_results(spark, sf)).where("BidLvl is not null").groupBy(F.col("BidLvl").alias("level"), F.col("BidSuit").alias("strain"), F.col("Dbl").alias("dbl"), F.col("Declarer_Vul").alias("vul"), F.col("Tricks").alias("tricks")).agg(F.count(F.lit(1)).alias("n"))
    return used.join(F.broadcast(S.score_table(spark)), ["level", "strain", "dbl", "vul", "tricks"])


reg("sco1_score_table", used_scores,
    f"""SELECT u.*, s.score, CASE WHEN s.tricks < s.level + 6 AND s.dbl = '' THEN x.score ELSE s.score END AS score_set, s.score - l.score AS step
  FROM (SELECT BidLvl AS level, BidSuit AS strain, Dbl AS dbl, {sv('D')} AS vul, Tricks AS tricks, count(*) AS n FROM {SPLIT} WHERE bid GROUP BY ALL) u
  JOIN scores s USING (level, strain, dbl, vul, tricks) JOIN scores x ON x.level = s.level AND x.strain = s.strain AND x.dbl = 'X' AND x.vul = s.vul AND x.tricks = s.tricks
  LEFT JOIN scores l ON l.level = s.level AND l.strain = s.strain AND l.dbl = s.dbl AND l.vul = s.vul AND l.tricks = s.tricks - 1""", "br", "scores")
SIDE = "CASE WHEN seat IN ('N', 'S') THEN 'NS' ELSE 'EW' END"
reg("sco2_pair_tricks", lambda s, d: S.pair_tricks(X.dd_long(s, d)), f"SELECT deal_id, Board, {SIDE} AS side, strain, max(tricks) AS tricks FROM dd GROUP BY ALL", "dd")
LV = "(SELECT unnest(range(1, 8))::INTEGER AS level)"
SET = "(CASE WHEN tricks < level + 6 THEN 'X' ELSE '' END)"
CS = X.score_sql("level", "strain", SET, sv("seat"), "(tricks - 6 - level)")
reg("sco3_contract_scores", lambda s, d: S.contract_scores(S.deal_cells(X.dd_long(s, d))).drop("Board"),
    f"""SELECT deal_id, who, strain, max(tricks) AS tricks, {', '.join(f'max(score) FILTER (level = {n}) AS S{n}' for n in range(1, 8))}, max(score) AS best FROM (
  SELECT deal_id, unnest([seat, {SIDE}]) AS who, strain, tricks, level, {CS} AS score FROM dd, {LV}) GROUP BY deal_id, who, strain""", "dd")
reg("sco4_making_and_sacrifice", lambda s, d: S.making_and_sacrifice(X.dd_long(s, d)).drop("Board"),
    f"""SELECT deal_id, seat, strain, tricks, level, score, row_number() OVER (PARTITION BY deal_id ORDER BY score DESC, level, instr('CDHSN', strain), instr('NESW', seat)) AS place FROM (
  SELECT *, {X.score_sql('level', 'strain', "(CASE WHEN tricks >= level + 6 THEN '' ELSE 'X' END)", sv('seat'), '(tricks - 6 - level)')} AS score FROM dd, {LV} WHERE level >= greatest(1, tricks - 6))""", "dd")
PAR = f"""p AS (SELECT deal_id, Board, {SIDE} AS side, strain, max(tricks) AS tricks FROM dd GROUP BY ALL),
v AS (SELECT *, level * 5 + instr('CDHSN', strain) AS rank, tricks - 6 - level AS over, CASE side WHEN 'NS' THEN 1 ELSE -1 END * {X.score_sql('level', 'strain', "(CASE WHEN tricks >= level + 6 THEN '' ELSE 'X' END)", sv('side'), '(tricks - 6 - level)')} AS value FROM p, {LV}),
w AS (SELECT deal_id, Board, rank, max(value) FILTER (side = 'NS') AS nv, max(value) FILTER (side = 'EW') AS ev FROM v GROUP BY ALL),
r AS (SELECT deal_id, Board, 41 AS rank, -99999 AS ns, 99999 AS ew FROM (SELECT DISTINCT deal_id, Board FROM w)
  UNION ALL SELECT r.deal_id, r.Board, r.rank - 1, greatest(r.ns, least(w.nv, r.ew)), least(r.ew, greatest(w.ev, r.ns)) FROM r JOIN w ON w.deal_id = r.deal_id AND w.rank = r.rank - 1),
b AS (SELECT deal_id, CASE WHEN (Board - 1) % 2 = 0 THEN greatest(ns, least(ew, greatest(ns, least(ew, 0)))) ELSE least(ew, greatest(ns, least(ew, greatest(ns, 0)))) END AS par_score FROM r WHERE rank = 6)"""
PAR_TAIL = """SELECT b.deal_id, par_score, coalesce(list(level || strain || CASE WHEN over < 0 THEN 'X' ELSE '' END || ' ' || side || ' ' || over ORDER BY level || strain || CASE WHEN over < 0 THEN 'X' ELSE '' END || ' ' || side || ' ' || over)
  FILTER (value = par_score AND par_score <> 0), []) AS contracts FROM b JOIN v ON v.deal_id = b.deal_id GROUP BY b.deal_id, par_score"""


def with_par(tail: str) -> str:
    return X.oracle("", "dd").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + PAR + "\n" + tail


Q["sco5_par"], O["sco5_par"] = (lambda s, d: S.par(X.dd_long(s, d))), with_par(PAR_TAIL)


def compare_dd(spark, sf):
    """Trick tables of which one has changed and lost cells, and the par lists of both, one of them with other levels for the same tricks."""
    dd = X.dd_long(spark, sf)
    other = dd.withColumn("tricks", F.when((F.col("deal_id") % 70 == 0) & (F.col("strain") == "N"), F.col("tricks") + 1).otherwise(F.col("tricks"))).where("deal_id % 110 <> 0 or seat <> 'W'")
    cells = S.differing(dd, other, ["deal_id", "seat", "strain"], ["tricks"]).select("deal_id", F.concat("seat", "strain").alias("what"), F.col("one.tricks").cast("string").alias("one"), F.col("two.tricks").cast("string").alias("two"))
    pars = S.par(dd)
    # the last contract a level lower with a trick more means the same, another score or a list without it does not
    last = F.split(F.element_at("contracts", -1), " ")
    lower = F.concat(F.substring(last[0], 1, 1).cast("int") - 1, F.substring(last[0], F.lit(2), F.length(last[0])), F.lit(" "), last[1], F.lit(" "), (last[2].cast("int") + 1).cast("string"))
    n = F.size("contracts")
    changed = pars.select("deal_id", F.when(F.col("deal_id") % 90 == 0, F.col("par_score") + 10).otherwise(F.col("par_score")).alias("par_score"),
                          F.when(n == 0, F.col("contracts")).when(F.col("deal_id") % 3 == 0, F.array_append(F.slice("contracts", F.lit(1), n - 1), lower)).when(F.col("deal_id") % 130 == 0, F.slice("contracts", F.lit(1), n - 1)).otherwise(F.col("contracts")).alias("contracts"))
    text = lambda k: F.concat_ws(" ", F.col(f"score_{k}").cast("string"), F.size(f"contracts_{k}").cast("string"))
    return cells.unionByName(S.differing_pars(pars, changed).select("deal_id", F.lit("par").alias("what"), text("one").alias("one"), text("two").alias("two")))


Q["sco6_compare_tables"], O["sco6_compare_tables"] = compare_dd, with_par("""SELECT a.deal_id, a.seat || a.strain AS what, a.tricks::VARCHAR AS one, b.tricks::VARCHAR AS two FROM dd a LEFT JOIN (SELECT deal_id, seat, strain, CASE WHEN deal_id % 70 = 0 AND strain = 'N' THEN tricks + 1 ELSE tricks END AS tricks FROM dd WHERE deal_id % 110 <> 0 OR seat <> 'W') b
  ON a.deal_id = b.deal_id AND a.seat = b.seat AND a.strain = b.strain WHERE a.tricks IS DISTINCT FROM b.tricks UNION ALL
SELECT deal_id, 'par', par_score || ' ' || n, par_score + CASE WHEN deal_id % 90 = 0 THEN 10 ELSE 0 END || ' ' || n - gone FROM (SELECT deal_id, par_score, len(contracts) AS n, CASE WHEN len(contracts) > 0 AND deal_id % 3 <> 0 AND deal_id % 130 = 0 THEN 1 ELSE 0 END AS gone FROM ("""
+ PAR_TAIL + ")) WHERE deal_id % 90 = 0 OR gone = 1")
Q["sco7_par_sides"], O["sco7_par_sides"] = (lambda s, d: S.par_sides(S.par(X.dd_long(s, d))).select("deal_id", "Par_NS", "Par_EW")), with_par("SELECT deal_id, par_score AS Par_NS, -par_score AS Par_EW FROM b")


def merged_histograms(spark, sf):
    """Samples that come in three parts, counted by themselves."""
    x = X.samples(spark, sf)
    part = F.col("tricks") % 3
    return S.trick_probabilities(S.merge_counts(*[S.trick_counts(x.where(part == i)) for i in range(3)]))


reg("sco8_trick_histograms", lambda s, d: merged_histograms(s, d).select("deal_id", "seat", "strain", "trials", *[F.col("probs")[t].alias(f"P{t}") for t in range(14)]),
    f"SELECT deal_id, seat, strain, count(*) AS trials, {', '.join(f'count(*) FILTER (tricks = {t}) / count(*) AS P{t}' for t in range(14))} FROM samples GROUP BY deal_id, seat, strain", "samples")
#: failing contracts count as doubled
EV = f"""ev AS (SELECT h.deal_id, Board, seat, h.strain, level, vul, round(sum(score * n) / sum(n), 6) AS ev FROM (SELECT deal_id, Board, seat, strain, tricks, count(*) AS n FROM samples GROUP BY ALL) h
  JOIN scores s ON s.strain = h.strain AND s.tricks = h.tricks AND dbl = CASE WHEN s.tricks < level + 6 THEN 'X' ELSE '' END GROUP BY ALL)"""


def with_ev(tail: str) -> str:
    return X.oracle("", "samples", "scores").rstrip() + ",\n" + EV + "\n" + tail


def hist(spark, sf):
    return S.trick_histograms(X.samples(spark, sf))


Q["sco9_expected_values"] = lambda s, d: S.expected_values(hist(s, d))
O["sco9_expected_values"] = with_ev("SELECT deal_id, Board, seat, strain, " + ", ".join(f"max(ev) FILTER (level = {n} AND vul = {v}) AS {k}{n}" for k, v in (("NV", "false"), ("V", "true")) for n in range(1, 8)) + " FROM ev GROUP BY ALL")
ORD = "(instr('NSEW', seat) * 1000 + instr('SHDCN', strain) * 10 + level)"
Q["sco10_best_contracts"] = lambda s, d: S.best_contracts(S.ev_lists(hist(s, d)))
O["sco10_best_contracts"] = with_ev(f"""SELECT deal_id, vul, sd AS side, se AS seat, st AS strain, max(ev) AS ev, arg_max(level || strain || ' ' || seat, (ev, -{ORD})) AS contract FROM (SELECT *, {SIDE} AS sd, seat AS se, strain AS st FROM ev)
  GROUP BY GROUPING SETS ((deal_id, vul), (deal_id, vul, sd), (deal_id, vul, se), (deal_id, vul, st), (deal_id, vul, se, st))""")
Q["sco11_applicable_ev"] = lambda s, d: S.declarer_ev(S.applicable_ev(S.ev_lists(hist(s, d))).withColumn("Declarer_Pair", F.element_at(F.array(F.lit("NS"), F.lit("EW"), F.lit(None)), (F.col("deal_id") % 3 + 1).cast("int"))))
O["sco11_applicable_ev"] = with_ev(f"""SELECT *, CASE Declarer_Pair WHEN 'NS' THEN EV_Max_NS ELSE EV_Max_EW END AS EV_Max_Declarer, CASE Declarer_Pair WHEN 'NS' THEN EV_Contract_NS ELSE EV_Contract_EW END AS EV_Contract_Declarer FROM (
  SELECT *, greatest(EV_Max_NS, EV_Max_EW) AS EV_Max, CASE WHEN EV_Max_NS >= EV_Max_EW THEN 'NS' ELSE 'EW' END AS EV_Side, ['NS', 'EW', NULL][deal_id % 3 + 1] AS Declarer_Pair FROM (
  SELECT deal_id, {', '.join(f"max(ev) FILTER ({SIDE} = '{p}') AS EV_Max_{p}, arg_max(level || strain || ' ' || seat, (ev, -{ORD})) FILTER ({SIDE} = '{p}') AS EV_Contract_{p}" for p in ('NS', 'EW'))} FROM ev WHERE vul = {sv('seat')} GROUP BY deal_id))""")
TYPE = "CASE WHEN tricks < 7 THEN 'Pass' WHEN tricks = 13 THEN 'GSlam' WHEN tricks = 12 THEN 'SSlam' WHEN tricks >= CASE WHEN strain IN ('C', 'D') THEN 11 WHEN strain = 'N' THEN 9 ELSE 10 END THEN 'Game' ELSE 'Partial' END"
reg("sco12_type_of_tricks", lambda s, d: S.contract_type_flags(X.dd_long(s, d)), f"SELECT deal_id, {SIDE} AS side, strain, " + ", ".join(f"bool_or({TYPE} = '{t}') AS CT_{t}" for t in S.TYPES) + " FROM dd GROUP BY ALL", "dd")
BT = "CASE WHEN Contract IS NULL THEN NULL WHEN NOT bid THEN 'Pass' WHEN BidLvl = 7 THEN 'GSlam' WHEN BidLvl = 6 THEN 'SSlam' WHEN BidLvl >= CASE WHEN BidSuit IN ('C', 'D') THEN 5 WHEN BidSuit = 'N' THEN 3 ELSE 4 END THEN 'Game' ELSE 'Partial' END"
reg("sco13_type_of_bid", lambda s, d: C.split_contract(X.board_results(s, d)).groupBy("Contract", "ContractType").agg(F.count(F.lit(1)).alias("n")), f"SELECT Contract, {BT} AS ContractType, count(*) AS n FROM {SPLIT} GROUP BY ALL", "br")


def filtered(spark, sf):
    from ..operators.deals import add_vulnerability

    b = add_vulnerability(C.split_contract(X.board_results(spark, sf)))
    return S.filter_boards(b, "Both", "NS", None, "Game", False).select("session_id", "Board", "Contract", "Score_NS")


reg("sco14_filter_boards", filtered, f"SELECT session_id, Board, Contract, Score_NS FROM {SPLIT} WHERE {VUL} = 3 AND D IN ('N', 'S') AND {BT} = 'Game' AND Dbl = ''", "br")


def predictions(spark, sf):
    dd = X.dd_long(spark, sf)
    d = dd.select("deal_id", "seat", "strain", F.greatest(F.lit(0), F.least(F.lit(13), F.col("tricks") + F.col("deal_id") % 3 - 1)).cast("int").alias("Pred_Tricks"), F.col("tricks").alias("Tricks"), B.seat_is_vulnerable(B.vul_code(F.col("Board")), F.col("seat")).alias("vul"))
    return S.score_predictions(d, "Pred")


reg("sco15_score_predictions", predictions,
    f"""SELECT *, CASE WHEN Pred_Level > 0 THEN Pred_Level || strain ELSE 'PASS' END AS Pred_Bid, CASE WHEN Pred_Level > 0 THEN Tricks - Pred_Tricks END AS Pred_Result, {TYPE.replace('tricks', 'Pred_Tricks')} AS Pred_Type,
  CASE WHEN Pred_Level > 0 THEN {X.score_sql('Pred_Level', 'strain', "''", 'vul', '(Tricks - Pred_Tricks)')} ELSE 0 END AS Pred_Score FROM (SELECT *, greatest(Pred_Tricks - 6, 0) AS Pred_Level FROM
  (SELECT deal_id, seat, strain, greatest(0, least(13, tricks + deal_id % 3 - 1))::INTEGER AS Pred_Tricks, tricks AS Tricks, {sv('seat')} AS vul FROM dd))""", "dd")
