"""Queries ELO1 to ELO7 and QRY1 to QRY5."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import matchpoints as M
from ..operators import query as Y
from ..operators import ratings as R
from ..operators import scoring as S
from .contracts import HIST, REV, ROLES, SIGN, result_deals, result_histograms, with_dd_par
from .scoring import BT

Q, O = {}, {}


def results(spark, sf):
    """Board results with what the ratings read, dealt by session, so that the frequencies of scores need no further shuffle."""
    b = X.board_results(spark, sf).select("session_id", "section_id", "Board", "Date", "Score_NS", *[f"Player_ID_{d}" for d in "NESW"])
    return b.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "session_id")


def scored(spark, sf):
    return M.percentages(M.matchpoints(results(spark, sf)))


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


Q["elo1_pair_ratings"] = lambda s, d: rounded(R.rate(R.unpivot_pairs(scored(s, d))))
Q["elo2_player_ratings"] = lambda s, d: rounded(R.rate(R.unpivot_players(scored(s, d))))


def scales(spark, sf):
    e = X.table(spark, sf, "events").select("event_id", (F.col("user_id") % 100 / 50).alias("ratio"), (F.col("user_id") % 60 / 20 - 2.5).alias("z"))
    return e.withColumns({"stratum": R.stratum_scale(F.col("ratio")), "strength": R.strength_scale(F.col("z"))})


Q["elo3_scales"] = scales
O["elo3_scales"] = """SELECT *, CASE WHEN ratio <= 0.8::DOUBLE THEN 1.0 WHEN ratio >= 1.3::DOUBLE THEN 0.25 ELSE 1 - 0.75::DOUBLE * (ratio - 0.8::DOUBLE) / 0.5::DOUBLE END::DOUBLE AS stratum,
  CASE WHEN z >= 0 THEN 1.0 WHEN z <= -2 THEN 0.25 ELSE 1 + 0.375::DOUBLE * z END::DOUBLE AS strength FROM (SELECT event_id, user_id % 100 / 50 AS ratio, user_id % 60 / 20 - 2.5::DOUBLE AS z FROM events)"""
Q["elo4_spread_seed"] = lambda s, d: (lambda e: e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("spread", F.round(F.lit(R.spread_seed(e, "value")), 6)))(X.table(s, d, "events"))
O["elo4_spread_seed"] = "SELECT event_type, count(*) AS n, round((SELECT stddev_pop(value) FROM events), 6) AS spread FROM events GROUP BY event_type"


WHO = ["NS", "EW", *"NESW"]


def start_end(spark, sf):
    b = scored(spark, sf)
    out = R.session_start_end(b, *R.rate_both(b))
    return rounded(out.select("session_id", "Board", *[f"Player_ID_{d}" for d in "NESW"], *[f"Elo_{w}_{e}" for w in WHO for e in ("Start", "End")]))


Q["elo5_session_start_end"] = start_end
Q["elo6_rating_pipeline"] = lambda s, d: rounded(R.rating_pipeline(results(s, d)).select("session_id", "section_id", "Board", "Score_NS", "Pct_NS", "MP_Top", *[f"Elo_{w}_{e}" for w in WHO for e in ("Start", "End")]))


def augmented(spark, sf):
    """The full augmentation, summed up by session, vulnerability and contract type."""
    pars = S.par_sides(S.par(result_deals(spark, sf))).select("deal_id", "Board", "cells", "Par_NS")
    evs = S.applicable_ev(S.ev_lists(result_histograms(spark, sf))).select("deal_id", "EV_Max_NS", "EV_Max_EW")
    out = R.contract_pipeline(X.board_results(spark, sf), pars.join(evs, "deal_id"))
    yes = lambda c: F.count(F.when(F.col(c), 1))
    return out.groupBy("session_id", "Vul", "ContractType").agg(
        F.count(F.lit(1)).alias("n"), F.sum("Score_EW").alias("score_ew"), F.round(F.avg("Pct_NS"), 12).alias("pct"), F.sum("Par_Diff_NS").alias("par_diff"), F.sum("DD_Tricks_Diff").alias("tricks_diff"), F.sum("DD_Score_NS").alias("dd_score"),
        F.round(F.avg("EV_Max_Diff_NS"), 6).alias("ev_diff"), yes("Is_Par_Contract").alias("at_par"), yes("Is_Sacrifice").alias("sacrifices"), yes("Defender_Par_GE").alias("defended"))


Q["elo7_staged_pipeline"] = augmented
O["elo7_staged_pipeline"] = with_dd_par(f""", {HIST}, scores AS ({X.CTES['scores'][1]}), {REV}
SELECT x.session_id, ['None', 'N_S', 'E_W', 'Both'][{X._VUL} + 1] AS Vul, {BT} AS ContractType, count(*) AS n, -sum(Score_NS) AS score_ew, round(avg(CASE WHEN top > 0 THEN mp / top END), 12) AS pct, sum(Score_NS - -CASE WHEN D IN ('N', 'S') THEN -own_par ELSE own_par END) AS par_diff, sum(DD_Tricks_Diff) AS tricks_diff,
  sum(CASE WHEN D IS NULL THEN 0 ELSE own_dds * {SIGN} END) AS dd_score, round(avg(Score_NS - ens), 6) AS ev_diff, count(*) FILTER (Is_Par_Contract) AS at_par, count(*) FILTER (Is_Sacrifice) AS sacrifices, count(*) FILTER (Defender_Par_GE) AS defended FROM
  (SELECT *, CASE WHEN Score_NS IS NOT NULL THEN (SELECT count(*) FILTER (y.Score_NS < z.Score_NS) + (count(*) FILTER (y.Score_NS = z.Score_NS) - 1) / 2.0 FROM br y WHERE y.session_id = z.session_id AND y.section_id = z.section_id AND y.Board = z.Board) END AS mp,
   count(Score_NS) OVER (PARTITION BY session_id, section_id, Board) - 1 AS top FROM {ROLES} z) x LEFT JOIN q ON q.deal_id = x.deal_id GROUP BY ALL""")

FREE = "SELECT Contract, count(*) AS n, avg(Score_NS) AS mean WHERE Score_NS > :least GROUP BY Contract"
Q["qry1_user_sql"] = lambda s, d: Y.run_sql(X.board_results(s, d), FREE.replace("SELECT", "SELECT", 1).replace(" WHERE", ' FROM "self" WHERE'), least=100).select("Contract", "n", F.round("mean", 6).alias("mean"))
O["qry1_user_sql"] = X.oracle("SELECT Contract, count(*) AS n, round(avg(Score_NS), 6) AS mean FROM br WHERE Score_NS > 100 GROUP BY Contract", "br")
Q["qry2_macros"] = lambda s, d: Y.run_sql(X.board_results(s, d), "SELECT Player_ID_{Player_Direction} AS me, Player_ID_{Partner_Direction} AS partner, count(DISTINCT Pair_Number_{Opponent_Pair_Direction}) AS opponents FROM self GROUP BY 1, 2", {"Player_Direction": "E", "Partner_Direction": "W", "Pair_Direction": "EW", "Opponent_Pair_Direction": "NS"})
O["qry2_macros"] = X.oracle("SELECT Player_ID_E AS me, Player_ID_W AS partner, count(DISTINCT Pair_Number_NS) AS opponents FROM br GROUP BY 1, 2", "br")
REPORT = [("Boards", ["SELECT Board AS k, count(*) AS n FROM self GROUP BY Board"]), ("Pairs", ["SELECT Pair_Number_NS AS k, count(*) AS n FROM self GROUP BY 1", "SELECT Pair_Number_EW AS k, count(*) AS n FROM self GROUP BY 1"])]


def report(spark, sf):
    out = None
    for title, df in Y.run_report(X.board_results(spark, sf), REPORT).items():
        part = df.select(F.lit(title).alias("title"), F.col("k").cast("int").alias("k"), "n")
        out = part if out is None else out.unionByName(part)
    return out


Q["qry3_report"] = report
O["qry3_report"] = X.oracle("SELECT 'Boards 1' AS title, Board AS k, count(*) AS n FROM br GROUP BY Board UNION ALL SELECT 'Pairs 1', Pair_Number_NS, count(*) FROM br GROUP BY 2 UNION ALL SELECT 'Pairs 2', Pair_Number_EW, count(*) FROM br GROUP BY 2", "br")
Q["qry4_display_casts"] = lambda s, d: Y.display_casts(X.board_results(s, d).select("session_id", "Board", F.coalesce(F.col("Result").cast("string"), F.lit("adj")).alias("Result"), F.col("Score_NS").cast("string")))
O["qry4_display_casts"] = X.oracle("SELECT session_id, Board, Result, Score_NS FROM br", "br")
Q["qry5_search_members"] = lambda s, d: (lambda c: Y.search_members(c, " CUSTOMER#0000000 ".strip().lower() + "1", "c_custkey", "c_name").unionByName(Y.search_members(c, "77", "c_custkey", "c_name")))(X.table(s, d, "customer").select("c_custkey", "c_name"))
O["qry5_search_members"] = "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'customer#00000001') UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77"
