"""Queries MPS1 to MPS12 and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import contracts as C
from ..operators import matchpoints as M
from .scoring import SPLIT

Q, O = {}, {}
KEYS = [*M.BOARD, "Pair_Number_NS", "Pair_Number_EW"]
K = ", ".join(KEYS)
KB = ", ".join(M.BOARD)


def reg(name, run, sql, *ctes):
    Q[name] = run
    O[name] = X.oracle(sql, *(ctes or ("br",)))


def scored(spark, sf):
    return M.matchpoints(C.split_contract(X.board_results(spark, sf)))


W = f"(PARTITION BY {KB})"
MP = f"""(SELECT *, count(Score_NS) OVER {W} - 1 AS MP_Top, CASE WHEN Score_NS IS NOT NULL THEN (SELECT count(*) FILTER (y.Score_NS < x.Score_NS) + (count(*) FILTER (y.Score_NS = x.Score_NS) - 1) / 2.0 FROM br y WHERE y.session_id = x.session_id AND y.section_id = x.section_id AND y.Board = x.Board) END AS MP_NS FROM {SPLIT} x)"""
MP2 = f"(SELECT *, MP_Top - MP_NS AS MP_EW FROM (SELECT * REPLACE (CASE WHEN Score_NS IS NOT NULL THEN MP_Top END AS MP_Top) FROM {MP}))"
reg("mps1_matchpoints", lambda s, d: scored(s, d).select(*KEYS, "Score_NS", "MP_NS", "MP_EW"), f"SELECT {K}, Score_NS, MP_NS, MP_EW FROM {MP2}")


def tops(spark, sf):
    """Three ways to a top: scores with a given top, percentages that were given, matchpoints that were given."""
    b = C.split_contract(X.board_results(spark, sf)).withColumn("MP_Top", F.when(F.col("p") % 5 > 0, F.lit(4).cast("long")))
    rows = []
    for way, part in (("scores", b), ("percentages", b.withColumns({"Pct_NS": F.col("p") % 100 / 100, "Pct_EW": 1 - F.col("p") % 100 / 100})), ("matchpoints", b.withColumns({"MP_NS": F.col("p") % 9 / 4, "MP_EW": F.col("s") % 9 / 4}))):
        part = M.board_top(part)
        rows.append(part.select(F.lit(way).alias("way"), *KEYS, "MP_Top", *[(F.col(c) if c in part.columns else F.lit(None).cast("double")).alias(c) for c in ("MP_NS", "MP_EW")]))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


TOPS = f"(SELECT *, count(Score_NS) OVER {W} - 1 AS field, CASE WHEN p % 5 > 0 THEN 4 END AS given FROM br)"
reg("mps2_board_top", tops, f"""SELECT 'scores' AS way, {K}, coalesce(least(given, field), field) AS MP_Top, NULL::DOUBLE AS MP_NS, NULL::DOUBLE AS MP_EW FROM {TOPS} WHERE field > 0
  UNION ALL SELECT 'percentages', {K}, t, round((p % 100 / 100) * t, 2), round((1 - p % 100 / 100) * t, 2) FROM (SELECT *, coalesce(least(given, field), field) AS t FROM {TOPS}) WHERE t > 0
  UNION ALL SELECT 'matchpoints', {K}, round(p % 9 / 4 + s % 9 / 4)::BIGINT, p % 9 / 4, s % 9 / 4 FROM br WHERE round(p % 9 / 4 + s % 9 / 4) > 0""")
reg("mps3_percentages", lambda s, d: M.percentages(scored(s, d).where("MP_Top > 0")).select(*KEYS, "Pct_NS", "Pct_EW", "Pct_Declarer"),
    f"SELECT {K}, MP_NS / MP_Top AS Pct_NS, MP_EW / MP_Top AS Pct_EW, CASE WHEN D IN ('N', 'S') THEN MP_NS / MP_Top WHEN D IN ('E', 'W') THEN MP_EW / MP_Top END AS Pct_Declarer FROM {MP2} WHERE MP_Top > 0")
FREQ = f"(SELECT {KB}, Score_NS AS score, count(*) AS n FROM br WHERE Score_NS IS NOT NULL GROUP BY ALL)"


def sf_sql(freq, pct="pct"):
    return f"""SELECT {KB}, score, n, beats, n - 1 AS ties, pairs, beats + (n - 1) / 2 AS mp, {pct.replace('pct', 'CASE WHEN pairs > 1 THEN (beats + (n - 1) / 2) / (pairs - 1) ELSE beats + (n - 1) / 2 END')} AS pct
  FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY {KB} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS beats, sum(n) OVER {W}::BIGINT AS pairs FROM {freq})"""


reg("mps4_score_frequencies", lambda s, d: M.score_frequencies(M.frequencies(X.board_results(s, d))), sf_sql(FREQ))


def hypo(spark, sf):
    b = X.board_results(spark, sf)
    return M.hypothetical(b.withColumn("h", F.col("Score_NS") + F.col("p") % 3 * 10), M.frequencies(b), "h").select(*KEYS, "h", "Hypo_Pct")


CNT = lambda cond: f"(SELECT count(*) FROM br y WHERE y.session_id = x.session_id AND y.section_id = x.section_id AND y.Board = x.Board AND y.Score_NS IS NOT NULL AND {cond})"
reg("mps5_hypothetical_score", hypo, f"""SELECT {K}, h, CASE WHEN np > 0 THEN CASE WHEN eq > 0 THEN CASE WHEN np > 1 THEN (lt + (eq - 1) / 2) / (np - 1) ELSE lt + (eq - 1) / 2 END ELSE lt / np END END AS Hypo_Pct
  FROM (SELECT *, {CNT('true')} AS np, {CNT('y.Score_NS = x.h')} AS eq, {CNT('y.Score_NS < x.h')} AS lt FROM (SELECT *, Score_NS + p % 3 * 10 AS h FROM br) x)""")


def inserted(spark, sf):
    f = M.frequencies(X.board_results(spark, sf))
    return M.insert_score(f, f.select(*M.BOARD).distinct().withColumn("score", F.lit(420)))


reg("mps6_insert_score", inserted, sf_sql(f"(SELECT {KB}, score, sum(n)::BIGINT AS n FROM (SELECT * FROM {FREQ} UNION ALL SELECT DISTINCT {KB}, 420, 1 FROM {FREQ}) GROUP BY ALL)", "round(pct, 2)"))


def own(spark, sf):
    b = X.board_results(spark, sf).withColumns({"A": F.lit(110), "B": F.when(F.col("p") % 7 > 0, F.col("s") % 9 * 50 - 200)})
    return M.own_score_matchpoints(b, ["A", "B"]).select(*KEYS, "MP_A", "MP_B")


WD = "(PARTITION BY session_id, deal_id, Board)"  # all sections of a deal
P = lambda c: f"sum(CASE WHEN {c} > Score_NS THEN 1.0 WHEN {c} = Score_NS THEN 0.5 ELSE 0.0 END) OVER {WD}"
reg("mps7_own_score_matchpoints", own, f"SELECT {K}, {P('A')} AS MP_A, {P('B')} AS MP_B FROM (SELECT *, 110 AS A, CASE WHEN p % 7 > 0 THEN s % 9 * 50 - 200 END AS B FROM br)")


reg("mps8_all_pairs_count", lambda s, d: M.all_pairs(X.board_results(s, d), "Score_NS", "points").select(*KEYS, "Score_NS", "points"),
    f"""SELECT {K}, Score_NS, (SELECT sum(CASE WHEN coalesce(x.Score_NS, 0) > coalesce(y.Score_NS, 0) THEN 1.0 WHEN coalesce(x.Score_NS, 0) = coalesce(y.Score_NS, 0) THEN 0.5 ELSE 0 END) FROM br y WHERE y.session_id = x.session_id AND y.deal_id = x.deal_id AND y.Board = x.Board) AS points FROM br x""")


def field_share(spark, sf):
    b = X.board_results(spark, sf).withColumn("ref", F.when(F.col("p") % 11 > 0, F.col("s") % 13 * 50 - 300))
    return M.beaten(b, M.frequencies(b), "ref", "share").select(*KEYS, "ref", "share")


reg("mps9_percent_of_field", field_share, f"""SELECT {K}, ref, CASE WHEN ref IS NOT NULL AND nd > 0 THEN share END AS share FROM (SELECT *, (SELECT count(DISTINCT Score_NS) FILTER (y.Score_NS < ref) + count(DISTINCT Score_NS) FILTER (y.Score_NS = ref) / 2 FROM br y WHERE y.session_id = x.session_id AND y.section_id = x.section_id AND y.Board = x.Board) / greatest(1, nd) AS share
  FROM (SELECT *, (SELECT count(DISTINCT Score_NS) FROM br z WHERE z.session_id = x0.session_id AND z.section_id = x0.section_id AND z.Board = x0.Board) AS nd FROM (SELECT *, CASE WHEN p % 11 > 0 THEN s % 13 * 50 - 300 END AS ref FROM br) x0) x)""")
reg("mps10_capped_percentage", lambda s, d: scored(s, d).select(*KEYS, M.capped(F.col("MP_NS"), F.col("MP_Top")).alias("pct")), f"SELECT {K}, CASE WHEN MP_NS IS NOT NULL THEN least(MP_NS / (MP_Top + 1), 1.0) END AS pct FROM {MP2}")
OWN = f"(SELECT *, {P('A')} AS MP_A, {P('B')} AS MP_B FROM (SELECT *, 110 AS A, CASE WHEN p % 7 > 0 THEN s % 9 * 50 - 200 END AS B FROM {MP2}))"


def best(spark, sf):
    b = scored(spark, sf).withColumns({"A": F.lit(110), "B": F.when(F.col("p") % 7 > 0, F.col("s") % 9 * 50 - 200)})
    return M.own_score_matchpoints(b, ["A", "B"]).withColumn("best", M.best_of(["MP_A", "MP_B"], F.col("MP_Top")))


BEST = "CASE WHEN MP_Top > 0 THEN least(greatest(coalesce(MP_A, 0), coalesce(MP_B, 0)) / MP_Top, 1.0) ELSE 0.0 END"
reg("mps11_best_hypothetical", lambda s, d: best(s, d).select(*KEYS, "best"), f"SELECT {K}, {BEST} AS best FROM {OWN}")


def diffs(spark, sf):
    """Percentages against the best of two families of hypothetical scores."""
    b = M.percentages(best(spark, sf)).withColumns({"EV_Pct_Max_NS": F.col("best"), "EV_Pct_Max_EW": F.when(F.col("p") % 3 > 0, 1 - F.col("best"))})
    b = b.withColumns({f"DD_Pct_Max_{p}": M.best_of([f"MP_{c}"], F.col("MP_Top")) for p, c in (("NS", "A"), ("EW", "B"))})
    return M.differences(b).select(*KEYS, *[f"{k}_Diff_{p}" for k in ("EV_Pct_Max", "DD_Pct_Max", "DD_EV_Pct_Max") for p in ("NS", "EW")])


SHARE = lambda c: f"CASE WHEN MP_Top > 0 THEN least(coalesce({c}, 0) / MP_Top, 1.0) ELSE 0.0 END"
reg("mps12_differences", diffs, "SELECT " + K + ", " + ", ".join(f"pct_{p} - ev_{p} AS EV_Pct_Max_Diff_{p}, pct_{p} - dd_{p} AS DD_Pct_Max_Diff_{p}, dd_{p} - ev_{p} AS DD_EV_Pct_Max_Diff_{p}" for p in ("NS", "EW"))
    + f" FROM (SELECT *, {BEST} AS ev_NS, CASE WHEN p % 3 > 0 THEN 1 - {BEST} ELSE 0 END AS ev_EW, {SHARE('MP_A')} AS dd_NS, {SHARE('MP_B')} AS dd_EW, coalesce(CASE WHEN MP_Top > 0 THEN MP_NS / MP_Top END, 0) AS pct_NS, coalesce(CASE WHEN MP_Top > 0 THEN MP_EW / MP_Top END, 0) AS pct_EW FROM {OWN})")
