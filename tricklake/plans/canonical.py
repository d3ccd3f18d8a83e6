"""Queries CAN1 to CAN11 and CAN13 to CAN23 and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import bridge as B
from ..operators import canonical as N
from ..operators import contracts as C

Q, O = {}, {}
P = "session_id, section_id, Board, Pair_Number_NS, Pair_Number_EW"
PK = P.split(", ")


def reg(name, run, sql, *ctes):
    Q[name] = run
    O[name] = X.oracle(sql, *ctes)


def frenchify(c):
    """Canonical contract -> the first provider's text."""
    strain = F.substring(c, 2, 1)
    fr = F.when(strain == "N", "SA").when(strain == "S", "P").when(strain == "H", "C").when(strain == "D", "K").otherwise("T")
    return F.when(c == "PASS", "passe").otherwise(F.concat(F.substring(c, 1, 1), fr, F.substring(c, F.lit(3), F.length(c) - 3)))


def results_text(r):
    return F.when(r == 0, "=").when(r > 0, F.concat(F.lit("+"), r.cast("string"))).otherwise(r.cast("string"))


def simultaneous(spark, sf):
    b = X.board_results(spark, sf).withColumn("section", F.concat_ws("-", F.col("session_id").cast("string"), F.col("section_id").cast("string")))
    b = C.split_contract(b)
    seat = F.when(F.col("Declarer_Direction") == "W", "O").otherwise(F.col("Declarer_Direction"))
    rows = b.select("section", F.col("Board").alias("board"), frenchify(F.col("Contract")).alias("contrat"), seat.alias("declarant"), results_text(F.col("Result")).alias("resultat"), F.col("Score_NS").cast("string").alias("score"), "Pair_Number_NS", "Pair_Number_EW", "o", "p", "s")
    deals = b.where("Board <> 7").select("section", F.col("Board").alias("board"), F.concat(F.lit("deal "), F.col("deal_id").cast("string")).alias("deal")).distinct()
    return N.from_simultaneous(rows, deals, seat_players(b)).select("section", "board", "deal", "Contract", "Result", "Score_NS", "Pair_Number_NS", "Pair_Number_EW", *[f"Player_ID_{d}" for d in "NESW"], "MP_Top", "MP_NS", F.round("Pct_NS", 8).alias("Pct_NS"))


def seat_players(b):
    """The players of each section's pairs: two rows a pair, by formula."""
    pairs = b.select("section", F.explode(F.array(F.struct(F.lit("NS").alias("side"), F.col("Pair_Number_NS").alias("pair")), F.struct(F.lit("EW").alias("side"), F.col("Pair_Number_EW").alias("pair")))).alias("x")).select("section", "x.*").distinct()
    return pairs.where("pair <> 5").withColumn("position", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("id", F.concat_ws("/", "section", "side", F.col("pair").cast("string"), F.col("position").cast("string")))


PL = lambda side, pair, pos: f"CASE WHEN {pair} <> 5 THEN section || '/{side}/' || {pair} || '/{pos}' END"
reg("can1_simultaneous", simultaneous, f"""SELECT section, board, 'deal ' || deal_id AS deal, Contract, Result, Score_NS, Pair_Number_NS, Pair_Number_EW, {PL('NS', 'Pair_Number_NS', 1)} AS Player_ID_N, {PL('EW', 'Pair_Number_EW', 1)} AS Player_ID_E,
  {PL('NS', 'Pair_Number_NS', 2)} AS Player_ID_S, {PL('EW', 'Pair_Number_EW', 2)} AS Player_ID_W, top AS MP_Top, below + (ties - 1) / 2 AS MP_NS, CASE WHEN top > 0 THEN round((below + (ties - 1) / 2) / top, 8) END AS Pct_NS
  FROM (SELECT x.*, CASE WHEN Score_NS IS NOT NULL THEN count(Score_NS) OVER (PARTITION BY board) - 1 END AS top, CASE WHEN Score_NS IS NOT NULL THEN count(*) OVER (PARTITION BY board, Score_NS) END AS ties, CASE WHEN Score_NS IS NOT NULL THEN
    count(Score_NS) OVER (PARTITION BY board ORDER BY Score_NS NULLS LAST RANGE UNBOUNDED PRECEDING) - count(*) OVER (PARTITION BY board, Score_NS) END AS below
    FROM (SELECT DISTINCT session_id || '-' || section_id AS section, Board AS board, deal_id, Contract, Result, Score_NS, Pair_Number_NS, Pair_Number_EW, o, p, s FROM br WHERE Board <> 7) x)""", "br")


def second(spark, sf):
    b = X.board_results(spark, sf)
    freq = F.transform(F.sequence(F.lit(1), (F.col("p") % 4 + 1).cast("int")), lambda i: F.struct((i * 50).cast("string").alias("ns_score"), F.lit(None).cast("string").alias("ew_score"), (i + F.col("s") % 3).cast("long").alias("count")))
    size = F.abs("Score_NS").cast("string")
    note = (F.col("o") % 101).cast("double")
    r = b.select("session_id", "Board", F.when(F.col("Contract") == "PASS", "PASS").when(F.col("p") % 2 == 0, size).alias("ns_score"), F.when(F.col("p") % 2 == 1, size).alias("ew_score"), note.alias("ns_note"), (100 - note).alias("ew_note"),
                 F.when(F.col("s") % 2 == 0, "NS").otherwise("EW").alias("home_orientation"), F.col("Pair_Number_NS").alias("home"), F.col("Pair_Number_EW").alias("away"), freq.alias("frequencies"))
    return N.from_second(r).select("session_id", "Board", "Score_NS", "MP_Top", "Pair_Number_NS", "Pair_Number_EW", "Pct_NS", F.round(F.col("MP_NS") * 100).cast("long").alias("mp100"))


reg("can2_second_provider", second, """SELECT session_id, Board, CASE WHEN size IS NULL THEN NULL WHEN note >= 100 - note THEN size ELSE -size END AS Score_NS, top AS MP_Top, CASE WHEN s % 2 = 0 THEN Pair_Number_NS ELSE Pair_Number_EW END AS Pair_Number_NS,
  CASE WHEN s % 2 = 0 THEN Pair_Number_EW ELSE Pair_Number_NS END AS Pair_Number_EW, note / 100 AS Pct_NS, note::BIGINT * top AS mp100
  FROM (SELECT *, CASE WHEN Contract = 'PASS' AND p % 2 = 1 THEN 0 WHEN Contract = 'PASS' THEN 0 ELSE abs(Score_NS) END AS size, o % 101 AS note, (SELECT sum(i + s % 3) FROM range(1, p % 4 + 2) r(i))::BIGINT - 1 AS top FROM br)""", "br")


def expand(spark, sf):
    b = X.board_results(spark, sf)
    f = F.array(F.struct(F.lit("420").alias("ns_score"), F.lit(None).cast("string").alias("ew_score"), (F.col("p") % 3).alias("count")), F.struct(F.lit(None).cast("string").alias("ns_score"), F.lit("50").alias("ew_score"), F.lit(2).cast("long").alias("count")), F.struct(F.lit("60%").alias("ns_score"), F.lit("40%").alias("ew_score"), F.lit(1).cast("long").alias("count")))
    return N.expand_scores(b.select(*PK, f.alias("frequencies"))).select(*PK, F.array_join(F.transform("All_Scores", lambda x: x.cast("string")), ",", "?").alias("scores"))


reg("can3_expand_scores", expand, f"SELECT {P}, repeat('420,', (p % 3)::INTEGER) || '-50,-50,?' AS scores FROM br", "br")
reg("can4_signed_score", lambda s, d: X.board_results(s, d).select(*PK, N.signed_score(F.when(F.col("p") % 3 == 0, "n/a").when(F.col("Contract") == "PASS", " pass ").otherwise(F.abs("Score_NS").cast("string")), F.lit("90"), (F.col("o") % 5).cast("double"), F.lit(2.0)).alias("score")),
    f"SELECT {P}, CASE WHEN o % 5 >= 2 THEN 1 ELSE -1 END * CASE WHEN p % 3 = 0 THEN 90 WHEN Contract = 'PASS' THEN 0 ELSE coalesce(abs(Score_NS), 90) END AS score FROM br", "br")


def french_suits(spark, sf):
    h = F.flatten(B.hands(F.col("PBN")))
    d = X.deals(spark, sf).select("deal_id", F.transform(h, lambda s: F.translate(s, "KQJT", "RDV0")).alias("fr"))
    return d.select("deal_id", N.deal_of_suits([F.col("fr")[i] for i in range(16)]).alias("PBN"))


reg("can5_suits_to_deal", french_suits, "SELECT deal_id, PBN FROM deals", "deals")
reg("can6_rotate_deal", lambda s, d: X.deals(s, d).select("deal_id", N.deal_from_north(F.concat(B.nth("NESW", F.col("deal_id") % 4), F.substring("PBN", 2, 100))).alias("PBN")),
    "SELECT d.deal_id, 'N:' || string_agg(h, ' ' ORDER BY (i + d.deal_id) % 4) AS PBN FROM deals d, (SELECT deal_id, unnest(string_split(substr(PBN, 3), ' ')) AS h, unnest(range(4)) AS i FROM deals) x WHERE x.deal_id = d.deal_id GROUP BY d.deal_id", "deals")
reg("can7_club_code", lambda s, d: X.table(s, d, "customer").select("c_custkey", N.club_code(F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).when(F.col("c_custkey") % 11 == 0, " 000 ").otherwise(F.concat(F.lit(" 00"), F.col("c_custkey").cast("string")))).alias("code")),
    "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN '0' ELSE c_custkey::VARCHAR END AS code FROM customer")


#: dimension: its key, whether a key is in it, the attribute as a text of the key
DIMS = {
    "session_name": ("session_id", "session_id % 9 <> 4", "session "), "section_name": ("section_id", "section_id <> 2", "section "), "board_name": ("Board", "true", "board "), "ns_name": ("Pair_Number_NS", "Pair_Number_NS <> 5", "pair "),
    "ew_name": ("Pair_Number_EW", "Pair_Number_EW <> 7", "pair "), "player_name": ("Player_ID_N", "Player_ID_N <> 'P3'", "player "), "contract_name": ("Contract", "Contract <> 'PASS'", "contract "), "deal_name": ("deal_id", "deal_id % 5 <> 1", "deal "),
}


def star(spark, sf):
    """Results with eight dimensions, each with a row for most of its keys."""
    b = X.board_results(spark, sf)
    dims = [(b.where(f"{key} is not null and {there}").select(key).distinct().withColumn(name, F.concat(F.lit(text), F.col(key).cast("string"))), [key]) for name, (key, there, text) in DIMS.items()]
    return N.star_join(b, dims).select(*PK, *DIMS)


reg("can8_star_join", star, f"SELECT {P}, " + ", ".join(f"CASE WHEN {there} THEN '{text}' || {key} END AS {name}" for name, (key, there, text) in DIMS.items()) + " FROM br", "br")
reg("can9_first_last_player", lambda s, d: N.first_and_last_player(X.table(s, d, "orders").select(F.col("o_custkey").alias("pair"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("n")), ["pair"], "n"), "SELECT o_custkey AS pair, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM orders GROUP BY 1")


def sided(spark, sf):
    b = X.board_results(spark, sf).groupBy(*PK).agg(F.max("Score_NS").alias("score"))
    ns = b.select("session_id", "section_id", "Board", F.lit("NS").alias("side"), F.col("Pair_Number_NS").alias("pair"), F.col("Pair_Number_EW").alias("opponent"), "score")
    ew = b.where("Board <> 3").select("session_id", "section_id", "Board", F.lit("EW").alias("side"), F.col("Pair_Number_EW").alias("pair"), F.col("Pair_Number_NS").alias("opponent"), (-F.col("score")).alias("score"))
    return N.two_sided(ns.unionByName(ew), ["session_id", "section_id", "Board"])


reg("can10_two_sided", sided, f"SELECT {P}, max(Score_NS) AS Score_NS, -max(Score_NS) AS Score_EW FROM br WHERE Board <> 3 GROUP BY ALL", "br")


def raw_rows(spark, sf):
    b = C.split_contract(X.board_results(spark, sf))
    c = F.when(F.col("BidLvl").isNotNull(), F.concat(F.lit(" "), F.col("BidLvl").cast("string"), F.lit(" "), F.lower(F.replace("BidSuit", F.lit("N"), F.lit("NT"))), F.lower("Dbl"))).when(F.col("Contract") == "PASS", "pass")
    return b.select("session_id", (F.col("Board") - 2).alias("board"), c.alias("contract"), F.lower("Declarer_Direction").alias("declarer"), results_text(F.col("Result")).alias("result"), F.when(F.col("Contract") == "PASS", "PASS").otherwise(F.col("Score_NS").cast("string")).alias("score"), (F.col("o") % 130).cast("double").alias("percentage"))


Q["can11_clean_results"] = lambda s, d: N.clean_results(raw_rows(s, d)).select("session_id", F.col("board").alias("b"), "Contract", "Result", "Score_NS", "Tricks", "Pct_NS")
O["can11_clean_results"] = X.oracle("SELECT session_id, Board - 2 AS b, Contract, Result, Score_NS, Tricks, least(1.0, (o % 130) / 100) AS Pct_NS FROM br WHERE Board > 2", "br")


def standing(spark, sf):
    st = X.table(spark, sf, "customer").where("c_custkey <> 12").select(F.col("c_custkey").cast("int").alias("pair"), F.concat(F.lit("A"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") != 4, F.concat(F.lit(" & B"), F.col("c_custkey").cast("string"))).otherwise("")).alias("players"), (F.col("c_custkey") / 2).alias("pct"))
    return N.with_standings(X.board_results(spark, sf).select(*PK), st)


nm = lambda side, a: f"CASE WHEN Pair_Number_{side} <> 12 THEN {a} || Pair_Number_{side} END"
n2 = lambda side: f"CASE WHEN Pair_Number_{side} NOT IN (4, 12) THEN 'B' || Pair_Number_{side} END"
pc = lambda side: f"CASE WHEN Pair_Number_{side} <> 12 THEN Pair_Number_{side} / 2 END AS Event_Pct_{side}"
_A = "'A'"
reg("can13_standings", standing, f"SELECT {P}, {nm('NS', _A)} AS Player_Name_N, {n2('NS')} AS Player_Name_S, {pc('NS')}, {nm('EW', _A)} AS Player_Name_E, {n2('EW')} AS Player_Name_W, {pc('EW')} FROM br", "br")


def viewed(spark, sf):
    b = X.board_results(spark, sf).select(F.col("session_id").alias("club"), F.col("Pair_Number_EW").alias("pair"), F.col("Pair_Number_NS").alias("opponent"), "Board")
    pl = b.select("club", F.col("pair")).unionByName(b.select("club", F.col("opponent").alias("pair"))).distinct().where("pair % 6 > 0").withColumn("position", F.explode(F.array(F.lit(1), F.lit(2))))
    return N.attach_viewed_pair(b, pl.withColumn("id", F.col("pair") * 10 + F.col("position")), "EW")


reg("can14_viewed_pair", viewed, "SELECT session_id AS club, Pair_Number_EW AS pair, Pair_Number_NS AS opponent, Board, " + ", ".join(f"CASE WHEN Pair_Number_{s} % 6 > 0 THEN Pair_Number_{s} * 10 + {i} END AS Player_ID_{d}" for s in ("NS", "EW") for i, d in enumerate(s, 1)) + " FROM br", "br")
reg("can15_keep_first", lambda s, d: N.keep_first(X.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]), "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
reg("can16_name_order", lambda s, d: X.table(s, d, "part").select("p_partkey", N.first_last(F.concat(F.upper("p_brand"), F.lit(",  "), F.col("p_name"))).alias("name")),
    "SELECT p_partkey, array_to_string(list_slice(w, 2, len(w)) || [w[1]], ' ') AS name FROM (SELECT p_partkey, string_split_regex(trim(replace(upper(p_brand) || ',  ' || p_name, ',', ' ')), '\\s+') AS w FROM part)")
reg("can17_record_text", lambda s, d: X.deals(s, d).select("deal_id", N.record_text(F.col("PBN")).alias("record"), N.deal_of_record(N.record_text(F.col("PBN"))).alias("PBN")),
    "SELECT s.deal_id, string_agg(substr('SHDC', suit::INTEGER + 1, 1) || CASE WHEN cards = '' THEN '-' ELSE replace(cards, 'T', '10') END, '' ORDER BY [0, 2, 3, 1][seat + 1], suit) AS record, any_value(PBN) AS PBN FROM suits s JOIN deals d ON d.deal_id = s.deal_id GROUP BY s.deal_id", "deals")
reg("can18_valid_deal", lambda s, d: X.deals(s, d).select("deal_id", N.valid_deal(F.when(F.col("deal_id") % 3 == 0, F.replace("PBN", F.lit("A"), F.lit("K"))).when(F.col("deal_id") % 7 == 0, F.lit(None)).when(F.col("deal_id") % 11 == 0, F.substring("PBN", 1, 40)).otherwise(F.col("PBN"))).alias("valid")),
    "SELECT deal_id, deal_id % 3 <> 0 AND deal_id % 7 <> 0 AND deal_id % 11 <> 0 AS valid FROM deal_ids", "deal_ids")
reg("can19_standard_contract", lambda s, d: X.board_results(s, d).select(*PK, N.standard_contract(F.translate(F.replace(F.lower("Contract"), F.lit("n"), F.lit("nt")), "hd", "♥♦")).alias("c")),
    f"SELECT {P}, replace(upper(replace(replace(translate(lower(Contract), '♥♦', 'hd'), 'n', 'n'), 'n', 'n')), 'NT', 'N') AS c FROM br", "br")


def pooled(spark, sf):
    b = X.board_results(spark, sf)
    return N.pool_boards([b.where("Board = 1").select("session_id", F.col("Board").cast("smallint"), "Score_NS"), b.where("Board = 2").select("session_id", "Board", F.col("Score_NS").cast("double"), "Contract"), b.where("Board > 2").select("Board", "Contract")])


reg("can20_pool_boards", pooled, "SELECT CASE WHEN Board <= 2 THEN session_id END AS session_id, Board, CASE WHEN Board <= 2 THEN Score_NS::DOUBLE END AS Score_NS, CASE WHEN Board >= 2 THEN Contract END AS Contract FROM br", "br")


def team(spark, sf):
    mine, teams = N.team_boards(X.board_results(spark, sf), 99)
    return teams.select("team").unionByName(mine.select(F.col("Board").alias("team")))


reg("can20_missing_team", team, "SELECT Pair_Number_NS AS team FROM br UNION SELECT Pair_Number_EW FROM br", "br")
MONTHS = {int(v): k for k, v in N.FRENCH_MONTHS.items()}


def by_date(spark, sf):
    o = X.table(spark, sf, "orders")
    text = F.concat_ws(" ", F.dayofmonth("o_orderdate").cast("string"), B.lookup(MONTHS, F.month("o_orderdate")), F.year("o_orderdate").cast("string"))
    day = o.agg(F.min("o_orderdate").cast("date").cast("string")).first()[0]
    return N.events_on(o.select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "Inconnu").otherwise(text).alias("t")), "t", day).select("o_orderkey", "Event_Date")


reg("can21_events_on_date", by_date, "SELECT o_orderkey, o_orderdate::DATE AS Event_Date FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderdate::DATE = (SELECT min(o_orderdate)::DATE FROM orders)")


def sessions(spark, sf):
    o = X.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("player")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))).alias("r"))
    items = o.select("player", F.transform("r", lambda x: F.struct((x["o_orderkey"] % 4).alias("id"), (x["o_orderkey"] % 3 > 0).alias("has_result"), x["o_orderkey"].cast("string").alias("day"), x["o_orderpriority"].alias("session"), F.when(x["o_orderstatus"] == "F", x["o_orderstatus"]).alias("place"))).alias("results"))
    return N.player_sessions(items)


reg("can22_player_sessions", sessions, "SELECT o_custkey AS player, o_orderkey % 4 AS id, concat_ws(' ', o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'F' END) AS label FROM orders WHERE o_orderkey % 3 > 0 QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 ORDER BY o_orderkey) = 1")
reg("can23_session_links", lambda s, d: N.session_links(X.table(s, d, "customer").groupBy("c_nationkey").agg(F.collect_list(F.struct(F.concat_ws("-", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))).alias("data")), "https://example.org/s"),
    "SELECT id, 'https://example.org/s/' || replace(id, '-', '/') AS url, 'https://example.org/s/' || replace(id, '-', '/') || '/summary' AS summary_url, id || ', ' || c_name AS description FROM (SELECT c_nationkey || '-' || c_custkey AS id, c_name FROM customer)")
