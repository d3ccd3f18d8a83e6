"""Queries BID1 to BID13 and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import bridge as B
from ..operators import bidding as R
from ..operators import contracts as C
from .deals import DP, HCP, LTC
from .tables import folder

Q, O = {}, {}


def reg(name, run, sql, *ctes):
    Q[name] = run
    O[name] = X.oracle(sql, *ctes) if ctes else sql


#: a small rule book: id, parent, bid, requirements
BOOK = [
    (1, 0, "1N", ["HCP >= 15", "HCP <= 17", "Balanced"]), (2, 0, "1S", ["HCP >= 12", "SL_S >= 5"]), (3, 0, "1H", ["HCP >= 12", "SL_H >= 5"]), (4, 0, "1D", ["HCP >= 12", "SL_D >= 4"]), (5, 0, "1C", ["HCP >= 12", "SL_C >= 3"]),
    (6, 0, "2C", ["HCP >= 20"]), (7, 0, "2H", ["HCP >= 6", "HCP <= 10 # weak", "SL_H >= 6"]), (8, 0, "3N", ["No_Such_Thing >= 3"]), (9, 0, "5N", []), (10, 2, "2S", ["SL_S >= 3", "HCP <= 9"]), (11, 2, "3S", ["SL_S >= 4", "HCP >= 10"]),
    (12, 10, "4S", ["HCP >= 16"]), (13, 1, "3N", ["HCP >= 10"]), (14, 1, "2C", ["HCP >= 8", "SL_S >= 4"]), (15, 3, "2H", ["SL_H >= 3"]), (16, 15, "4H", ["HCP >= 17"]), (17, 5, "1H", ["SL_H >= 4", "HCP >= 6"]), (18, 17, "2H", ["SL_H >= 4"]), (19, 11, "4S", ["HCP >= 13"]),
]
CLEAN = [(i, p, b, [x.split("#")[0].strip() for x in r]) for i, p, b, r in BOOK]
PREDICATES = sorted({x for _, _, _, r in CLEAN for x in r})


def rules(spark):
    return spark.createDataFrame(BOOK, "rule_id int, parent int, bid string, requirements array<string>")


_FORMS = ["{a}", "{a}-", "{a}+", "{a}-{b}", "{a} losers", "{a}+ !{s}", "{a}-card !{s}", "{a}-{b} !{s}", "{a}-{b} HCP", "{a}+ total_points", "AK+_in !{s}", "!{s}AQ", "{s}K", "at_best {a}-card !{s}", "biddable !{s}", "forcing", "forcing_to 2N",
          "likely_stop-stop_in !{s}", "no !{s}", "no !{s}KQ", "partial_stop_in !{s}", "partial_stop-likely_stop_in !{s}", "solid 6-card !{s}", "two_stops_in !{s}", "nonsense"]


def phrases(spark, sf):
    k = F.col("o_orderkey")
    form = F.element_at(F.array(*[F.lit(f) for f in _FORMS]), (k % len(_FORMS) + 1).cast("int"))
    for name, value in (("{a}", (k % 14).cast("string")), ("{b}", (k % 14 + 3).cast("string")), ("{s}", F.substring(F.lit("SHDC"), (k % 4 + 1).cast("int"), F.lit(1)))):
        form = F.replace(form, F.lit(name), value)
    return X.table(spark, sf, "orders").select("o_orderkey", form.alias("phrase"))


def phrase_sql():
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    form = f"[{', '.join(map(lit, _FORMS))}][o_orderkey % {len(_FORMS)} + 1]"
    text = f"replace(replace(replace({form}, '{{a}}', (o_orderkey % 14)::VARCHAR), '{{b}}', (o_orderkey % 14 + 3)::VARCHAR), '{{s}}', substr('SHDC', (o_orderkey % 4 + 1)::INTEGER, 1))"
    cases = []
    for pattern, template in R.PHRASES:
        if template.startswith("*"):
            g, tail = int(template[1]), template[3:].partition(" ")[2]
            cards = f"list_filter(string_split(regexp_extract(phrase, {lit(pattern)}, {g}), ''), lambda c: c <> '')"
            value = f"array_to_string(list_transform({cards}, lambda c: 'C_' || regexp_extract(phrase, {lit(pattern)}, {3 - g}) || c || {lit(' ' + tail if tail else '')}), ', ')"
        else:
            value = f"regexp_replace(phrase, {lit(pattern)}, {lit(template.replace('$', chr(92)))})"
        cases.append(f"WHEN regexp_matches(phrase, {lit(pattern)}) THEN {value}")
    return f"SELECT o_orderkey, phrase, CASE {' '.join(cases)} END AS predicates FROM (SELECT o_orderkey, {text} AS phrase FROM orders)"


reg("bid1_phrases", lambda s, d: phrases(s, d).withColumn("predicates", F.array_join(R.predicates_of(F.col("phrase")), ", ")), phrase_sql())


def rule_texts(spark, sf):
    k = F.col("o_orderkey")
    return X.table(spark, sf, "orders").select(F.concat(F.lit("  SL_"), F.substring(F.lit("SHDC"), (k % 4 + 1).cast("int"), F.lit(1)), F.lit(" >= "), (k % 6).cast("string"), F.when(k % 3 == 0, " # note").otherwise("")).alias("r")).unionByName(X.table(spark, sf, "orders").where("o_orderkey % 10 = 0").select(F.lit(" # only a note").alias("r")))


reg("bid2_distinct_predicates", lambda s, d: R.distinct_predicates(rule_texts(s, d), "r").select("predicate", F.array_join("variables", ",").alias("variables")),
    "SELECT DISTINCT 'SL_' || substr('SHDC', (o_orderkey % 4 + 1)::INTEGER, 1) || ' >= ' || o_orderkey % 6 AS predicate, 'SL_' || substr('SHDC', (o_orderkey % 4 + 1)::INTEGER, 1) AS variables FROM orders")


def seats_and_ids(spark, sf):
    k = F.col("o_orderkey")
    form = F.element_at(F.array(*[F.lit(x) for x in ("HCP >= 12", "SL_S >= 5", "C_HA", "Biddable_D", "Balanced", "Stop_In_C", "Solid_H")]), (k % 7 + 1).cast("int"))
    r = X.table(spark, sf, "orders").select(k.alias("rule_id"), F.array(form, F.lit("Losers <= 7")).alias("requirements"))
    ids, needs = R.with_predicate_ids(r)
    return needs.join(ids, "predicate_id").select("rule_id", "predicate_id", *[R.for_seat(F.col("predicate"), d).alias(d) for d in "NW"])


_F3 = ["HCP >= 12", "SL_S >= 5", "C_HA", "Biddable_D", "Balanced", "Stop_In_C", "Solid_H"]
_S3 = {"HCP >= 12": "HCP_{d} >= 12", "SL_S >= 5": "SL_{d}_S >= 5", "C_HA": "C_{d}HA", "Biddable_D": "Biddable_{d}_D", "Balanced": "Balanced", "Stop_In_C": "Stop_In_{d}_C", "Solid_H": "Solid_{d}_H", "Losers <= 7": "Losers_{d} <= 7"}
reg("bid3_seat_predicates", seats_and_ids, f"""SELECT rule_id, predicate_id, {', '.join("[" + ', '.join(f"'{_S3[p].format(d=d)}'" for p in sorted(_S3)) + f"][predicate_id] AS {d}" for d in 'NW')}
  FROM (SELECT o_orderkey AS rule_id, list_position({sorted(_S3)}, unnest([{_F3}[o_orderkey % 7 + 1], 'Losers <= 7'])) AS predicate_id FROM orders)""".replace('"', "'"))
FEATURES = f"""(SELECT deal_id, Board, substr('NESW', seat::INTEGER + 1, 1) AS seat, sum({HCP}) AS HCP, sum({HCP} + {DP}) AS Total_Points, sum({LTC}) AS Losers, {', '.join(f"sum(length(cards)) FILTER (suit = {j}) AS SL_{s}" for j, s in enumerate('SHDC'))},
  string_agg(length(cards)::VARCHAR, '' ORDER BY length(cards) DESC) IN ('4333', '4432') OR (string_agg(length(cards)::VARCHAR, '' ORDER BY length(cards) DESC) IN ('5332', '5422') AND bool_or(length(cards) = 5 AND suit >= 2)) AS Balanced FROM suits GROUP BY deal_id, Board, seat)"""


def truth(spark, sf):
    return R.evaluate(R.seat_features(X.deals(spark, sf)), PREDICATES)


def sql_of(p):
    return "false" if p.startswith("No_Such") else p


BITS = f"(SELECT deal_id, seat, unnest(list_filter([{', '.join(f'CASE WHEN {sql_of(p)} THEN {i} END' for i, p in enumerate(PREDICATES, 1))}], lambda x: x IS NOT NULL)) AS predicate_id FROM {FEATURES})"
HOLDS = " UNION ALL ".join(f"SELECT deal_id, seat, {i} AS rule_id FROM f WHERE {' AND '.join(map(sql_of, r)) or 'true'}" for i, _, _, r in CLEAN)


def with_holds(main, recursive=False):
    head = X.oracle("", "suits").rstrip() + f",\nf AS {FEATURES},\nholds AS ({HOLDS}),\nbook AS (SELECT * FROM (VALUES {', '.join(f'({i}, {p}, {chr(39)}{b}{chr(39)})' for i, p, b, _ in BOOK)}) t(rule_id, parent, bid))"
    return (head.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else head) + (", " if main.lstrip().startswith("anc AS") or main.lstrip().startswith("a AS") else "\n") + main


reg("bid4_evaluate", lambda s, d: truth(s, d).select("deal_id", "seat", F.array_join(F.transform("truth", lambda t: F.when(t, "1").otherwise("0")), "").alias("truth")),
    f"SELECT deal_id, seat, {' || '.join(f'CASE WHEN {sql_of(p)} THEN 1 ELSE 0 END' for p in PREDICATES)} AS truth FROM {FEATURES}", "suits")


def stored(spark, sf):
    """Stored for other predicates first, then for the deals with one more, then twice as wanted: three tables, the last one read."""
    path, deals = folder(spark, "bitmap"), X.deals(spark, sf)
    R.stored_bitmap(deals, PREDICATES[:1], path)
    R.stored_bitmap(deals.unionByName(deals.limit(1)), PREDICATES, path)
    R.stored_bitmap(deals, PREDICATES, path)
    return R.bitmap(R.stored_bitmap(deals, PREDICATES, path))


reg("bid5_bitmap", stored, f"SELECT * FROM {BITS}", "suits")


def turns(spark, sf):
    b = X.deals(spark, sf).select("deal_id", B.dealer_of(F.col("Board")).alias("Dealer"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("turn"))
    b = b.withColumn("seat", R.seat_of_turn(F.col("Dealer"), F.col("turn")))
    return b.withColumn("back", R.turn_of_seat(F.col("Dealer"), F.col("seat")))


reg("bid6_turns", turns, "SELECT deal_id, substr('NESW', (Board - 1) % 4 + 1, 1) AS Dealer, turn, substr('NESW', (Board + turn - 2) % 4 + 1, 1) AS seat, turn AS back FROM deal_ids, (SELECT unnest(range(1, 5))::INTEGER AS turn)", "deal_ids")


def needs(spark):
    return R.with_predicate_ids(rules(spark))[1]


def packed(spark, sf):
    return R.evaluate_packed(R.seat_features(X.deals(spark, sf)), PREDICATES)


def holding(spark, sf):
    return R.rules_that_hold(packed(spark, sf), needs(spark), rules(spark))


reg("bid7_rules_that_hold", holding, with_holds("SELECT * FROM holds"))
reg("bid8_with_ancestors", lambda s, d: R.hold_with_ancestors(holding(s, d), rules(s)),
    with_holds("anc AS (SELECT rule_id, rule_id AS ancestor, parent FROM book UNION ALL SELECT a.rule_id, b.rule_id, b.parent FROM anc a JOIN book b ON b.rule_id = a.parent)\n"
               "SELECT deal_id, seat, x.rule_id FROM (SELECT h.deal_id, h.seat, a.rule_id, count(*) AS n FROM holds h JOIN anc a ON a.ancestor = h.rule_id GROUP BY ALL) x JOIN (SELECT rule_id, count(*) AS depth FROM anc GROUP BY ALL) d ON d.rule_id = x.rule_id WHERE n = depth", True))
reg("bid9_candidates", lambda s, d: R.candidates(packed(s, d), needs(s), rules(s).where("parent = 0")).select("deal_id", "seat", F.array_join(F.transform("rules", lambda x: x.cast("string")), ",").alias("rules")),
    with_holds("SELECT f.deal_id, f.seat, coalesce(string_agg(h.rule_id::VARCHAR, ',' ORDER BY h.rule_id) FILTER (h.rule_id IN (SELECT rule_id FROM book WHERE parent = 0)), '') AS rules FROM f LEFT JOIN holds h ON h.deal_id = f.deal_id AND h.seat = f.seat GROUP BY ALL"))
reg("bid10_four_seats", lambda s, d: R.for_four_seats(X.table(s, d, "orders").select(F.col("o_orderkey").alias("bt_index"), F.concat(F.repeat(F.lit("p-"), (F.col("o_orderkey") % 4).cast("int")), F.lit("1N-p")).alias("Auction"), F.concat(F.lit("HCP >= "), (F.col("o_orderkey") % 20).cast("string")).alias("Expr"))),
    "SELECT o_orderkey AS bt_index, seat, o_orderkey * 4 + seat - 1 AS index, '1N-p' AS Auction, e AS Expr, " + ", ".join(f"CASE WHEN seat = {i} THEN e END AS Agg_Expr_Seat_{i}" for i in range(1, 5)) + " FROM (SELECT o_orderkey, 'HCP >= ' || o_orderkey % 20 AS e FROM orders), (SELECT unnest(range(1, 5))::INTEGER AS seat)")


def reached(spark, sf):
    return R.auctions(X.deals(spark, sf), holding(spark, sf), rules(spark), folder(spark, "auctions"))


REACH = """a AS (SELECT deal_id, Board, '' AS auction, 0 AS node, -1 AS bidder, 0 AS passes, (Board - 1) % 4 AS turn FROM deal_ids
  UNION ALL SELECT DISTINCT a.deal_id, a.Board, a.auction || CASE WHEN m THEN bid ELSE 'p' END || '-', CASE WHEN m THEN rule_id ELSE node END, CASE WHEN m THEN turn ELSE bidder END, CASE WHEN m THEN 0 ELSE passes + 1 END, (turn + 1) % 4
  FROM (SELECT a.*, h.rule_id, h.bid, h.rule_id IS NOT NULL AND (bidder < 0 OR (turn - bidder) % 2 = 0) AS m FROM a LEFT JOIN (SELECT deal_id, instr('NESW', seat) - 1 AS seat, h.rule_id, parent, bid FROM holds h JOIN book b ON b.rule_id = h.rule_id WHERE NOT (parent = 0 AND bid >= '4N')) h
    ON h.deal_id = a.deal_id AND h.seat = a.turn AND h.parent = a.node WHERE passes < CASE WHEN bidder < 0 THEN 4 ELSE 3 END) a),
z AS (SELECT DISTINCT deal_id, substr('NESW', (Board - 1) % 4 + 1, 1) AS Dealer, rtrim(auction, '-') AS auction FROM a WHERE passes = CASE WHEN bidder < 0 THEN 4 ELSE 3 END)
"""
reg("bid11_auctions", lambda s, d: reached(s, d).select("deal_id", "Dealer", F.array_join("auction", "-").alias("auction")), with_holds(REACH + "SELECT * FROM z", True))


def analysed(spark, sf):
    """A row for each beginning of each auction, with the candidates of the seat to bid next."""
    a = R.auctions(X.deals(spark, sf), holding(spark, sf), rules(spark), folder(spark, "auctions"), prefixes=True)
    a = R.with_analysis(a)
    a = a.withColumn("next", R.seat_of_turn(F.col("Dealer"), F.size("auction") + 1))
    c = R.candidates(packed(spark, sf), needs(spark), rules(spark).where("parent = 0")).select("deal_id", F.col("seat").alias("next"), F.array_join(F.transform("rules", lambda r: r.cast("string")), ",").alias("candidates"))
    text = F.when(F.col("x.over"), F.concat_ws(" ", "x.contract", F.lit("by"), F.coalesce("x.declarer", F.lit("nobody")))).otherwise(F.concat(F.lit("open, opened by "), F.coalesce("x.opener", F.lit("nobody"))))
    return a.join(c.hint("merge"), ["deal_id", "next"]).select("deal_id", F.array_join("auction", "-").alias("auction"), "x.opener", "x.declarer", "x.leader", "x.over", "candidates", text.alias("description"))


W = lambda i: f"substr('NESW', ({i})::INTEGER % 4 + 1, 1)"
# in these auctions only one side bids; the declarer is the first of it to name the last strain
reg("bid12_auction_rows", analysed, with_holds(REACH + f""", w AS (SELECT DISTINCT deal_id, (Board - 1) % 4 AS d0, passes = CASE WHEN bidder < 0 THEN 4 ELSE 3 END AS over, rtrim(auction, '-') AS auction, string_split(rtrim(auction, '-'), '-') AS l FROM a WHERE auction <> ''),
y AS (SELECT *, list_filter(l, lambda b: b <> 'p') AS bids FROM w),
v AS (SELECT *, bids[len(bids)] AS top, list_position(list_transform(l, lambda b: b <> 'p' AND substr(b, 2, 1) = substr(bids[len(bids)], 2, 1)), true) AS named, list_position(list_transform(l, lambda b: b <> 'p'), true) AS opened FROM y),
c AS (SELECT f.deal_id, f.seat, coalesce(string_agg(h.rule_id::VARCHAR, ',' ORDER BY h.rule_id) FILTER (h.rule_id IN (SELECT rule_id FROM book WHERE parent = 0)), '') AS candidates FROM f LEFT JOIN holds h ON h.deal_id = f.deal_id AND h.seat = f.seat GROUP BY ALL)
SELECT v.deal_id, auction, CASE WHEN len(bids) > 0 THEN {W('d0 + opened - 1')} END AS opener, CASE WHEN len(bids) > 0 THEN {W('d0 + named - 1')} END AS declarer, CASE WHEN len(bids) > 0 THEN {W('d0 + named')} END AS leader, over, candidates,
  CASE WHEN NOT over THEN 'open, opened by ' || CASE WHEN len(bids) > 0 THEN {W('d0 + opened - 1')} ELSE 'nobody' END WHEN len(bids) = 0 THEN 'PASS by nobody' ELSE top || {W('d0 + named - 1')} || ' by ' || {W('d0 + named - 1')} END AS description
FROM v JOIN c ON c.deal_id = v.deal_id AND c.seat = {W('d0 + len(l)')}""", True))


def auctions_of_results(spark, sf):
    """An auction for each bid contract: a lower bid or a pass first, doubles, passes; some illegal or unfinished."""
    b = C.split_contract(X.board_results(spark, sf)).where("BidLvl is not null")
    bid = F.concat(F.col("BidLvl").cast("string"), "BidSuit")
    end = F.when(F.col("Dbl") == "XX", F.lit("d-r-p-p-p")).when(F.col("Dbl") == "X", F.lit("d-p-p-p")).otherwise("p-p-p")
    text = F.when(F.col("o") % 50 == 0, F.concat(bid, F.lit("-p-p"))).when(F.col("o") % 50 == 1, F.concat(bid, F.lit("-"), bid, F.lit("-p-p-p"))).otherwise(F.concat(bid, F.lit("-"), end))
    return b.select("o", "p", "s", "Contract", "Declarer_Direction", text.alias("auction"), R.analyse(F.split(text, "-"), F.col("Declarer_Direction")).alias("x"))


reg("bid13_validate_auctions", lambda s, d: auctions_of_results(s, d).select("o", "p", "s", "auction", "x.legal", "x.over", "x.contract", "x.opener", "x.declarer", "x.leader"),
    f"""SELECT o, p, s, CASE WHEN o % 50 = 0 THEN b || '-p-p' WHEN o % 50 = 1 THEN b || '-' || b || '-p-p-p' WHEN k = 'XX' THEN b || '-d-r-p-p-p' WHEN k = 'X' THEN b || '-d-p-p-p' ELSE b || '-p-p-p' END AS auction, o % 50 <> 1 AS legal, o % 50 <> 0 AS over,
  CASE WHEN o % 50 = 0 THEN NULL WHEN o % 50 = 1 THEN b || {W("instr('NESW', d)")} ELSE Contract END AS contract, d AS opener, CASE WHEN o % 50 = 1 THEN {W("instr('NESW', d)")} ELSE d END AS declarer, CASE WHEN o % 50 = 1 THEN {W("instr('NESW', d) + 1")} ELSE {W("instr('NESW', d)")} END AS leader
  FROM (SELECT *, left(Contract, 2) AS b, right(Contract, 1) AS d, substr(Contract, 3, length(Contract) - 3) AS k FROM br WHERE Contract <> 'PASS')""", "br")
