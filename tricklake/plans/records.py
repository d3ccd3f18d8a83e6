"""Queries SRC5 to SRC8 and CAN12 over game records, and their DuckDB equivalents.

One board an order, ten orders a file. Deals, auctions and play follow from the order's number; every file of a few is spoilt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixtures as X
from ..functions import bridge as B
from ..operators import canonical as N
from ..sources import records as R

Q, O = {}, {}


@F.arrow_udf(T.StringType())
def _played(pbn: pa.Array, declarer: pa.Array, trump: pa.Array, n: pa.Array) -> pa.Array:
    """The first n cards as fields: each seat plays its hand from the top, the winner leads."""
    ints = lambda a: a.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int16)
    some = pbn.fill_null("N:" + " ".join(["AKQJT98765432..."] * 4))
    hands = np.frombuffer("".join(some.to_pylist()).encode(), np.uint8).reshape(-1, 69)[:, (2 + 17 * np.arange(4))[:, None] + np.arange(16)]
    dots = hands == ord(".")
    codes = (np.cumsum(dots, axis=2) * 13 + _RANK[hands])[~dots].reshape(-1, 4, 13).astype(np.int16)
    leader, trump, i = (ints(declarer) + 1) % 4, ints(trump), np.arange(len(pbn))
    cards = np.empty((len(pbn), 13, 4), np.int16)
    for t in range(13):
        cards[:, t] = codes[i[:, None], (leader[:, None] + np.arange(4)) % 4, t]
        leader = (leader + R.winners(cards[:, t], trump)) % 4
    cards = cards.reshape(-1, 52)
    text = np.empty((len(pbn), 52, 6), np.uint8)
    text[:], text[:, :, 3], text[:, :, 4] = np.frombuffer(b"pc|..|", np.uint8), _SUITS[cards // 13], _RANKS[cards % 13]
    kept = np.minimum(ints(n), 52)
    texts = pa.StringArray.from_buffers(len(pbn), pa.py_buffer(np.concatenate(([0], np.cumsum(6 * kept.astype(np.int64)))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text[np.arange(52) < kept[:, None]])))
    return pc.if_else(pbn.is_valid(), texts, None)


_SUITS, _RANKS = (np.frombuffer(x.encode(), np.uint8) for x in (B.SUITS, B.RANKS))
_RANK = np.zeros(256, np.int16)
_RANK[_RANKS] = np.arange(13)


def record_texts(spark, sf) -> DataFrame:
    """(source_file, value): whole files of up to ten boards."""
    k = F.col("k")
    # dealt by file, so that a file's texts leave their task as one row
    ids = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 36 + 1).cast("int").alias("Board"), F.floor(F.col("o_orderkey") / 10).alias("file"))
    df = X.with_pbn(ids.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file"), "k")
    df = df.withColumns({"dealer_no": (k % 4).cast("int"), "strain": B.nth("CDHSN", k % 5), "lvl": (k % 6 + 2).cast("string"), "four": F.split(F.substring("PBN", 3, 67), " ")})
    df = df.withColumn("declarer_no", F.pmod(F.col("dealer_no") + F.when(F.col("strain") == "C", 0).otherwise(2), F.lit(4)).cast("int"))
    n = F.when(k % 4 == 0, 52).when(k % 4 == 1, 48 + k % 3).when(k % 4 == 2, 4 * (k % 11)).otherwise(4 * (k % 12)).cast("int")
    df = df.withColumn("cards", _played(F.col("PBN"), F.col("declarer_no"), F.instr(F.lit(B.TRICK_STRAINS), F.col("strain")) - 1, n))
    part = lambda key, v: F.concat(F.lit(f"{key}|"), v, F.lit("|"))
    hand = lambda i: F.regexp_replace(F.get("four", F.lit(i)), r"^(\w*)\.(\w*)\.(\w*)\.(\w*)$", "S$1H$2D$3C$4")
    hands = F.concat_ws(",", hand(2), hand(3), hand(0), F.when(k % 2 == 0, "").otherwise(hand(1)))
    md = F.concat(F.when(k % 17 == 0, "").otherwise((F.pmod(F.col("dealer_no") + 2, F.lit(4)) + 1).cast("string")), F.when(k % 13 == 0, "").otherwise(hands))
    doubled = F.when(k % 12 == 1, "mb|d|mb|r|").when(k % 3 == 1, "mb|d|").otherwise("")
    bid = F.concat(F.lit("mb|1C!|an|strong|mb|p|mb|"), "lvl", "strain", F.lit("|"), doubled, F.lit("mb|p|mb|p|mb|p|"))
    calls = F.when(k % 9 == 0, "mb|p|mb|p|mb|p|mb|p|").when(k % 10 == 3, "mb|1N|mb|p|").otherwise(bid)
    played = F.when((k % 9 == 0) | (k % 10 == 3) | (k % 13 == 0) | (k % 17 == 0), "").otherwise(F.col("cards"))
    text = F.concat(
        F.when(k % 7 == 0, "qx|o|").otherwise(part("qx", F.concat(F.lit("o"), (k % 30 + 1).cast("string")))), part("md", md), F.when(k % 5 == 4, "").otherwise(part("sv", B.nth("obne", k % 5))),
        F.when(k % 7 == 0, "").otherwise(part("ah", F.concat(F.lit("Board "), F.col("Board").cast("string")))), calls, played, F.when(k % 4 == 2, part("mc", ((k * 7) % 15).cast("string"))).otherwise(""), F.lit("pg||\n"),
    )
    files = df.select("file", "k", text.alias("text")).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("k", "text"))).alias("b"))
    head = F.concat(F.lit("vg|Event "), (F.col("file") % 5).cast("string"), F.lit(",x|pn|S"), F.col("file").cast("string"), F.lit(",W,N,E|"))
    value = F.when(F.col("file") % 19 == 3, F.lit(None)).when(F.col("file") % 19 == 5, "<html>moved</html>").otherwise(F.concat(head, F.array_join("b.text", "")))
    return files.select(F.concat(F.lit("f"), F.col("file").cast("string")).alias("source_file"), value.alias("value"))


_NAMES = "['spades', 'hearts', 'diamonds', 'clubs', 'nt']"
# rec: what a reader must find, from the rule that made the record; the play by recursion over the tricks
REC = f"""
base AS (SELECT o_orderkey AS k, (o_orderkey // 10)::BIGINT AS file, (o_orderkey % 4)::INTEGER AS dealer_no, substr('CDHSN', (o_orderkey % 5 + 1)::INTEGER, 1) AS strain, (o_orderkey % 6 + 2)::INTEGER AS lvl,
  (o_orderkey % 4 + CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 2 END)::INTEGER % 4 AS decl, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE (o_orderkey % 5)::INTEGER END AS vul,
  o_orderkey % 13 = 0 AS no_deal, o_orderkey % 17 = 0 AS no_dealer, o_orderkey % 9 = 0 AS passed, o_orderkey % 9 > 0 AND o_orderkey % 10 = 3 AS open,
  CASE WHEN o_orderkey % 12 = 1 THEN 'redoubled' WHEN o_orderkey % 3 = 1 THEN 'doubled' ELSE 'passed' END AS pen FROM orders WHERE (o_orderkey // 10) % 19 NOT IN (3, 5)),
held AS (SELECT deal_id AS k, seat, row_number() OVER (PARTITION BY deal_id, seat ORDER BY i) - 1 AS t, suit, i FROM cards),
four AS (SELECT k, t, list(i ORDER BY seat) AS c FROM held GROUP BY ALL),
play AS (SELECT k, 0 AS t, (decl + 1) % 4 AS leader, 0 AS won, decl, strain FROM base WHERE NOT (passed OR open OR no_deal OR no_dealer) UNION ALL
  SELECT k, t + 1, w, won + CASE WHEN (w - decl) % 2 = 0 THEN 1 ELSE 0 END, decl, strain FROM (SELECT p.*, list_position(s, list_max(s))::INTEGER - 1 AS w FROM (
    SELECT p.*, list_transform(f.c, lambda x: CASE WHEN x // 13 = instr('SHDCN', p.strain) - 1 THEN 200 WHEN x // 13 = f.c[p.leader + 1] // 13 THEN 100 ELSE 0 END + 12 - x % 13) AS s FROM play p JOIN four f ON f.k = p.k AND f.t = p.t WHERE p.t < 13) p)),
taken AS (SELECT k, won FROM play WHERE t = 13),
texts AS (SELECT deal_id AS k, seat, string_agg(cards, '.' ORDER BY suit) AS hand FROM (SELECT deal_id, seat, suit, string_agg(rank, '' ORDER BY i) AS cards FROM (SELECT deal_id, seat, suit, i, rank FROM cards UNION ALL SELECT o_orderkey, a, b, NULL, NULL FROM orders, range(4) x(a), range(4) y(b)) GROUP BY ALL) z(deal_id, seat, suit, cards0), LATERAL (SELECT coalesce(cards0, '') AS cards) GROUP BY ALL),
pbn AS (SELECT k, 'N:' || string_agg(hand, ' ' ORDER BY seat) AS PBN FROM texts GROUP BY k),
rec0 AS (SELECT b.*, row_number() OVER (PARTITION BY file ORDER BY b.k)::INTEGER - 1 AS board, NOT (passed OR open) AS bid,
  CASE WHEN b.k % 4 = 2 THEN CASE WHEN b.k * 7 % 15 < 14 THEN (b.k * 7 % 15)::INTEGER END WHEN b.k % 4 < 2 THEN t.won::INTEGER END AS tricks, p.PBN AS whole FROM base b LEFT JOIN taken t USING (k) LEFT JOIN pbn p USING (k)),
rec AS (SELECT *, 'f' || file AS source_file, CASE WHEN k % 7 > 0 THEN (k % 36 + 1)::INTEGER END AS board_num, CASE WHEN NOT no_dealer THEN substr('NESW', dealer_no + 1, 1) END AS dealer, vul AS vulnerability,
  CASE WHEN NOT open THEN passed END AS passout, CASE WHEN bid THEN lvl END AS level, CASE WHEN bid THEN {_NAMES}[instr('SHDCN', strain)] END AS denom, CASE WHEN passed THEN 'nt' WHEN bid THEN {_NAMES}[instr('SHDCN', strain)] END AS trump,
  CASE WHEN bid THEN pen END AS penalty, CASE WHEN bid AND NOT no_dealer THEN ['north', 'east', 'south', 'west'][decl + 1] END AS declarer, CASE WHEN bid THEN tricks - 6 - lvl END AS result, k % 4 = 2 AS claimed,
  CASE WHEN passed THEN 'PASS' WHEN bid AND NOT no_dealer THEN lvl || strain || CASE pen WHEN 'redoubled' THEN 'XX' WHEN 'doubled' THEN 'X' ELSE '' END || substr('NESW', decl + 1, 1) END AS contract,
  CASE WHEN no_deal THEN 'N:... ... ... ...' ELSE whole END AS PBN FROM rec0)
"""
SCORE = X.score_sql("level", "strain", "(CASE pen WHEN 'redoubled' THEN 'XX' WHEN 'doubled' THEN 'X' ELSE '' END)", "(vul = 1 OR vul = 2 + decl % 2)", "result")
OK = "NOT no_deal AND vulnerability IS NOT NULL AND dealer IS NOT NULL"
#: Columns of a board row but for the lists, which the queries give as text.
PLAIN = ["source_file", "board", "board_num", "dealer", "vulnerability", "passout", "contract", "level", "denom", "trump", "penalty", "declarer", "result", "score", "claimed", "PBN", "Hand_N", "Hand_E", "Hand_S", "Hand_W"]
LISTS = ["bid_type", "bid_denom", "bid_penalty", "bid_level", "bid_alertable", "bid_announcement"]


def reg(name, run, sql):
    Q[name] = run
    cards = X.CTES["cards"][1]
    O[name] = f"WITH RECURSIVE deal_ids AS ({X.CTES['deal_ids'][1]}), cards AS ({cards}), {REC}\n{sql}"


def joined(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "-").alias(c)


def boards(spark, sf):
    rows = R.parse_records(record_texts(spark, sf)).where("not error")
    return rows.select(*PLAIN, *map(joined, [*LISTS, "issues"]), F.size("play_suit").alias("cards"), F.get("play_suit", F.lit(3)).alias("fourth_suit"), F.get("play_rank", F.lit(3)).alias("fourth_rank"), F.col("info.North").alias("North"), F.col("info.South").alias("South"), F.col("info.Event").alias("Event"))


_TIMES = "CASE pen WHEN 'redoubled' THEN 2 WHEN 'doubled' THEN 1 ELSE 0 END"
_CALLS = lambda opened, raised, doubled, redoubled, passes, alone, short: f"""CASE WHEN passed THEN '{alone}' WHEN open THEN '{short}' ELSE concat_ws(',', {opened}, {raised}, CASE WHEN {_TIMES} > 0 THEN '{doubled}' END, CASE WHEN {_TIMES} > 1 THEN '{redoubled}' END, '{passes}') END"""
_PLAYED = "CASE WHEN passed OR open OR no_deal OR no_dealer THEN 0 WHEN k % 4 = 0 THEN 52 WHEN k % 4 = 1 THEN 48 + k % 3 WHEN k % 4 = 2 THEN 4 * (k % 11) ELSE 4 * (k % 12) END::INTEGER"
reg("src6_game_records", boards, f"""
SELECT source_file, board, board_num, dealer, vulnerability, passout, contract, level, denom, trump, penalty, declarer, result, CASE WHEN declarer IS NOT NULL AND vul IS NOT NULL AND result IS NOT NULL THEN {SCORE} END AS score, claimed, PBN,
  {', '.join(f"CASE WHEN no_deal THEN '...' ELSE split_part(substr(PBN, 3), ' ', {i + 1}) END AS Hand_{s}" for i, s in enumerate(B.SEATS))},
  {_CALLS("'Contract,Penalty'", "'Contract'", 'Penalty', 'Penalty', 'Penalty,Penalty,Penalty', 'Penalty,Penalty,Penalty,Penalty', 'Contract,Penalty')} AS bid_type,
  {_CALLS("'clubs,-'", f"{_NAMES}[instr('SHDCN', strain)]", '-', '-', '-,-,-', '-,-,-,-', 'nt,-')} AS bid_denom,
  {_CALLS("'-,passed'", "'-'", 'doubled', 'redoubled', 'passed,passed,passed', 'passed,passed,passed,passed', '-,passed')} AS bid_penalty,
  {_CALLS("'1,-'", "lvl::VARCHAR", '-', '-', '-,-,-', '-,-,-,-', '1,-')} AS bid_level,
  {_CALLS("'true,false'", "'false'", 'false', 'false', 'false,false,false', 'false,false,false,false', 'false,false')} AS bid_alertable,
  {_CALLS("'strong,-'", "'-'", '-', '-', '-,-,-', '-,-,-,-', '-,-')} AS bid_announcement,
  concat_ws(',', CASE WHEN board_num IS NULL THEN 'no board' END, CASE WHEN no_dealer THEN 'no dealer' END, CASE WHEN vul IS NULL THEN 'no vulnerability' END, CASE WHEN no_deal THEN 'no deal' END,
    CASE WHEN open THEN 'auction not over' END, CASE WHEN claimed AND k * 7 % 15 > 13 THEN 'claim out of range' END, CASE WHEN bid AND NOT claimed AND (no_deal OR no_dealer OR k % 4 = 3) THEN 'play not over' END) AS issues,
  {_PLAYED} AS cards, CASE WHEN {_PLAYED} >= 4 THEN {_NAMES}[c // 13 + 1] END AS fourth_suit, CASE WHEN {_PLAYED} >= 4 THEN 'R' || substr('AKQJT98765432', (c % 13 + 1)::INTEGER, 1) END AS fourth_rank,
  'N' AS North, 'S' || file AS South, 'Event ' || file % 5 AS Event FROM rec LEFT JOIN (SELECT f.k AS fk, f.c[decl + 1] AS c FROM four f JOIN base b USING (k) WHERE f.t = 0) x ON fk = k""")
reg("src7_valid_records", lambda s, d: R.valid_records(R.parse_records(record_texts(s, d))).select("source_file", "board", "PBN", "dealer", "vulnerability"), f"SELECT source_file, board, PBN, dealer, vulnerability FROM rec WHERE {OK}")


def qual(spark, sf):
    reasons, issues = R.quality(R.parse_records(record_texts(spark, sf)))
    return reasons.select(F.col("reason").alias("what"), "n").unionByName(issues.select(F.col("issue").alias("what"), "n"))


reg("src8_quality_counters", qual, f"""
SELECT CASE WHEN no_deal THEN 'invalid_pbn' WHEN vulnerability IS NULL THEN 'null_vulnerability' WHEN dealer IS NULL THEN 'null_dealer' ELSE 'valid' END AS what, count(*) AS n FROM rec GROUP BY 1
UNION ALL SELECT 'error', count(DISTINCT o_orderkey // 10) FROM orders WHERE (o_orderkey // 10) % 19 IN (3, 5)
UNION ALL SELECT * FROM (SELECT unnest(['no vulnerability', 'no board', 'play not over', 'no deal', 'no dealer', 'auction not over', 'claim out of range']) AS what,
  unnest([count(*) FILTER (vul IS NULL), count(*) FILTER (board_num IS NULL), count(*) FILTER (bid AND NOT claimed AND (no_deal OR no_dealer OR k % 4 = 3)), count(*) FILTER (no_deal), count(*) FILTER (no_dealer), count(*) FILTER (open), count(*) FILTER (claimed AND k * 7 % 15 > 13)]) AS n FROM rec ORDER BY n DESC, what LIMIT 3)""")


def fresh(spark, sf):
    done = X.table(spark, sf, "orders").where("o_orderkey % 40 = 0").select(F.concat(F.lit("f"), F.floor(F.col("o_orderkey") / 10).cast("string")).alias("source_file"))
    return R.valid_records(R.new_records(record_texts(spark, sf), done)).select("source_file", "board", "board_num", "contract", "result")


reg("src5_incremental_ingest", fresh, f"SELECT source_file, board, board_num, contract, result FROM rec WHERE {OK} AND source_file NOT IN (SELECT 'f' || o_orderkey // 10 FROM orders WHERE o_orderkey % 40 = 0)")
reg("can12_game_records", lambda s, d: N.from_game_records(R.valid_records(R.parse_records(record_texts(s, d)))), f"""
SELECT board_num AS Board, ['None', 'Both', 'N_S', 'E_W'][vul + 1] AS Vul, contract AS Contract, CASE WHEN passed THEN 0 WHEN result IS NOT NULL THEN {SCORE} * CASE WHEN decl % 2 = 0 THEN 1 ELSE -1 END END AS Score_NS, result AS Result, tricks_ AS Tricks, PBN,
  1 AS Pair_Number_NS, 2 AS Pair_Number_EW, 'N' AS Player_ID_N, 'E' AS Player_ID_E, 'S' AS Player_ID_S, 'W' AS Player_ID_W, 'N' AS Player_Name_N, 'E' AS Player_Name_E, 'S' || file AS Player_Name_S, 'W' AS Player_Name_W
FROM (SELECT *, CASE WHEN bid THEN tricks END AS tricks_ FROM rec) WHERE {OK}""")
