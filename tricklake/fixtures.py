"""Tournament tables derived from the driver's tables, and the same as DuckDB common table expressions.

Integer arithmetic only, so both engines agree; every table grows with its source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import bridge as B


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@F.arrow_udf(T.StringType())
def _pbn(numbers: pa.Array) -> pa.Array:
    """The deal texts of numbers, 69 bytes each, a batch at a time; null for null."""
    n = numbers.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    places = np.fmod(np.arange(1, 53) * (1 + np.fmod(n * 7919 + 13, 10006))[:, None], 10007).astype(np.int16)
    cards = np.sort(np.argsort(places, axis=1, kind="stable").reshape(-1, 4, 13), axis=2)
    at = (2 + 17 * np.arange(4))[:, None] + np.arange(13) + cards // 13
    text = np.full((len(n), 69), ord("."), np.uint8)
    text[:, :2], text[:, [18, 35, 52]] = np.frombuffer(b"N:", np.uint8), ord(" ")
    np.put_along_axis(text, at.reshape(-1, 52), np.frombuffer(B.RANKS.encode(), np.uint8)[cards % 13].reshape(-1, 52), axis=1)
    texts = pa.StringArray.from_buffers(len(n), pa.py_buffer((np.arange(len(n) + 1) * 69).astype(np.int32)), pa.py_buffer(text))
    return pc.if_else(numbers.is_valid(), texts, None)


def with_pbn(df: DataFrame, deal_id: str = "deal_id") -> DataFrame:
    """Add PBN, the deal of a number: cards ordered by (i + 1) * k mod 10007, thirteen to each seat."""
    return df.withColumn("PBN", _pbn(F.col(deal_id).cast("long")))


def deal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(deal_id, Board), one an order, dealt by deal: what is made of a deal spreads over all tasks however few files there are, and groups of a deal need no further shuffle."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("deal_id"), (F.col("o_orderkey") % 36 + 1).cast("int").alias("Board")).repartition(parts, "deal_id")


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(deal_id, Board, PBN), one an order."""
    return with_pbn(deal_ids(spark, sf_dir))


def board_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line item; sessions of 64 orders, 24 boards, three sections."""
    o, p, s, n = (F.col(f"l_{c}") for c in ("orderkey", "partkey", "suppkey", "linenumber"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    b = li.select(
        F.floor(o / 64).alias("session_id"), (p % 3).alias("section_id"), (s % 24 + 1).cast("int").alias("Board"), o.alias("o"), p.alias("p"), s.alias("s"),
        (n % 7 + 1).alias("level"), B.nth("CDHSN", p % 5).alias("strain"), B.nth("NESW", o % 4).alias("seat"), ((o * 7 + p * 3 + n) % 14).cast("int").alias("tricks"),
        F.when(s % 37 == 0, "XX").when(s % 11 == 0, "X").otherwise("").alias("dbl"),
        (o % 12 + 1).cast("int").alias("Pair_Number_NS"), (p % 12 + 1).cast("int").alias("Pair_Number_EW"),
        F.concat(F.lit("P"), o % 211).alias("Player_ID_N"), F.concat(F.lit("P"), (p * 5 + 2) % 223).alias("Player_ID_E"),
        F.concat(F.lit("P"), (o * 3 + 1) % 211).alias("Player_ID_S"), F.concat(F.lit("P"), (p * 7 + 3) % 223).alias("Player_ID_W"),
    )
    kind = F.when((F.col("o") + F.col("s")) % 211 == 0, "null").when((F.col("o") + F.col("p")) % 53 == 0, "pass").otherwise("bid")
    b = b.withColumn("kind", kind).withColumn("deal_id", F.col("session_id") * 24 + F.col("Board")).withColumn("Date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("session_id").cast("int")))
    bid = F.col("kind") == "bid"
    contract = F.when(bid, F.concat(F.col("level").cast("string"), "strain", "dbl", "seat")).when(F.col("kind") == "pass", "PASS")
    score = B.contract_score(F.col("level"), F.col("strain"), F.col("dbl"), B.seat_is_vulnerable(B.vul_code(F.col("Board")), F.col("seat")), F.col("tricks") - 6 - F.col("level"))
    sign = F.when(F.col("seat").isin("N", "S"), 1).otherwise(-1)
    return b.select(
        "session_id", "section_id", "Board", "deal_id", "Date", contract.alias("Contract"), F.when(bid, F.col("tricks") - 6 - F.col("level")).cast("int").alias("Result"), F.when(bid, F.col("tricks")).alias("Tricks"),
        F.when(bid, score * sign).when(F.col("kind") == "pass", 0).cast("int").alias("Score_NS"), "Pair_Number_NS", "Pair_Number_EW",
        "Player_ID_N", "Player_ID_E", "Player_ID_S", "Player_ID_W", "o", "p", "s",
    )


def score_sql(level: str, strain: str, dbl: str, vul: str, result: str) -> str:
    """The score as a DuckDB expression."""
    f = f"(CASE {dbl} WHEN 'XX' THEN 4 WHEN 'X' THEN 2 ELSE 1 END)"
    per = f"(CASE WHEN {strain} IN ('C', 'D') THEN 20 ELSE 30 END)"
    base = f"(({per} * {level} + CASE WHEN {strain} = 'N' THEN 10 ELSE 0 END) * {f})"
    made = f"""{base} + CASE WHEN {base} >= 100 THEN CASE WHEN {vul} THEN 500 ELSE 300 END ELSE 50 END
      + CASE {level} WHEN 7 THEN CASE WHEN {vul} THEN 1500 ELSE 1000 END WHEN 6 THEN CASE WHEN {vul} THEN 750 ELSE 500 END ELSE 0 END
      + CASE {f} WHEN 4 THEN 100 WHEN 2 THEN 50 ELSE 0 END + {result} * CASE {f} WHEN 1 THEN {per} ELSE {f} * CASE WHEN {vul} THEN 100 ELSE 50 END END"""
    n = f"(-{result})"
    down = f"""CASE {f} WHEN 1 THEN {n} * CASE WHEN {vul} THEN 100 ELSE 50 END
      ELSE (CASE WHEN {vul} THEN 300 * {n} - 100 WHEN {n} <= 3 THEN 200 * {n} - 100 ELSE 300 * {n} - 400 END) * CASE {f} WHEN 4 THEN 2 ELSE 1 END END"""
    return f"(CASE WHEN ({result}) >= 0 THEN {made} ELSE -({down}) END)::INTEGER"


_VUL = "(((Board - 1) // 4 + (Board - 1) % 4) & 3)"


def vul_sql(code: str, seat: str) -> str:
    return f"(CASE WHEN {seat} IN ('N', 'S', 'NS') THEN ({code} & 1) > 0 ELSE ({code} & 2) > 0 END)"


#: name: (tables it needs before it, text)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "deal_ids": ((), "SELECT o_orderkey AS deal_id, (o_orderkey % 36 + 1)::INTEGER AS Board FROM orders"),
    "cards": (
        ("deal_ids",),
        """SELECT deal_id, Board, i, (row_number() OVER (PARTITION BY deal_id ORDER BY ((i + 1) * (1 + (deal_id * 7919 + 13) % 10006)) % 10007) - 1) // 13 AS seat, i // 13 AS suit,
  substr('AKQJT98765432', (i % 13 + 1)::INTEGER, 1) AS rank FROM deal_ids, range(52) r(i)""",
    ),
    "suits": (
        ("cards",),
        """SELECT d.deal_id, d.Board, a.seat, b.suit, coalesce(x.cards, '') AS cards FROM deal_ids d, range(4) a(seat), range(4) b(suit)
  LEFT JOIN (SELECT deal_id, seat, suit, string_agg(rank, '' ORDER BY i) AS cards FROM cards GROUP BY ALL) x ON x.deal_id = d.deal_id AND x.seat = a.seat AND x.suit = b.suit""",
    ),
    "deals": (
        ("suits",),
        """SELECT deal_id, Board, 'N:' || string_agg(hand, ' ' ORDER BY seat) AS PBN FROM (SELECT deal_id, Board, seat, string_agg(cards, '.' ORDER BY suit) AS hand FROM suits GROUP BY ALL) GROUP BY ALL""",
    ),
    "br0": (
        (),
        """SELECT (l_orderkey // 64)::BIGINT AS session_id, l_partkey % 3 AS section_id, (l_suppkey % 24 + 1)::INTEGER AS Board, l_orderkey AS o, l_partkey AS p, l_suppkey AS s,
  l_linenumber % 7 + 1 AS level, substr('CDHSN', (l_partkey % 5 + 1)::INTEGER, 1) AS strain, substr('NESW', (l_orderkey % 4 + 1)::INTEGER, 1) AS seat, ((l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 14)::INTEGER AS tricks,
  CASE WHEN l_suppkey % 37 = 0 THEN 'XX' WHEN l_suppkey % 11 = 0 THEN 'X' ELSE '' END AS dbl, (l_orderkey % 12 + 1)::INTEGER AS Pair_Number_NS, (l_partkey % 12 + 1)::INTEGER AS Pair_Number_EW,
  'P' || (l_orderkey % 211) AS Player_ID_N, 'P' || ((l_partkey * 5 + 2) % 223) AS Player_ID_E, 'P' || ((l_orderkey * 3 + 1) % 211) AS Player_ID_S, 'P' || ((l_partkey * 7 + 3) % 223) AS Player_ID_W,
  CASE WHEN (l_orderkey + l_suppkey) % 211 = 0 THEN 'null' WHEN (l_orderkey + l_partkey) % 53 = 0 THEN 'pass' ELSE 'bid' END AS kind FROM lineitem""",
    ),
    "br": (
        ("br0",),
        f"""SELECT session_id, section_id, Board, session_id * 24 + Board AS deal_id, (DATE '2020-01-01' + session_id::INTEGER)::DATE AS Date,
  CASE kind WHEN 'bid' THEN level || strain || dbl || seat WHEN 'pass' THEN 'PASS' END AS Contract, CASE WHEN kind = 'bid' THEN tricks - 6 - level END::INTEGER AS Result, CASE WHEN kind = 'bid' THEN tricks END AS Tricks,
  CASE kind WHEN 'bid' THEN {score_sql('level', 'strain', 'dbl', vul_sql(_VUL, 'seat'), '(tricks - 6 - level)')} * CASE WHEN seat IN ('N', 'S') THEN 1 ELSE -1 END WHEN 'pass' THEN 0 END::INTEGER AS Score_NS,
  Pair_Number_NS, Pair_Number_EW, Player_ID_N, Player_ID_E, Player_ID_S, Player_ID_W, o, p, s FROM br0""",
    ),
    # the double-dummy table by formula: partners take the same or one trick less
    "dd": (
        ("deal_ids",),
        """SELECT deal_id, Board, substr('NESW', seat::INTEGER + 1, 1) AS seat, substr('SHDCN', st::INTEGER + 1, 1) AS strain,
  greatest(0, (deal_id * 31 + (seat % 2) * 17 + st * 5) % 14 - CASE WHEN seat >= 2 THEN (deal_id + st) % 2 ELSE 0 END)::INTEGER AS tricks FROM deal_ids, range(4) a(seat), range(5) b(st)""",
    ),
    "scores": (
        (),
        f"""SELECT level::INTEGER AS level, strain, dbl, vul, (tricks)::INTEGER AS tricks, {score_sql('level', 'strain', 'dbl', 'vul', '(tricks - 6 - level)')} AS score
  FROM range(1, 8) a(level), (SELECT unnest(['C', 'D', 'H', 'S', 'N']) AS strain), (SELECT unnest(['', 'X', 'XX']) AS dbl), (SELECT unnest([false, true]) AS vul), range(14) e(tricks)""",
    ),
    # ten sampled layouts a deal
    "samples": (
        ("deal_ids",),
        """SELECT deal_id, Board, substr('NESW', seat::INTEGER + 1, 1) AS seat, substr('SHDCN', st::INTEGER + 1, 1) AS strain, ((deal_id * 13 + sample * sample * 7 + seat * 3 + st) % 14)::INTEGER AS tricks
  FROM deal_ids, range(4) a(seat), range(5) b(st), range(10) c(sample)""",
    ),
}


def oracle(main: str, *names: str) -> str:
    """A DuckDB query with the common table expressions it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in CTES[name][0]:
            add(x)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return ("WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" if order else "") + main


def trick_cells(ids: DataFrame) -> DataFrame:
    """ids(deal_id, Board) -> (deal_id, Board, cells): a made-up trick table, seats N, E, S, W by strains S, H, D, C, N."""
    def cell(x: int, st: int) -> Column:
        return F.greatest(F.lit(0), (F.col("deal_id") * 31 + x % 2 * 17 + st * 5) % 14 - ((F.col("deal_id") + st) % 2 if x >= 2 else F.lit(0))).cast("int")

    return ids.select("deal_id", "Board", F.array(*[cell(x, st) for x in range(4) for st in range(5)]).alias("cells"))


def dd_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(deal_id, Board, seat, strain, tricks) of all deals."""
    rows = trick_cells(deal_ids(spark, sf_dir)).select("deal_id", "Board", F.posexplode("cells").alias("g", "tricks"))
    return rows.select("deal_id", "Board", B.nth("NESW", F.floor(F.col("g") / 5)).alias("seat"), B.nth("SHDCN", F.col("g") % 5).alias("strain"), "tricks")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(deal_id, Board, seat, strain, tricks) of ten layouts of every deal."""
    g = deal_ids(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("g")).withColumns({"x": F.floor(F.col("g") / 50), "st": F.floor(F.col("g") / 10) % 5, "n": F.col("g") % 10})
    return g.select("deal_id", "Board", B.nth("NESW", F.col("x")).alias("seat"), B.nth("SHDCN", F.col("st")).alias("strain"), ((F.col("deal_id") * 13 + F.col("n") * F.col("n") * 7 + F.col("x") * 3 + F.col("st")) % 14).cast("int").alias("tricks"))
