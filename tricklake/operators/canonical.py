"""From providers' rows to canonical board results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bridge as B
from . import matchpoints as M

# fixed values of the providers' texts
FRENCH_STRAINS = {"SA": "N", "P": "S", "C": "H", "K": "D", "T": "C"}
FRENCH_SEATS = {"N": "N", "E": "E", "S": "S", "O": "W"}
FRENCH_MONTHS = {"janvier": "01", "février": "02", "mars": "03", "avril": "04", "mai": "05", "juin": "06", "juillet": "07", "août": "08", "septembre": "09", "octobre": "10", "novembre": "11", "décembre": "12"}
RECORD_VULS = {0: "None", 1: "Both", 2: "N_S", 3: "E_W"}


def french_strain(text: Column) -> Column:
    """Strain of a text like 3SA or 4P."""
    # a map, as a chain of cases would look for the pattern in each
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in FRENCH_STRAINS.items() for x in pair]), F.regexp_extract(F.upper(text), "^[1-7](SA|[PCKT])", 1))


def french_contract(text: Column, declarer: Column) -> Column:
    """4Px by O -> 4SXW; passe -> PASS; anything else null."""
    t = F.trim(F.upper(text))
    level, doubled = F.regexp_extract(t, "^([1-7])", 1), F.regexp_extract(t, "(X*)$", 1)
    return F.when(t.startswith("PASS"), "PASS").when(french_strain(text).isNotNull(), F.concat(level, french_strain(text), doubled, B.lookup(FRENCH_SEATS, declarer)))


def result_number(text: Column) -> Column:
    """=, 0 or + alone -> 0; +n, n, -n; anything else (- too) null."""
    t = F.trim(text)
    return F.when(t.isin("=", "0", "+"), 0).otherwise(F.when(t.rlike(r"^[+-]?\d+$"), F.regexp_replace(t, r"^\+", "").try_cast("int")))


def signed_score(ns: Column, ew: Column, ns_note: Column, ew_note: Column) -> Column:
    """First numeric text of the two, PASS counting as 0; for NS if its note isn't lower, else negative."""
    number = lambda t: F.when(F.upper(F.trim(t)) == "PASS", 0).otherwise(F.trim(t).try_cast("int"))
    size = F.coalesce(number(ns), number(ew))
    return F.when(ns_note >= ew_note, size).otherwise(-size)


def deal_of_suits(cards: list[Column]) -> Column:
    """Sixteen French suit texts (seats N, E, S, W; suits S, H, D, C) -> deal text."""
    hands = [F.concat_ws(".", *[F.translate(F.coalesce(c, F.lit("")), "RDV0", "KQJT") for c in cards[4 * i : 4 * i + 4]]) for i in range(4)]
    return F.concat(F.lit("N:"), F.concat_ws(" ", *hands))


def deal_from_north(pbn: Column) -> Column:
    """A deal text that starts with any seat, rotated to start with North."""
    first = F.instr(F.lit(B.SEATS), F.substring(pbn, 1, 1)) - 1
    h = F.split(F.substring(pbn, 3, 1000), " ", -1)
    return F.when(first >= 0, F.concat(F.lit("N:"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.element_at(h, (F.pmod(i - first, F.lit(4)) + 1).cast("int"))), " ")))


def club_code(code: Column) -> Column:
    """Trimmed, without leading zeros; null gives the empty text, zeros alone 0."""
    t = F.trim(F.coalesce(code, F.lit("")))
    short = F.regexp_replace(t, "^0+", "")
    return F.when((short == "") & (t != ""), "0").otherwise(short)


def first_last(name: Column) -> Column:
    """Last, First or Last First -> First Last: the first token goes to the end."""
    parts = F.split(F.trim(F.regexp_replace(name, ",", " ")), r"\s+")
    return F.concat_ws(" ", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), parts[0])


def standard_contract(text: Column) -> Column:
    """Upper case, suit symbols to letters, NT to N."""
    return F.replace(F.translate(F.upper(text), "♠♥♦♣", "SHDC"), F.lit("NT"), F.lit("N"))


def french_date(text: Column) -> Column:
    """3 mars 2024 -> date; unknown months and texts give null."""
    t = F.lower(F.trim(text))
    day, month, year = (F.regexp_extract(t, r"(\d{1,2})\s+(\p{L}+)\s+(\d{4})", i) for i in (1, 2, 3))
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", year, B.lookup(FRENCH_MONTHS, month), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")))


def with_seats(df: DataFrame, players: DataFrame, keys: list[str]) -> DataFrame:
    """Seat ids from players(keys, side, position, pair, id): one pivot to the four seats and one join a side.

    Position 1 is North or East, 2 South or West; a pair without players gets nulls.
    """
    two = players.groupBy(*keys, "side", "pair").agg(F.max(F.when(F.col("position") == 1, F.col("id"))).alias("p1"), F.max(F.when(F.col("position") == 2, F.col("id"))).alias("p2"))
    for side in ("NS", "EW"):
        mine = two.where(F.col("side") == side).select(*keys, F.col("pair").alias(f"Pair_Number_{side}"), F.col("p1").alias(f"Player_ID_{side[0]}"), F.col("p2").alias(f"Player_ID_{side[1]}"))
        df = df.join(mine, [*keys, f"Pair_Number_{side}"], "left")
    return df


def from_simultaneous(rows: DataFrame, deals: DataFrame, players: DataFrame) -> DataFrame:
    """First provider: repeated rows go, deals join by (section, board), codes are mapped, scores ranked over all sections of a board.

    A section is a room: its deals and the players of its pairs are maps, so rows are shuffled once, by section. What a board's scores are worth, a row a board and score, is broadcast.
    """
    entries = lambda key, value: F.map_from_entries(F.collect_list(F.when(key, value)))
    # told as conditions of their own, so that both readings of the rows have the same ones and share a shuffle
    known = F.col("section").isNotNull() & F.col("board").isNotNull()
    at = deals.where(known).repartition("section").groupBy("section", "board").agg(F.collect_list(F.struct(*[c for c in deals.columns if c not in ("section", "board")])).alias("d"))
    at = at.groupBy("section").agg(F.map_from_entries(F.collect_list(F.struct("board", "d"))).alias("_deals"))
    two = F.struct(F.max(F.when(F.col("position") == 1, F.col("id"))).alias("p1"), F.max(F.when(F.col("position") == 2, F.col("id"))).alias("p2"))
    seats = players.dropna(subset=["section", "pair"]).repartition("section").groupBy("section", "side", "pair").agg(two.alias("two"))
    seats = seats.groupBy("section").agg(*[entries(F.col("side") == side, F.struct("pair", "two")).alias(f"_{side}") for side in ("NS", "EW")])
    rows = rows.where(known).repartition("section").distinct()
    score = F.col("score").try_cast("int").alias("Score_NS")
    worth = F.broadcast(M.score_points(rows.join(at, "section").select("board", score, F.inline(F.try_element_at("_deals", F.col("board")))), ["board"], "Score_NS"))
    df = rows.join(at.join(seats, "section", "left"), "section").select("*", score, F.inline(F.try_element_at("_deals", F.col("board")))).drop("_deals")
    df = df.withColumns({"Contract": french_contract(F.col("contrat"), F.col("declarant")), "Result": result_number(F.col("resultat"))})
    for side in ("NS", "EW"):
        who = F.try_element_at(f"_{side}", F.col(f"Pair_Number_{side}").cast(players.schema["pair"].dataType))
        df = df.withColumns({f"Player_ID_{side[0]}": who["p1"], f"Player_ID_{side[1]}": who["p2"]})
    df = df.drop("_NS", "_EW").join(worth, ["board", "Score_NS"], "left")
    return M.percentages(df).drop("contrat", "declarant", "resultat", "score")


def from_second(rows: DataFrame) -> DataFrame:
    """Second provider: signed score from texts and notes, pairs by orientation of the home team, top from the frequency list, MP from the percentage."""
    home_ns = F.col("home_orientation") == "NS"
    top = F.aggregate("frequencies", F.lit(0).cast("long"), lambda a, x: a + x["count"]) - 1
    df = rows.withColumns({
        "Score_NS": signed_score(F.col("ns_score"), F.col("ew_score"), F.col("ns_note"), F.col("ew_note")), "MP_Top": top,
        "Pair_Number_NS": F.when(home_ns, F.col("home")).otherwise(F.col("away")), "Pair_Number_EW": F.when(home_ns, F.col("away")).otherwise(F.col("home")), "Pct_NS": F.col("ns_note") / 100,
    })
    return df.withColumns({"MP_NS": F.round(F.col("Pct_NS") * F.col("MP_Top"), 2), "MP_EW": F.round((1 - F.col("Pct_NS")) * F.col("MP_Top"), 2)})


def expand_scores(rows: DataFrame) -> DataFrame:
    """frequencies(ns_score, ew_score, count) -> All_Scores: each signed score count times; adjusted scores (with %) as null."""
    one = lambda x: F.when(F.contains(F.coalesce(x["ns_score"], x["ew_score"]), F.lit("%")), F.lit(None).cast("int")).otherwise(F.coalesce(x["ns_score"].try_cast("int"), -x["ew_score"].try_cast("int")))
    return rows.withColumn("All_Scores", F.flatten(F.transform("frequencies", lambda x: F.array_repeat(one(x), x["count"].cast("int")))))


def star_join(facts: DataFrame, dims: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Left joins of facts with dimensions; a dimension whose key repeats is an error, so no join adds rows. AQE broadcasts what is small."""
    for dim, keys in dims:
        if dim.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"the key {keys} repeats")
        facts = facts.join(dim, keys, "left")
    return facts


def first_and_last_player(players: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each pair the player of the smallest and of the largest order value."""
    return players.groupBy(*keys).agg(F.min_by("id", order).alias("first_id"), F.max_by("id", order).alias("last_id"))


def two_sided(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, side, pair, opponent, score) of both sides -> one row a table: NS rows joined with the EW rows that name them."""
    ns = rows.where("side = 'NS'").select(*keys, F.col("pair").alias("Pair_Number_NS"), F.col("opponent").alias("Pair_Number_EW"), F.col("score").alias("Score_NS"))
    ew = rows.where("side = 'EW'").select(*keys, F.col("opponent").alias("Pair_Number_NS"), F.col("pair").alias("Pair_Number_EW"), F.col("score").alias("Score_EW"))
    return ns.join(ew, [*keys, "Pair_Number_NS", "Pair_Number_EW"])


def clean_results(rows: DataFrame) -> DataFrame:
    """board, contract, declarer, result, score, percentage texts -> canonical: boards above 0, percentages capped at 1, result and score numbers, tricks."""
    df = rows.where(F.col("board") > 0)
    bid = F.upper(F.regexp_replace(F.col("contract"), r"\s+", ""))
    contract = F.when(bid == "PASS", "PASS").when(bid.rlike("^[1-7](NT?|[SHDC])X{0,2}$"), F.concat(F.replace(bid, F.lit("NT"), F.lit("N")), F.upper("declarer")))
    df = df.withColumns({"Contract": contract, "Result": result_number(F.col("result")), "Score_NS": F.when(F.upper("score") == "PASS", 0).otherwise(F.col("score").try_cast("int")), "Pct_NS": F.least(F.lit(1.0), F.col("percentage") / 100)})
    return df.withColumn("Tricks", F.substring("Contract", 1, 1).try_cast("int") + 6 + F.col("Result"))


def from_game_records(rows: DataFrame) -> DataFrame:
    """Third provider (rows of parse_records): its own vulnerability code and names, placeholder pairs and player ids, source columns dropped.

    A board passed out scores 0; one without an auction that is over has no contract, one whose play or claim is missing no score.
    """
    side = {"Pair_Number_NS": F.lit(1), "Pair_Number_EW": F.lit(2)} | {f"Player_ID_{d}": F.lit(d) for d in B.SEATS} | {f"Player_Name_{d}": F.col(f"Player_{d}") for d in B.SEATS}
    sign = F.when(F.col("declarer").isin("north", "south"), 1).otherwise(-1)
    out = rows.withColumns({
        "Board": F.col("board_num"), "Vul": B.lookup(RECORD_VULS, F.col("vulnerability")), "Contract": F.col("contract"), "Score_NS": F.when(F.col("passout"), 0).otherwise(F.col("score") * sign),
        "Result": F.col("result"), "Tricks": F.col("result") + F.col("level") + 6,
    } | side)
    return out.select("Board", "Vul", "Contract", "Score_NS", "Result", "Tricks", "PBN", *side)


def with_standings(boards: DataFrame, standings: DataFrame) -> DataFrame:
    """standings(pair, players 'A & B', pct) joined for both sides, players split."""
    for side in ("NS", "EW"):
        names = F.split("players", r"\s*&\s*")
        mine = standings.select(F.col("pair").alias(f"Pair_Number_{side}"), names[0].alias(f"Player_Name_{side[0]}"), F.try_element_at(names, F.lit(2)).alias(f"Player_Name_{side[1]}"), F.col("pct").alias(f"Event_Pct_{side}"))
        boards = boards.join(mine, f"Pair_Number_{side}", "left")
    return boards


def attach_viewed_pair(boards: DataFrame, players: DataFrame, viewed_side: str) -> DataFrame:
    """boards(club, pair, opponent) seen from one side -> seat ids: the viewed pair sits on its side, opponents on the other."""
    two = players.groupBy("club", "pair").agg(F.max(F.when(F.col("position") == 1, F.col("id"))).alias("p1"), F.max(F.when(F.col("position") == 2, F.col("id"))).alias("p2"))
    other = "EW" if viewed_side == "NS" else "NS"
    for key, side in (("pair", viewed_side), ("opponent", other)):
        mine = two.select("club", F.col("pair").alias(key), F.col("p1").alias(f"Player_ID_{side[0]}"), F.col("p2").alias(f"Player_ID_{side[1]}"))
        boards = boards.join(mine, ["club", key], "left")
    return boards


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def pool_boards(frames: list[DataFrame]) -> DataFrame:
    """Union of boards' frames by name; a column missing in one is null there, of two types the wider one wins."""
    out = frames[0]
    rank = {"tinyint": 0, "smallint": 1, "int": 2, "bigint": 3, "float": 4, "double": 5, "string": 6}
    for f in frames[1:]:
        have, new = dict(out.dtypes), dict(f.dtypes)
        for c in have.keys() & new.keys():
            if have[c] != new[c]:
                wide = max(have[c], new[c], key=lambda t: rank.get(t, 6))
                out, f = out.withColumn(c, F.col(c).cast(wide)), f.withColumn(c, F.col(c).cast(wide))
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def team_boards(boards: DataFrame, team: int) -> tuple[DataFrame, DataFrame]:
    """A team's boards and, where it has none, the teams that there are."""
    mine = boards.where((F.col("Pair_Number_NS") == team) | (F.col("Pair_Number_EW") == team))
    teams = boards.select(F.explode(F.array("Pair_Number_NS", "Pair_Number_EW")).alias("team")).distinct()
    return mine, teams.where(F.lit(mine.limit(1).count() == 0))


def events_on(df: DataFrame, text: str, day: str) -> DataFrame:
    """Rows whose French date text is the day; texts that are no dates are dropped."""
    return df.withColumn("Event_Date", french_date(F.col(text))).where(F.col("Event_Date") == F.lit(day).cast("date"))


def player_sessions(items: DataFrame) -> DataFrame:
    """items(player, results array<struct<id, has_result, day, session, place>>) -> the sessions with results, first of each id, with a label that skips nulls."""
    rows = items.select("player", F.posexplode("results").alias("pos", "r")).where("r.has_result")
    rows = rows.select("player", "pos", "r.id", F.concat_ws(" ", "r.day", "r.session", "r.place").alias("label"))
    return keep_first(rows, ["player", "id"], ["pos"]).drop("pos")


def session_links(history: DataFrame, base: str) -> DataFrame:
    """history(data array<struct<id, name>>) -> id, url, summary url, description."""
    rows = history.select(F.explode("data").alias("r"))
    path = F.regexp_replace("r.id", "-", "/")
    return rows.select("r.id", F.concat(F.lit(f"{base}/"), path).alias("url"), F.concat(F.lit(f"{base}/"), path, F.lit("/summary")).alias("summary_url"), F.concat_ws(", ", "r.id", "r.name").alias("description"))


def record_text(pbn: Column, void: str = "-", ten: str = "10") -> Column:
    """Deal text -> record text: hands in the order N, W, E, S, suits as letter and cards, tens and voids spelled."""
    h = B.hands(pbn)
    suit = lambda s, i: F.concat(B.nth(B.SUITS, i), F.when(s == "", void).otherwise(F.replace(s, F.lit("T"), F.lit(ten))))
    return F.array_join(F.flatten(F.array(*[F.transform(h[i], suit) for i in (0, 3, 1, 2)])), "")


def deal_of_record(text: Column, void: str = "-", ten: str = "10") -> Column:
    """Record text -> deal text, cards sorted high to low."""
    plain = F.replace(F.replace(text, F.lit(ten), F.lit("T")), F.lit(void), F.lit(""))
    groups = F.regexp_extract_all(plain, F.lit("([SHDC][AKQJT2-9]*)"), F.lit(1))
    cards = F.transform(groups, lambda g: sort_cards(F.substring(g, 2, 13)))
    seat = lambda i: F.array_join(F.slice(cards, 4 * i + 1, 4), ".")
    return F.when(F.size(groups) == 16, F.concat(F.lit("N:"), F.concat_ws(" ", seat(0), seat(2), seat(3), seat(1))))


def sort_cards(cards: Column) -> Column:
    ranks = F.filter(F.split(cards, ""), lambda c: c != "")
    ordered = F.array_sort(F.transform(ranks, lambda c: F.struct(F.instr(F.lit(B.RANKS), c).alias("o"), c.alias("c"))))
    return F.array_join(F.transform(ordered, lambda x: x["c"]), "")


def valid_deal(pbn: Column) -> Column:
    """All 52 cards once, thirteen a hand."""
    h = B.hands(pbn)
    cards = F.flatten(F.transform(h, lambda suits: F.flatten(F.transform(suits, lambda s, i: F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.concat(B.nth(B.SUITS, i), c))))))
    even = F.forall(F.transform(h, lambda suits: F.length(F.array_join(suits, ""))), lambda n: n == 13)
    known = F.forall(cards, lambda c: F.instr(F.lit(B.RANKS), F.substring(c, 2, 1)) > 0)
    return F.coalesce((F.size(h) == 4) & even & known & (F.size(F.array_distinct(cards)) == 52) & (F.size(cards) == 52), F.lit(False))
