"""Rows of stored result pages, one function a page type: tournaments, clubs, ranking, a pair's route, a board.

Pages are rows (page_id, url, html). What a page lacks is null; rows that cannot be read are left out, as are pages of other types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bridge as B
from ..functions.rows import computed
from ..operators.canonical import FRENCH_SEATS
from .documents import all_matches, text_of

# fixed values of the page format
DAY = r"(?:Lundi|Mardi|Mercredi|Jeudi|Vendredi|Samedi|Dimanche)\s+\d{1,2}\s+(?:Janvier|Février|Mars|Avril|Mai|Juin|Juillet|Août|Septembre|Octobre|Novembre|Décembre)\s+\d{4}"
EVENT = r"(Simultané[^<>]*?n°\d+)"
STRAINS = {"SA": "N", "P": "S", "C": "H", "K": "D", "T": "C", "♠": "S", "♥": "H", "♦": "D", "♣": "C", "pique": "S", "coeur": "H", "carreau": "D", "trefle": "C"}
DEALERS = {"Nord": "N", "Est": "E", "Sud": "S", "Ouest": "W"}
VULS = {"Personne": "None", "Nord-Sud": "N_S", "Est-Ouest": "E_W", "Tous": "Both"}
SIDES = {"NS": "NS", "EO": "EW", "EW": "EW"}


def _found(html: Column, pattern: str, group: int = 1) -> Column:
    """The first match, trimmed; null where there is none."""
    text = F.trim(F.regexp_replace(F.regexp_extract(html, pattern, group), "(?:&nbsp;| )", " "))
    return F.when(text != "", text)


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def _query(url: Column, key: str) -> Column:
    return _found(url, rf"[?&](?:amp;)?{key}=([^&\"\s]+)")


def _card(text: Column) -> Column:
    """A card with French honours and a suit sign."""
    return F.translate(F.regexp_replace(text, r"[\s ]+", ""), "♠♥♦♣RDV", "SHDCKQJ")


def tournaments(pages: DataFrame) -> DataFrame:
    """(page_id, Date, Tournament_ID, Tournament_Name): dates and tournament links of a page, paired in order as far as both go."""
    dates = all_matches(F.col("html"), r'(?s)<div class="col-4 p-0 text-left h5">(.*?)</div>')
    links = all_matches(F.col("html"), r'(?s)(<a [^>]*href="[^"]*p=clubs[^"]*res=sim[^"]*tr=[^"]*"[^>]*>.*?</a>)')
    rows = pages.select("page_id", F.explode(F.arrays_zip(dates.alias("d"), links.alias("a"))).alias("x")).where("x.d is not null and x.a is not null")
    return rows.select("page_id", _found(F.col("x.d"), f"({DAY})").alias("Date"), _query(F.col("x.a"), "tr").alias("Tournament_ID"), text_of(F.col("x.a")).alias("Tournament_Name"))


def clubs(pages: DataFrame) -> DataFrame:
    """(page_id, Date, Tournament_ID, Event_Name, Club_ID, Club_Name) of each club link; without links the club numbers in the page, named by number."""
    html = F.col("html")
    links = all_matches(html, r'(?s)(<a [^>]*href="[^"]*p=club&[^"]*res=sim[^"]*cl=[^"]*"[^>]*>.*?</a>)')
    linked = F.transform(links, lambda a: F.struct(_query(a, "cl").alias("id"), text_of(a).alias("name")))
    bare = F.transform(F.array_distinct(all_matches(html, r"\bcl=(\d+)")), lambda c: F.struct(c.alias("id"), F.concat(F.lit("Club "), c).alias("name")))
    rows = pages.select("page_id", _found(html, f"({DAY})").alias("Date"), _query(F.col("url"), "tr").alias("Tournament_ID"), _found(html, EVENT).alias("Event_Name"), F.explode(F.when(F.size(links) > 0, linked).otherwise(bare)).alias("c"))
    return rows.select("page_id", "Date", "Tournament_ID", "Event_Name", F.col("c.id").alias("Club_ID"), F.col("c.name").alias("Club_Name"))


def ranking(pages: DataFrame) -> DataFrame:
    """A row for each pair of a ranking: place, percentage, points, bonus, both players, section, number, and the page's event, date, counts and ids. Rows without a link to the pair are left out."""
    html = F.col("html")
    head = pages.select("page_id", _found(html, EVENT).alias("Event_Name"), _found(html, r'(?s)<div class="col-4 p-0 text-left h5">(.*?)</div>').alias("Date"), _found(html, r"(\d+)\s+paires\s*-\s*\d+\s+clubs").try_cast("long").alias("Team_Count"),
                        _found(html, r"\d+\s+paires\s*-\s*(\d+)\s+clubs").try_cast("long").alias("Club_Count"), _query(F.col("url"), "tr").alias("Event_ID"), _query(F.col("url"), "cl").alias("Club_ID"), F.slice(F.split(html, '<div class="row text-center raye p-0 py-1">'), 2, 2**31 - 1).alias("rows"))
    r = head.select("*", F.explode("rows").alias("row")).drop("rows")
    cells = all_matches(F.substring_index("row", "col-md-7", 1), r'<div class="col-\d+[^"]*">([^<]*)</div>')
    number = lambda i: F.coalesce(_number(F.trim(F.try_element_at(cells, F.lit(i)))), F.lit(0.0))
    link = F.regexp_extract("row", r'(?s)(<a [^>]*href="[^"]*p=route[^"]*"[^>]*>.*?</a>)', 1)
    part = lambda text, i, default: F.coalesce(F.trim(F.try_element_at(F.split(text, "-"), F.lit(i))), F.lit(default))
    ids = F.coalesce(_found(F.col("row"), r'<div class="d-none d-sm-block">([^<]*)</div>'), F.lit("0"))
    names = text_of(F.regexp_replace(link, "&nbsp;", " "))
    return r.where(link != "").select(
        "page_id", number(1).cast("int").alias("Rank"), number(2).alias("Percent"), number(3).alias("Points"), number(4).alias("Bonus"), part(ids, 1, "0").alias("Player1_ID"), part(ids, 2, "0").alias("Player2_ID"),
        part(names, 1, "Unknown").alias("Player1_Name"), part(names, 2, "Unknown").alias("Player2_Name"), _query(link, "sc").alias("Section"), _query(link, "eq").alias("Team_Number"), "Event_Name", "Date", "Team_Count", "Club_Count", "Event_ID", "Club_ID",
    )


def _contract(text: Column, seat: Column) -> Column:
    """Level and strain with the declarer, English."""
    return F.concat(F.substring(text, 1, 1), B.lookup(STRAINS, F.regexp_extract(text, r"^[1-7]\s*(SA|[PCKT♠♥♦♣])", 1)), B.lookup(FRENCH_SEATS, seat))


def _result(text: Column) -> Column:
    """Result after a contract: =, +1, -2; 0 without one."""
    return F.coalesce(F.regexp_extract(text, r"([+-]\d+)\s*$", 1).try_cast("int"), F.lit(0))


def route(pages: DataFrame) -> DataFrame:
    """A row for each board of a pair's route, with the opponents of the round it stands in.

    Boards come in order of their number; the contracts and leads of the page belong to them in turn, by position.
    """
    html, text = F.col("html"), F.col("text")
    foe = r"(NS|EW|EO)\s+(\d+)\s+([\p{Lu}\s\-]+?)\s+\(\d+[,.]\d+\s*%\)"
    own = r"([\p{Lu}][\p{Lu}\s\-]*?)\s*\((NS|EO|EW)(\d+)\s*([A-Z])\)"

    def parsed(row: Column, pos: Column) -> Column:
        adv = F.regexp_replace(F.regexp_extract(row, r'(?s)<div class="col adv">(.*?)</div>', 1), "&nbsp;", " ")
        mp = _found(row, r'<div class="col-4 text-right">([^<]*)</div>')
        return F.struct(
            _found(row, r'(?s)<div class="col-1">\s*<a [^>]*>\s*(\d+)\s*</a>').try_cast("int").alias("Board"), pos.alias("pos"), _found(row, r'<div class="col-2 text-right">([^<]*)</div>').try_cast("int").alias("Score"),
            F.when(F.contains(mp, F.lit("(")) & F.contains(mp, F.lit("%")), mp).alias("mp"), F.regexp_extract(text_of(adv), foe, 0).alias("adv"),
        )

    # the page's text once, and each row once; a page's lists are never copied to its rows
    p = computed(pages, "page_id", "url", "html", text_of(F.regexp_replace("html", "&nbsp;", " ")).alias("text"), F.split("html", '<div class="row">').alias("parts"))
    listed = lambda kind: F.transform(all_matches(html, rf'<div class="col {kind}">([^<]*)</div>'), lambda c: F.trim(c))
    p = computed(
        p, "page_id", _found(html, EVENT).alias("Event_Name"), F.regexp_extract(text, own, 0).alias("own"), _query(F.col("url"), "tr").alias("Tournament_ID"), _query(F.col("url"), "cl").alias("Club_ID"), listed("contrat").alias("contracts"), listed("entame").alias("leads"),
        F.transform(F.slice("parts", F.lit(2), F.size("parts")), parsed).alias("rows"),
    )
    whole = lambda r: r["Board"].isNotNull() & r["Score"].isNotNull() & r["mp"].isNotNull()
    # boards in order of their number take the contracts and leads in turn; the other rows, which may name opponents, come after them
    ordered = F.concat(F.sort_array(F.filter("rows", whole)), F.filter("rows", lambda r: ~whole(r)))
    p = p.select("page_id", "Event_Name", "own", "Tournament_ID", "Club_ID", F.inline(F.arrays_zip(ordered.alias("r"), F.col("contracts").alias("called"), F.col("leads").alias("lead")))).where("r is not null")
    of = lambda i: _found(F.col("adv"), foe, i)
    p = p.select("page_id", "Event_Name", "own", "Tournament_ID", "Club_ID", "called", "lead", "r.*")
    against = F.when(F.col("adv") != "", F.struct(B.lookup(SIDES, of(1)).alias("side"), of(2).try_cast("long").alias("number"), of(3).alias("names")))
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # a page's rows
    p = p.withColumn("against", F.last(against, ignorenulls=True).over(before)).where("Board is not null and Score is not null and mp is not null")
    seat, bid = F.regexp_extract("called", r"^([NESO])\s*:", 1), F.trim(F.regexp_extract("called", r"^[NESO]\s*:\s*(.*)$", 1))
    share = lambda k: F.coalesce(_number(F.regexp_extract("mp", r"(\d+[,.]\d+)\s*\((\d+[,.]\d+)\s*%\)", k)), F.lit(0.0))
    mine = lambda i: _found(F.col("own"), own, i)
    return p.select(
        "page_id", "Board", "Score", share(1).alias("Matchpoints"), share(2).alias("Percentage"), B.lookup(FRENCH_SEATS, seat).alias("Declarer"), _contract(bid, seat).alias("Contract"), F.when(seat != "", _result(bid)).alias("Result"), _card(F.col("lead")).alias("Lead"),
        mine(1).alias("Pair_Names"), B.lookup(SIDES, mine(2)).alias("Pair_Direction"), mine(3).try_cast("long").alias("Pair_Number"), mine(4).alias("Section"), "Event_Name", "Tournament_ID", "Club_ID",
        F.col("against.side").alias("Opponent_Pair_Direction"), F.col("against.number").alias("Opponent_Pair_Number"), F.col("against.names").alias("Opponent_Pair_Names"),
    )


def boards(pages: DataFrame) -> DataFrame:
    """One row a board page: board, deal, top, dealer, vulnerability, contract, lead, result, score, both pairs and ids. Pages without a board number are left out; a deal needs sixteen suits of the hands North, West, East, South."""
    html, text = F.col("html"), F.col("text")
    own, foe = r"([\p{L}]+)\s+-\s+([\p{L}]+)\s+\((\d+)\s+([A-Za-z]+)\)", r"contre\s+(NS|EW|EO)\s*:\s*([\p{Lu}\s\-]+?)\s*\((\d+)\s+([A-Z])\)"
    # the page's text once; then each pattern once over the page, its groups from what it has found
    plain = computed(pages, "page_id", "url", "html", text_of(F.regexp_replace("html", "&nbsp;", " ")).alias("text"))
    whole = lambda source, pattern: F.regexp_extract(source, pattern, 0)
    p = computed(
        plain, "page_id", "url", _found(text, r"Donne\s+(\d+)").try_cast("int").alias("number"),
        # a void is written as a dash or left blank
        F.transform(all_matches(html, r'(?s)<div class="flex-grow-1 ms-3 gros">\s*(?:&nbsp;)?([^<]*?)\s*</div>'), lambda c: F.translate(F.trim(c), "RDV-— ", "KQJ")).alias("suits"),
        whole(html, r"(?s)Contrat\s*\((.*?)<br>").alias("span"), whole(text, own).alias("own"), whole(text, foe).alias("foe"), _found(text, r"Donneur\s*:\s*(\p{L}+)").alias("dealer"), _found(text, r"Top\s*=\s*(\d+)").try_cast("int").alias("top"),
        _found(text, r"Vulnérabilité\s*:\s*([\p{L}\-]+)").alias("vul"), _found(text, r"Entame\s*:\s*([♠♥♦♣]\s*[^\s—]+)").alias("lead"), _found(text, r"Résultat\s*:\s*([+-]?\d+|=)").alias("result"),
        _found(html, r'(?s)<div class="row colorise">.*?<div class="col-3">\s*(-?\d+)\s*</div>').try_cast("int").alias("score"), _found(html, r'(?s)<div class="col p-0 h2">(.*?)</div>').alias("event"),
    ).where("number is not null")
    span = F.col("span")
    hand = lambda i: F.array_join(F.slice("suits", 4 * i + 1, 4), ".")
    pbn = F.when(F.size("suits") == 16, F.concat(F.lit("N:"), F.concat_ws(" ", hand(0), hand(2), hand(3), hand(1))))
    strain = F.coalesce(_found(span, r'<span class="(pique|coeur|carreau|trefle)">'), _found(span, r":\s*\d+\s*(?:&nbsp;)?\s*(SA)"))
    p = p.withColumns({"seat": B.lookup(FRENCH_SEATS, F.regexp_extract(span, r"Contrat\s*\(([NESO])\)", 1)), "strain": B.lookup(STRAINS, strain)})
    mine, theirs = (lambda i, name=name, pattern=pattern: _found(F.col(name), pattern, i) for name, pattern in (("own", own), ("foe", foe)))
    return p.select(
        "page_id", F.col("number").alias("Board"), pbn.alias("PBN"), F.col("top").alias("MP_Top"), F.coalesce(B.lookup(DEALERS, F.col("dealer")), B.dealer_of(F.col("number"))).alias("Dealer"), B.lookup(VULS, F.col("vul")).alias("Vul"), F.col("seat").alias("Declarer"),
        _card(F.col("lead")).alias("Lead"), F.concat(_found(span, r":\s*(\d)"), "strain", "seat").alias("Contract"), F.replace("result", F.lit("="), F.lit("0")).try_cast("int").alias("Result"), F.col("score").alias("Score"), F.col("event").alias("Event_Name"),
        F.concat(mine(1), F.lit(" - "), mine(2)).alias("Team_Name"), mine(3).try_cast("long").alias("Pair_Number"), mine(4).alias("Section"), _query(F.col("url"), "tr").alias("Tournament_ID"), _query(F.col("url"), "cl").alias("Club_ID"),
        B.lookup(SIDES, theirs(1)).alias("Opponent_Pair_Direction"), theirs(3).try_cast("long").alias("Opponent_Pair_Number"), theirs(2).alias("Opponent_Pair_Names"), theirs(4).alias("Opponent_Pair_Section"),
    )
