"""The first provider's rows against a plain reading, and how often they are shuffled."""

import random
import re

from tricklake import plans
from tricklake.operators import canonical as N


def test_against_plain_joins(spark):
    r = random.Random(7)
    rows = [(r.choice(["a", "b", "c", None]), r.choice([1, 2, 3, None]), r.choice(["3SA", "4Px", "passe", "?"]), r.choice("NEOS"), r.choice(["=", "+1", "-2", "-"]), r.choice(["420", "-50", "0", None, "x"]), r.choice([1, 5, 9, None]), r.choice([2, 5, None])) for _ in range(300)]
    # two deals of one board, a section without deals, a board and a section that no row has
    deals = [("a", 1, "d1"), ("a", 1, "d2"), ("a", 2, None), ("b", 1, "d3"), ("b", None, "d4"), (None, 1, "d5"), ("z", 3, "d6")]
    players = [(s, side, p, i, f"{s}{side}{p}/{i}") for s in ("a", "z") for side, p in (("NS", 1), ("NS", 9), ("EW", 2), ("EW", None), (None, 5)) for i in (1, 2)] + [("b", "EW", 5, 2, "alone")]
    names = ["section", "board", "contrat", "declarant", "resultat", "score", "Pair_Number_NS", "Pair_Number_EW"]
    df = spark.createDataFrame(rows, "section string, board int, contrat string, declarant string, resultat string, score string, Pair_Number_NS int, Pair_Number_EW int").repartition(3)
    got = N.from_simultaneous(df, spark.createDataFrame(deals, "section string, board int, deal string"), spark.createDataFrame(players, "section string, side string, pair int, position int, id string")).collect()
    seat = {(s, side, p, i): x for s, side, p, i, x in players if p is not None}
    number = lambda t: int(t) if t not in (None, "x") else None
    joined = [dict(zip(names, x)) | {"deal": d} for x in set(rows) for s, b, d in deals if x[0] is not None and x[1] is not None and (x[0], x[1]) == (s, b)]
    want = []
    for x in joined:
        mine, field = number(x["score"]), [number(y["score"]) for y in joined if y["board"] == x["board"] and number(y["score"]) is not None]
        mp = None if mine is None else sum(f < mine for f in field) + (field.count(mine) - 1) / 2
        who = [seat.get((x["section"], side, x[f"Pair_Number_{side}"], i)) for i in (1, 2) for side in ("NS", "EW")]
        want.append((x["section"], x["board"], x["deal"], mine, x["Pair_Number_NS"], x["Pair_Number_EW"], *who, mp, None if mine is None else len(field) - 1))
    have = [(x.section, x.board, x.deal, x.Score_NS, x.Pair_Number_NS, x.Pair_Number_EW, x.Player_ID_N, x.Player_ID_E, x.Player_ID_S, x.Player_ID_W, x.MP_NS, x.MP_Top) for x in got]
    assert len(have) > 50 and sorted(have, key=str) == sorted(want, key=str)


def test_rows_are_shuffled_by_section_alone(spark):
    df = plans.QUERIES["can1_simultaneous"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    # five shuffles of whole rows before: to drop copies, for the deals, for the pairs of each side and for the scores
    assert not any("hashpartitioning" in x and ("Pair_Number" in x or "contrat" in x) for x in plan)
    reads = {re.sub(r"#\d+L?", "", x.split("DataFilters:")[1].split("]")[0]) for x in plan if "FileScan" in x and "l_linenumber" in x}
    assert len(reads) == 1
