"""Game records against a plain replay, odd files, quarantine and merge."""

import random

from pyspark.sql import functions as F
from tests.record_replay import NAMES, RANKS, SUITS, board_row, boards_of

from tricklake.sources import records as R

SEATS = "NESW"


def auction(r):
    """Random calls; mostly legal and over."""
    calls, bids, level = [], 0, 0
    while True:
        if r.random() < 0.45 and level < 34:
            level += r.randint(1, 4)
            level = min(level, 34)
            calls.append(f"{level // 5 + 1}{'CDHSN'[level % 5]}" + ("!" if r.random() < 0.2 else ""))
            bids += 1
        elif bids and r.random() < 0.15:
            calls.append(r.choice("dr"))
        else:
            calls.append("p")
        if len(calls) >= 4 and calls[-3:] == ["p"] * 3:
            return calls


def record(r):
    cards = [s + c for s in SUITS for c in RANKS]
    r.shuffle(cards)
    hands = {s: set(cards[13 * i : 13 * i + 13]) for i, s in enumerate(SEATS)}
    text = lambda s: "".join(x + "".join(c for c in RANKS if x + c in hands[s]) for x in SUITS)
    dealer = r.randrange(4)  # of SWNE
    given = [text(s) for s in "SWNE"]
    kind = r.random()
    if kind < 0.5:
        given[r.choice((3, 3, 3, 1))] = ""
    if kind > 0.95:
        given[0] = given[0][:-2]
    calls = auction(r)
    if r.random() < 0.05:
        calls = calls[:-1]
    if r.random() < 0.03:
        calls[0] = "8N"
    out = f"qx|o{r.randint(1, 30)}|" + (f"pn|s{r.randint(1, 9)},w,,e|" if r.random() < 0.5 else "")
    out += "" if r.random() < 0.04 else f"md|{'' if r.random() < 0.05 else dealer + 1}{','.join(given)}|"
    out += "" if r.random() < 0.05 else f"sv|{r.choice('oObBnNeE0-')}|"
    out += "" if r.random() < 0.5 else f"ah|Board {r.randint(1, 99)}|"
    for c in calls:
        out += f"mb|{c}|" + ("an|shows, it|" if r.random() < 0.1 else "")
    row = board_row(boards_of(out)[0])
    order, left = [], {s: sorted(hands[s]) for s in SEATS}
    if row["declarer"]:
        at = (SEATS.index(row["declarer"]) + 1) % 4
        strain = next(k for k, v in NAMES.items() if v == row["denom"])
        for _ in range(13):
            trick = []
            for i in range(4):
                seat = SEATS[(at + i) % 4]
                follow = [c for c in left[seat] if trick and c[0] == trick[0][0]]
                card = r.choice(follow or left[seat])
                left[seat].remove(card)
                trick.append(card)
            at = (at + max(range(4), key=lambda i: (trick[i][0] == strain, trick[i][0] == trick[0][0], -RANKS.index(trick[i][1])))) % 4
            order += trick
    n = r.choice((52, 52, 51, 48, 49, 47, 20, 0))
    order = order[:n]
    if order and r.random() < 0.05:
        order[r.randrange(len(order))] = r.choice(("SA", "ZZ", "H10"))
    out += "".join(f"pc|{c if r.random() < 0.8 else c.lower()}|" for c in order)
    if r.random() < 0.3:
        out += f"mc|{r.choice((*range(14), 14, 'x'))}|"
    return out + "pg||\n"


def test_against_the_replay(spark):
    r = random.Random(11)
    files = [(f"f{i}", f"vn|x|vg|Cup {i},a,b|pn|S0,W0,N0,E0|\n" + "".join(record(r) for _ in range(r.randint(1, 6)))) for i in range(120)]
    files += [(f"g{i}", record(r).partition("|")[2].partition("|")[2]) for i in range(60)]  # without qx
    want = {(name, i): board_row(b) for name, text in files for i, b in enumerate(boards_of(text))}
    rows = R.parse_records(spark.createDataFrame(files, "source_file string, value string")).collect()
    got = {(x.source_file, x.board): x for x in rows if not x.error}
    assert set(got) == set(want)
    some = {"result": 0, "passed out": 0, "claimed": 0}
    full = {s: n for s, n in zip(SEATS, ("north", "east", "south", "west"))}
    for key, w in want.items():
        g = got[key]
        for c in ("passout", "level", "denom", "penalty", "result", "score", "contract", "dealer", "vulnerability", "claimed"):
            assert g[c] == w[c], (key, c, g[c], w[c])
        assert g.declarer == full.get(w["declarer"]) and g.trump == (w["denom"] or ("nt" if w["passout"] else None))
        assert [g[f"Hand_{s}"] for s in SEATS] == w["hands"]
        assert g.PBN == (R.EMPTY_DEAL if set("".join(w["hands"])) <= {"."} else "N:" + " ".join(w["hands"]))
        assert [g[f"Player_{s}"] for s in SEATS] == w["players"] == [g.info[p] for p in ("North", "East", "South", "West")]
        held = [c for c in w["cards"] if c[0] in SUITS and c[1:] in RANKS]
        assert [(a, b) for a, b in zip(g.play_suit, g.play_rank) if a] == [(NAMES[c[0]], "R" + c[1]) for c in held]
        for k, ok in (("result", w["result"] is not None), ("passed out", w["passout"]), ("claimed", w["claimed"])):
            some[k] += bool(ok)
    assert min(some.values()) > 5 and some["result"] > 60


def test_one_record_by_hand(spark):
    """North opens one heart, South raises to four, East doubles; West leads; hearts are trumps and the play is given for two tricks, then nine are claimed."""
    text = (
        "pn|Sue,Walt,Nell,Ed|st||md|3SKQ2HKJ54DA32C432,SJT98H32DKQJCKQJT,SA3HAQT98D54CA987|rh||ah|Board 5|sv|n|"
        "mb|1H|an|five or more|mb|p|mb|4H!|mb|d|mb|p|mb|p|mb|p|pg||pc|D7|pc|D2|pc|DK|pc|D4|pc|DQ|pc|D5|pc|D8|pc|DA|mc|9|"
    )
    x = R.parse_records(spark.createDataFrame([("a.lin", text)], "source_file string, value string")).first()
    assert (x.board_num, x.dealer, x.vulnerability, x.contract, x.level, x.denom, x.trump, x.penalty, x.declarer) == (5, "N", 2, "4HXN", 4, "hearts", "hearts", "doubled", "north")
    assert (x.result, x.score, x.claimed, x.passout) == (-1, -200, True, False)
    assert x.Hand_E == "7654.76.T9876.65" and x.PBN == "N:A3.AQT98.54.A987 7654.76.T9876.65 KQ2.KJ54.A32.432 JT98.32.KQJ.KQJT"
    assert x.bid_type == ["Contract", "Penalty", "Contract", "Penalty", "Penalty", "Penalty", "Penalty"] and x.bid_announcement == ["five or more"] + [None] * 6
    assert x.bid_alertable == [False, False, True] + [False] * 4 and x.bid_penalty[3] == "doubled" and x.bid_level == [1, None, 4] + [None] * 4
    assert (x.Player_N, x.Player_S) == ("Nell", "Sue") and x.info.West == "Walt" and x.play_suit[0] == "diamonds" and x.play_rank[:2] == ["R7", "R2"]
    assert x.issues == []


def test_quarantine_counters_and_merge(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = "md|1SAKQJT98765432,HAKQJT98765432,DAKQJT98765432|sv|b|ah|Board 2|mb|p|mb|p|mb|p|mb|p|"
    files = {
        "a": good.encode(), "b": good.replace("sv|b|", "").encode() + good.encode(), "c": b"\xff\xfe\x00 md|1|", "d": b"<html>nothing here</html>", "e": b" \n",
        "f": b"md|1|sv|o|mb|p|", "g": b"md|SAK,H2|sv|o|ah|Board x|", "h": good.replace("md|1", "md|9").encode(),
    }
    for name, content in files.items():
        (tmp_path / "in" / name).write_bytes(content)
    rows = R.parse_records(R.read_record_files(spark, f"file://{tmp_path}/in"))
    reasons, issues = R.quality(rows)
    assert dict(map(tuple, reasons.collect())) == {"valid": 2, "error": 3, "invalid_pbn": 1, "null_vulnerability": 1, "null_dealer": 2}
    assert [tuple(x) for x in issues.collect()] == [("auction not over", 2), ("no board", 2), ("no dealer", 2)]
    kept = R.valid_records(rows)
    assert kept.count() == 2 and not {"error", "error_message"} & set(kept.columns) and {x.contract for x in kept.collect()} == {"PASS"}
    bad = R.quarantined(rows)
    assert bad.count() == 7 and {x.source_file.rpartition("/")[2] for x in bad.where("reason = 'error'").collect()} == {"c", "d", "e"}
    assert R.parse_records(spark.createDataFrame([], "source_file string, value string")).collect() == []
    assert R.parse_records(spark.createDataFrame([("n", None)], "source_file string, value string")).select(R.rejection()).first()[0] == "error"


def test_long_fields(spark):
    text = f"md|1|mb|{'x' * 300}|an|{'y' * 100_000}|" + "nt|z|" * 20000
    x = R.parse_records(spark.createDataFrame([("f", text)], "source_file string, value string")).first()
    assert x.bid_type == [None] and len(x.bid_announcement[0]) == 100_000 and "unknown call" in x.issues
    assert x.PBN == R.EMPTY_DEAL and F.col("x") is not None
