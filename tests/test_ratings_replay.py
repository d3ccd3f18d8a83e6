"""Ratings against a plain replay of the rules."""

import datetime
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tricklake.operators import ratings as R


def replay(rows, players, spread=50.0, least=2):
    """rows: (session, board, N, E, S, W, pct, top); sessions in order. A field is a board of the session in all sections."""
    state, history = {}, []
    for session in sorted({r[0] for r in rows}):
        entries = defaultdict(list)
        for s, b, n, e, so, w, pct, top in rows:
            if s == session:
                size = min(60.0, 1.0 if top is None else top / 2 + 1)
                scale = math.sqrt(max(size - 1, 1) / 11) if size > 1 else 1.0
                for pool, pair, x in (("NS", (n, so), pct), ("EW", (e, w), None if pct is None else 1 - pct)):
                    ids = list(pair) if players else ["-".join(sorted(pair))]
                    own = sum(state.get((pool, i), (1500.0, 0, 0))[0] for i in ids) / len(ids)
                    entries[b, pool].append((ids, own, x, scale))
        delta, played, seen = defaultdict(float), defaultdict(int), set()
        for (_, pool), es in entries.items():
            n, total = len(es), sum(e[1] for e in es)
            mean = total / n
            dev = math.sqrt(sum((e[1] - mean) ** 2 for e in es) / n)
            for ids, own, x, scale in es:
                others = (total - own) / (n - 1) if n > 1 else own
                expected = 1 / (1 + 10 ** (-(own - others) / 400))
                ratio, z = dev / spread, (mean - 1500) / spread
                stratum = 1.0 if n == 1 or ratio <= 0.8 else 0.25 if ratio >= 1.3 else 1 - 0.75 * (ratio - 0.8) / 0.5
                strength = 1.0 if n == 1 or z >= 0 else 0.25 if z <= -2 else 1 + 0.375 * z
                for i in ids:
                    seen.add((pool, i))
                    if x is not None:
                        played[pool, i] += 1
                        boost = 1.5 if state.get((pool, i), (0, 0, 0))[1] < 100 else 1.0
                        delta[pool, i] += 24 * boost * scale * stratum * strength * (x - expected) / len(ids)
        for k in seen:
            r, b, c = state.get(k, (1500.0, 0, 0))
            after = min(3000.0, max(200.0, r + delta[k]))
            c += played[k] > 0
            history.append((session, *k, round(r, 6), round(after, 6), round(r, 6) if c >= least else None, round(after, 6) if c >= least else None))
            state[k] = (after, b + played[k], c)
    return sorted(history, key=str)


SCHEMA = "session_id long, section_id int, Board int, Player_ID_N string, Player_ID_E string, Player_ID_S string, Player_ID_W string, Pct_NS double, MP_Top long, Date date"


def history(df, **more):
    r = lambda x: None if x is None else round(x, 6)
    return sorted(((x.session_id, x.pool, x.id, r(x.before), r(x.after), r(x.seen_before), r(x.seen_after)) for x in R.rate(df, visible_after=2, **more).collect()), key=str)


@pytest.fixture(scope="module")
def clubs(spark):
    """Seven sessions of two clubs, of which some players visit the other; two sections, boards with one row, null percentages, tops from none to 200."""
    r = random.Random(6)
    rows = []
    for s in range(7):
        for sec in range(2):
            for b in range(8):
                for _ in range(r.choice([0, 1, 1, 3])):
                    at = s % 2 * 6 if s < 5 else 3
                    n, so, e, w = r.sample(range(at, at + 8 if s >= 3 else at + 5), 4)
                    rows.append((s, sec, b, f"p{n}", f"p{e}", f"p{so}", f"p{w}", r.choice([None, 0.0, 0.25, 0.5, 0.9, 1.0]), r.choice([None, 1, 12, 200])))
    df = spark.createDataFrame([(*x, datetime.date(2020, 1, 1 + x[0] // 2)) for x in rows], SCHEMA)
    return df, [(x[0], *x[2:]) for x in rows]


@pytest.mark.parametrize("players", [False, True])
def test_every_session(clubs, players):
    df, rows = clubs
    assert history((R.unpivot_players if players else R.unpivot_pairs)(df)) == replay(rows, players)


@pytest.mark.parametrize("seats", [30, 120])
def test_rounds_and_groups_do_not_change_ratings(clubs, seats):
    df, rows = clubs
    assert history(R.unpivot_players(df), group_seats=seats) == replay(rows, True)


@pytest.mark.parametrize("players", [False, True])
def test_waves_do_not_change_ratings(clubs, players):
    """Groups of which none fits a task: every date goes by waves."""
    df, rows = clubs
    df = df.withColumn("Date", F.lit("2020-01-01").cast("date"))
    assert history((R.unpivot_players if players else R.unpivot_pairs)(df), group_seats=1) == replay(rows, players)


@pytest.mark.parametrize("seed, seats", [(1, 100_000), (2, 100_000), (3, 40)])
def test_batches_in_any_order_end_in_one_history(spark, clubs, tmp_path, seed, seats):
    """Sessions come late, in parts and more than one at a time; a batch that is run again changes nothing."""
    df, rows = clubs
    r = random.Random(seed)
    store = f"file://{tmp_path}/store"
    place = {s: r.randrange(4) for s in range(7)}
    split = r.choice(sorted(place))  # this session comes in two parts
    part = F.lit(0)
    for s, b in place.items():
        part = F.when(F.col("session_id") == s, F.when((F.lit(s) == split) & (F.col("Board") % 2 == 0), (b + 1) % 4).otherwise(b)).otherwise(part)
    done = []
    for number in range(4):
        batch = R.unpivot_players(df.where(part == number))
        done.append(R.rate_batch(batch, store, number, group_seats=seats))
        if number == 2:
            assert R.rate_batch(batch, store, number, group_seats=seats) == done[-1]
    # a board is one field whatever the batch of its rows
    x = lambda v: None if v is None else round(v, 6)
    got = sorted(((h.session_id, h.pool, h.id, x(h.before), x(h.after), x(h.seen_before), x(h.seen_after)) for h in R.stored_ratings(spark, store, 2).collect()), key=str)
    assert got == replay(rows, True)
    assert R.rate_batch(R.unpivot_players(df.limit(0)), store, 4) == 0


def test_sessions_apart_keep_their_history(spark, tmp_path):
    """A late session of one club leaves the other club's later sessions alone."""
    day = lambda n: datetime.date(2020, 1, n)
    row = lambda s, who, n: (s, 0, 1, *[f"{who}{i}" for i in range(4)], 0.75, None, day(n))
    store = f"file://{tmp_path}/store"
    first = [row(1, "a", 5), row(2, "b", 5), row(3, "a", 9), row(4, "b", 9)]
    assert R.rate_batch(R.unpivot_pairs(spark.createDataFrame(first, SCHEMA)), store, 0) == 4
    assert R.rate_batch(R.unpivot_pairs(spark.createDataFrame([row(5, "a", 7)], SCHEMA)), store, 1) == 2
    whole = spark.createDataFrame([*first, row(5, "a", 7)], SCHEMA)
    key = lambda x: (x.session_id, x.pool, x.id, round(x.before, 9), round(x.after, 9))
    assert sorted(map(key, R.stored_ratings(spark, store).collect())) == sorted(map(key, R.rate(R.unpivot_pairs(whole)).collect()))


def test_a_board_with_one_row_and_two_sections_by_hand(spark):
    day = datetime.date(2020, 1, 1)
    # alone on board 1: 24 * 1.5 * (1 - 0.5); board 2 in two sections is one field of two: 24 * 1.5 * (0.8 - 0.5) and (0.2 - 0.5)
    rows = [(1, 0, 1, "a", "c", "b", "d", 1.0, None, day), (1, 0, 2, "a", "c", "b", "d", 0.8, None, day), (1, 1, 2, "e", "g", "f", "h", 0.2, None, day)]
    got = {x[2]: x[4] for x in history(R.unpivot_pairs(spark.createDataFrame(rows, SCHEMA)))}
    assert got == {"a-b": 1500 + 18 + 10.8, "c-d": 1500 - 18 - 10.8, "e-f": 1500 - 10.8, "g-h": 1500 + 10.8}
    # a section of 23 pairs: the square root of 22 / 11
    one = spark.createDataFrame([(*rows[0][:8], 44, day)], SCHEMA)
    assert {x[2]: x[4] for x in history(R.unpivot_pairs(one))}["a-b"] == round(1500 + 18 * math.sqrt(2), 6)


def test_no_rows(spark):
    assert R.rate(R.unpivot_pairs(spark.createDataFrame([], SCHEMA))).collect() == []


def test_stage_checks(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        R.stage("x", ["b"], ["c"], lambda d: d)(df)
    with pytest.raises(ValueError):
        R.stage("x", ["a"], ["c"], lambda d: d)(df)
    assert R.stage("x", ["a"], ["a"], lambda d: 1 / 0)(df) is df
