"""Packed sessions: rows in pieces, several dates, nulls; pools that never meet; pairs and players in the same rounds."""

import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_ratings_replay import clubs, history, replay  # noqa: F401
from tricklake.operators import ratings as R

STATE = pa.table({"pool": ["NS", "EW", "other"], "id": ["p1", "p2", "p1"], "rating": [1600.0, 1400.0, 9.0], "boards": [99, 400, 1], "sessions": [3, 4, 1]})


def entries(seed):
    r, day = random.Random(seed), datetime.date(2020, 1, 1)
    rows = []
    for s in range(5):
        for _ in range(r.choice([1, 5, 23])):
            ids = [r.choice([None, "p1", "p2", "p3", "p4", "p5"]) for _ in range(r.choice([1, 2]))]
            rows.append((s, None if s == 3 else day + datetime.timedelta(r.choice([4 - s, 9])), r.choice(["EW", "NS"]), r.choice([None, 1, 2, 3]), ids, r.choice([None, 0.0, 0.4, 1.0]), r.choice([1.0, 1.5])))
    rows.sort(key=lambda x: (x[0], x[1] or datetime.date.max, x[2]))
    kinds = [pa.int64(), pa.date32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.float64(), pa.float64()]
    return pa.table([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=["session_id", "Date", "pool", "board", "ids", "pct", "scale"])


def rated(t, size, piece):
    packed = pa.Table.from_batches(R.pack(iter(t.to_batches(max_chunksize=size)), piece))
    got = pa.Table.from_batches(R._unrated(iter(R.rate_group(packed, STATE, 50.0).combine_chunks().to_batches()))).to_pylist()
    key = lambda x: (str(x["session_id"]), x["pool"], str(x["id"]), str(x["first"]))
    return packed, sorted(({c: round(v, 9) if isinstance(v, float) else v for c, v in x.items()} for x in got), key=key)


@pytest.mark.parametrize("seed", range(4))
def test_pieces_do_not_change_ratings(seed):
    t = entries(seed)
    whole, want = rated(t, 1000, 1000)
    for size, piece in ((1, 1), (3, 2), (7, 1000)):
        pieces, got = rated(t, size, piece)
        assert got == want
        assert sum(pieces["entries"].to_pylist()) == t.num_rows
    assert len({(x["session_id"], x["pool"], x["id"]) for x in want if x["session_id"] is not None}) == sum(x["session_id"] is not None for x in want)
    # a session's date is its first, in all pools; without any it comes first
    days = {s: min((d for s2, d in zip(*(t[c].to_pylist() for c in ("session_id", "Date"))) if s2 == s and d), default=datetime.date(1, 1, 1)) for s in range(5)}
    assert all(x["first"] == days[x["session_id"]] for x in want if x["session_id"] is not None)
    # unpacked are the same entries
    back = pa.Table.from_batches(R.unpack(iter(whole.combine_chunks().to_batches()))).to_pylist()
    own = lambda rows: sorted(str([x[c] if x[c] == x[c] else None for c in ("session_id", "pool", "board", "ids", "pct", "scale")]) for x in rows)
    assert own(back) == own(t.to_pylist())


def test_pools_are_groups_of_their_own(spark):
    """Sessions 1 and 2 share a player, but in different pools."""
    seats = spark.createDataFrame([(1, "NS", "a"), (1, "EW", "b"), (2, "EW", "a"), (2, "NS", "c"), (3, "NS", "c")], "session_id long, pool string, id string")
    import tempfile

    found = {(x.session_id, x.pool): x.g for x in R._groups(seats, f"file://{tempfile.mkdtemp()}", "pool").collect()}
    assert len(found) == 5 and len(set(found.values())) == 4 and found[2, "NS"] == found[3, "NS"]


@pytest.mark.parametrize("seats", [100_000, 120])
def test_pairs_and_players_in_the_same_rounds(clubs, seats):  # noqa: F811
    df, rows = clubs
    r = lambda x: None if x is None else round(x, 6)
    for h, players in zip(R.rate_both(df, visible_after=2, group_seats=seats), (False, True)):
        assert sorted(((x.session_id, x.pool, x.id, *map(r, (x.before, x.after, x.seen_before, x.seen_after))) for x in h.collect()), key=str) == replay(rows, players)


def test_start_and_end_with_a_missing_player(spark):
    """A player that is missing has no ratings, the others at the board do."""
    day = datetime.date(2020, 1, 1)
    df = spark.createDataFrame([(1, 0, 1, "a", "c", "b", "d", 1.0, day), (1, 0, 1, None, "e", "b", "f", 0.0, day)], "session_id long, section_id int, Board int, Player_ID_N string, Player_ID_E string, Player_ID_S string, Player_ID_W string, Pct_NS double, Date date")
    out = R.session_start_end(df, *R.rate_both(df, visible_after=1))
    assert out.count() == 2
    got = {x.Player_ID_N: x for x in out.collect()}
    assert got["a"].Elo_NS_Start == got["a"].Elo_N_Start == 1500 and got["a"].Elo_NS_End > 1500
    assert got[None].Elo_N_Start is None and got[None].Elo_N_End is None and got[None].Elo_S_Start == 1500 and got[None].Elo_EW_End is not None
    assert out.where(F.col("Elo_S_End").isNull()).count() == 0
