"""The registered rating queries rate the real sessions, in order."""

import pytest

from tests.test_ratings_replay import replay
from tricklake import fixtures as X
from tricklake.operators import matchpoints as M
from tricklake.plans import ratings as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    b = M.percentages(M.matchpoints(X.board_results(spark, SF)))
    return [tuple(r) for r in b.select("session_id", "Board", *[f"Player_ID_{d}" for d in "NESW"], "Pct_NS", "MP_Top").collect()]


@pytest.mark.parametrize("name, players", [("elo1_pair_ratings", False), ("elo2_player_ratings", True)])
def test_queries_rate_each_session(spark, rows, name, players):
    got = P.Q[name](spark, SF).collect()
    want = {x[:3]: x[3:] for x in replay(rows, players, least=10)}
    assert len({r[0] for r in rows}) == 24
    assert {(r.session_id, r.pool, r.id) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        for x, y in zip((r.before, r.after, r.seen_before, r.seen_after), want[r.session_id, r.pool, r.id]):
            assert x == pytest.approx(y, abs=2e-6) if y is not None else x is None


def test_start_and_end_of_pairs_and_players(spark, rows):
    pairs, players = ({x[:3]: x[5:] for x in replay(rows, p, least=10)} for p in (False, True))
    for name in ("elo5_session_start_end", "elo6_rating_pipeline"):
        got = P.Q[name](spark, SF).collect()
        assert len(got) == len(rows)
    got = P.Q["elo5_session_start_end"](spark, SF).collect()
    for r in got:
        for d in "NESW":
            want = players[r.session_id, "NS" if d in "NS" else "EW", r[f"Player_ID_{d}"]]
            assert [r[f"Elo_{d}_Start"], r[f"Elo_{d}_End"]] == [None if y is None else pytest.approx(y, abs=2e-6) for y in want]
        for p in ("NS", "EW"):
            want = pairs[r.session_id, p, "-".join(sorted(r[f"Player_ID_{d}"] for d in p))]
            assert [r[f"Elo_{p}_Start"], r[f"Elo_{p}_End"]] == [None if y is None else pytest.approx(y, abs=2e-6) for y in want]
