"""Rules worked out by hand: quality flags, roles, field counts, theoretical scores, par by exhaustive search, model quality."""

import functools
import random

import pytest
from pyspark.sql import functions as F

from tricklake.functions import bridge as B
from tricklake.operators import bidding, contracts, deals, features, matchpoints, scoring



def test_quality_flags(spark):
    # cards: length, points, sum; the flags that hold
    hands = {
        "": {"At_Best_Partial_Stop_In"}, "J2": {"At_Best_Partial_Stop_In"}, "432": {"At_Best_Partial_Stop_In"}, "Q2": {"Partial_Stop_In"}, "K2": {"Partial_Stop_In", "Likely_Stop_In"}, "A": {"Partial_Stop_In", "Likely_Stop_In", "Stop_In"},
        "J432": {"Partial_Stop_In", "Likely_Stop_In"}, "Q432": {"Partial_Stop_In", "Likely_Stop_In", "Stop_In"}, "K432": {"Biddable", "Partial_Stop_In", "Likely_Stop_In", "Stop_In", "At_Best_Stop_In"},
        "K5432": {"Biddable", "Rebiddable", "Partial_Stop_In", "Likely_Stop_In", "Stop_In", "At_Best_Stop_In", "Two_Stops_In"}, "65432": {"Biddable", "Partial_Stop_In", "Likely_Stop_In"},
        "AKQ": {"Solid", "Partial_Stop_In", "Likely_Stop_In", "Stop_In", "At_Best_Stop_In", "Two_Stops_In"}, "AKQ432": {"Biddable", "Rebiddable", "Twice_Rebiddable", "Strong_Rebiddable", "Solid", "Partial_Stop_In", "Likely_Stop_In", "Stop_In", "At_Best_Stop_In", "Two_Stops_In"},
        "8765432": {"Biddable", "Rebiddable", "Twice_Rebiddable", "Partial_Stop_In", "Likely_Stop_In", "Stop_In", "At_Best_Stop_In"},
    }
    df = spark.createDataFrame([(c,) for c in hands], "cards string")
    got = df.select("cards", *[c.alias(k) for k, c in deals.suit_flags(F.col("cards")).items()]).collect()
    assert {r.cards: {k for k, v in r.asDict().items() if v is True} for r in got} == hands


def test_every_score_is_looked_up_right(spark):
    t = scoring.score_table(spark).select("level", "strain", "dbl", "vul", "tricks", "score", "score_set").collect()
    for r in t:
        assert r.score == B.score_rule(r.level, B.STRAINS.index(r.strain), len(r.dbl), r.vul, r.tricks)
        assert r.score_set == B.score_rule(r.level, B.STRAINS.index(r.strain), len(r.dbl) or int(r.tricks < r.level + 6), r.vul, r.tricks)
    odd = spark.createDataFrame([(3, "Z", "", True, 0), (3, "S", "", True, 5), (3, "S", "", True, -10), (None, "S", "", True, 0), (3, None, "", True, 0), (3, "S", "", True, None)], "l int, s string, d string, v boolean, r int")
    assert [x[0] for x in odd.select(B.contract_score(F.col("l"), F.col("s"), F.col("d"), F.col("v"), F.col("r"))).collect()] == [None] * 6


def test_theoretical_scores_and_roles(spark):
    # board 1: nobody is vulnerable; 4S by N makes ten tricks in theory and is par; 5S would fail by one and count as doubled
    rows = [("4SN", 1, 0, 420, 420, 10), ("5SN", 1, 0, 450, -100, 10), ("4SXN", 1, -1, -100, 420, 10), ("3NE", 1, 0, -400, -420, 7), ("PASS", 1, None, 0, 0, None), (None, 1, None, None, 50, None)]
    df = spark.createDataFrame(rows, "Contract string, Board int, Result int, Score_NS int, Par_NS int, DD_Tricks int").withColumns({f"Player_ID_{d}": F.lit(d.lower()) for d in "NESW"})
    df = contracts.roles(contracts.dd_score(contracts.side_scores(contracts.split_contract(df))))
    got = {r.Contract: r for r in df.collect()}
    assert [(got[c].DD_Score_Declarer, got[c].DD_Score_NS, got[c].DD_Score_Max_Declarer) for c in ("4SN", "5SN", "4SXN", "3NE")] == [(420, 420, 420), (-100, -100, 420), (420, 420, 420), (-300, 300, 90)]
    assert (got["PASS"].DD_Score_NS, got[None].DD_Score_NS, got["PASS"].DD_Score_Declarer) == (0, 0, None)
    flags = lambda r: (r.Is_Par_Contract, r.Is_Sacrifice, r.Is_Par_Suit, r.Defender_Par_GE)
    assert flags(got["4SN"]) == (True, False, True, True) and flags(got["5SN"]) == (True, True, False, False) and flags(got["4SXN"]) == (True, False, True, True)
    # East's par is 420, the score 400
    assert flags(got["3NE"]) == (False, False, False, True) and got["3NE"].EV_Score_Col_Declarer == "EV_EW_E_N_3_NV" and (got["3NE"].OnLead_ID, got["3NE"].NotOnLead_ID, got["3NE"].Dummy_ID) == ("s", "n", "w")
    assert flags(got["PASS"]) == (None, None, None, True) and got[None].Defender_Par_GE is None


def test_fields_over_sections_and_nulls(spark):
    rows = [(1, 0, 1, 7, 100, 110), (1, 1, 1, 7, 110, None), (1, 0, 1, 7, None, 90), (1, 0, 1, 8, 50, 60)]
    df = spark.createDataFrame(rows, "session_id int, section_id int, Board int, deal_id int, Score_NS int, A int")
    # the three rows of deal 7, both sections: 110 above its score 100; no value or no score compares as 0
    assert sorted((r.deal_id, r.MP_A) for r in matchpoints.own_score_matchpoints(df, ["A"]).collect()) == [(7, 1.0)] * 3 + [(8, 1.0)]
    # scores 100, 110 and 0 for null: 100 beats one and ties itself, 110 beats two, null ties itself
    assert sorted(((r.deal_id, r.Score_NS or 0), r.n) for r in matchpoints.all_pairs(df, "Score_NS", "n").collect()) == [((7, 0), 0.5), ((7, 100), 1.5), ((7, 110), 2.5), ((8, 50), 0.5)]


def auction_value(tricks, code, dealer):
    """Best result of all auctions: four seats in turn pass or bid higher, three passes after a bid or four at the start end it."""
    value = {}
    for side in (0, 1):
        for rank in range(35):
            level, strain = rank // 5 + 1, rank % 5
            t = tricks[side][strain]
            s = B.score_rule(level, strain, int(t < level + 6), bool(code >> side & 1), t)
            value[rank, side] = s if side == 0 else -s

    @functools.lru_cache(None)
    def best(last, holder, passes, turn):
        side = turn % 2
        if passes == (4 if last < 0 else 3):
            return 0 if last < 0 else value[last, holder]
        options = [best(last, holder, passes + 1, (turn + 1) % 4)] + [best(r, side, 0, (turn + 1) % 4) for r in range(last + 1, 35)]
        return max(options) if side == 0 else min(options)

    return best(-1, -1, 0, dealer)


def test_par_against_all_auctions(spark):
    r = random.Random(5)
    rows, want = [], {}
    for deal in range(60):
        board = deal % 16 + 1
        cells = [r.choice([r.randint(0, 13), r.randint(5, 8)]) for _ in range(20)]
        at = lambda seat, strain: cells[seat * 5 + B.TRICK_STRAINS.index(strain)]
        tricks = [[max(at(side, s), at(side + 2, s)) for s in B.STRAINS] for side in (0, 1)]
        code = (board - 1) // 4 + (board - 1) % 4 & 3
        rows.append((deal, board, cells))
        want[deal] = auction_value(tricks, code, (board - 1) % 4)
    df = spark.createDataFrame(rows, "deal_id long, Board int, cells array<int>")
    assert {x.deal_id: x.par_score for x in scoring.par(df).collect()} == want


def test_par_lists_that_mean_the_same(spark):
    rows = [(1, 420, ["4S NS 0"], 420, ["3S NS 1"]), (2, 420, ["4S NS 0"], 420, ["4S NS 0", "4H NS 0"]), (3, -100, ["5CX EW -1"], -100, ["5C EW -1"]), (4, 0, [], 0, []), (5, 90, ["1N NS 0"], 120, ["1N NS 0"])]
    df = spark.createDataFrame(rows, "deal_id int, s1 int, c1 array<string>, s2 int, c2 array<string>")
    one, two = (df.select("deal_id", F.col(f"s{i}").alias("par_score"), F.col(f"c{i}").alias("contracts")) for i in (1, 2))
    assert sorted(r.deal_id for r in scoring.differing_pars(one, two).collect()) == [2, 3, 5]
    assert [r.deal_id for r in scoring.differing_pars(one, one.where("deal_id <> 4")).collect()] == [4]


def test_no_caps(spark):
    # a chain of 80 rules
    rules = spark.createDataFrame([(i, i - 1, "1C") for i in range(1, 81)], "rule_id int, parent int, bid string")
    assert bidding.with_ancestors(rules).where("rule_id = 80").count() == 80
    with pytest.raises(ValueError):
        bidding.with_ancestors(spark.createDataFrame([(1, 2, "1C"), (2, 1, "1D")], rules.schema))


def test_auctions_go_on_to_their_end(spark, tmp_path):
    """A relay system in which the opener's side has fourteen bids: 1C-p-1D-p-1H ... and three passes, more than 24 calls."""
    bids = [f"{n}{s}" for n in range(1, 4) for s in "CDHSN"][:14]
    rules = spark.createDataFrame([(i + 1, i, b) for i, b in enumerate(bids)], "rule_id int, parent int, bid string")
    deal = spark.createDataFrame([(1, 1)], "deal_id long, Board int")
    holds = spark.createDataFrame([(1, d, i + 1) for i in range(14) for d in "NS"], "deal_id long, seat string, rule_id int")
    got = bidding.auctions(deal, holds, rules, f"file://{tmp_path}")
    assert [r.auction for r in got.collect()] == [[x for b in bids for x in (b, "p")] + ["p", "p"]]
    assert bidding.auctions(deal, holds, rules, f"file://{tmp_path}", prefixes=True).count() == 30


def test_bitmap_is_built_anew_when_a_source_changes(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "N:AKQJT98765432... .AKQJT98765432.. ..AKQJT98765432. ...AKQJT98765432")], "deal_id long, Board int, PBN string")
    bits = lambda df, p: bidding.bitmap(bidding.stored_bitmap(df, p, f"file://{tmp_path}")).count()
    assert bits(df, ["HCP >= 10"]) == 4 and len(list(tmp_path.iterdir())) == 1
    assert bits(df, ["HCP >= 10"]) == 4 and len(list(tmp_path.iterdir())) == 1
    assert bits(df.unionByName(df.withColumn("deal_id", F.lit(2).cast("long"))), ["HCP >= 10"]) == 8
    assert bits(df, ["HCP >= 11"]) == 0 and len(list(tmp_path.iterdir())) == 3


def test_trained_models_are_right(spark):
    r = random.Random(1)
    rows = [(i, r.uniform(-5, 5), r.uniform(0, 9)) for i in range(600)]
    df = spark.createDataFrame([(i, x, y, "up" if x > 0 else "down", 3 * x + y) for i, x, y in rows], "k int, x double, y double, band string, total double")
    model, labels = features.train_classifier(df, ["x", "y"], "band")
    got = features.predict_classes(df, model, labels, "band", 2)
    assert got.where("y_Match").count() > 580 and got.where("size(y_Top_Preds) = 2 and y_Top_Preds[0] = y_Pred and abs(y_Probs[0] + y_Probs[1] - 1) < 1e-6").count() == 600
    value = features.predict_values(df, features.train_regressor(df, ["x", "y"], "total"), -100.0, 10.0)
    q = features.regression_quality(value, "total", "y_Pred").first()
    assert q.mae < 2.5 and q.max_pred <= 10.0 and q.variance == "healthy"


def test_recentred_probabilities(spark):
    df = spark.range(5000).select(((F.col("id") % 97 + 1) / 130).alias("p")).unionByName(spark.createDataFrame([(None,)], "p double"))
    out = features.recentre(df, "p", 0.1)
    mean, dev = out.agg(F.avg("Recentred"), F.stddev_pop("Recentred")).first()
    assert mean == pytest.approx(0.5, abs=1e-3) and dev == pytest.approx(0.1, abs=1e-3)
    assert out.where("p is null and Recentred is not null").count() == 0
    order = [x.Recentred for x in out.where("p is not null").distinct().orderBy("p").collect()]
    assert order == sorted(order)


def test_counts_of_more_samples_are_added(spark):
    r = random.Random(3)
    rows = [(d, 1, r.choice("NESW"), r.choice("SH"), r.choice([None, *range(14)])) for d in range(4) for _ in range(120)]
    df = spark.createDataFrame(rows, "deal_id long, Board int, seat string, strain string, tricks int").withColumn("i", F.monotonically_increasing_id())
    parts = [scoring.trick_counts(df.where(F.pmod(F.xxhash64("i"), F.lit(3)) == k)) for k in range(3)]
    key = lambda x: (x.deal_id, x.seat, x.strain, x.trials, x.probs)
    whole = sorted(map(key, scoring.trick_histograms(df).collect()))
    for order in ((0, 1, 2), (2, 0, 1)):
        assert sorted(map(key, scoring.trick_probabilities(scoring.merge_counts(*[parts[k] for k in order])).collect())) == whole
    once = scoring.merge_counts(scoring.merge_counts(parts[0], parts[1]), parts[2])
    assert sorted(map(key, scoring.trick_probabilities(once).collect())) == whole


def test_par_is_folded_once_a_table(spark):
    """Deals that share the sides' tricks, vulnerability and the dealer's side are one row of the fold."""
    cells = [[t % 14 for t in range(k, k + 20)] for k in (1, 4)]
    deals = spark.createDataFrame([(i, b, cells[i % 2]) for i, b in enumerate([1, 1, 3, 3, 2, 2] * 10)], "deal_id long, Board int, cells array<int>")
    out = scoring.par(deals)
    assert out.count() == 60 and out.groupBy("Board", F.col("deal_id") % 2).agg(F.count_distinct("par_score").alias("n")).where("n > 1").count() == 0
    seen, fold = [], scoring.par_of_tables
    try:
        scoring.par_of_tables = lambda t: seen.append(t) or fold(t)
        scoring.par(deals)
    finally:
        scoring.par_of_tables = fold
    assert seen[0].count() == 2 * 3  # boards 1 and 3 differ in vulnerability, 1 and 2 in the dealer too


def test_trick_table_and_theoretical_score_of_a_contract(spark):
    """FIN8 and FIN9 by hand: boards 1 (nobody vulnerable), 2 (North-South) and 4 (both)."""
    cells = [10, 9, 8, 7, 6, 1, 2, 3, 4, 5, 9, 9, 8, 7, 6, 2, 2, 3, 13, 0]  # N, E, S, W by S, H, D, C, N
    deals = spark.createDataFrame([(1, 1, cells), (2, 2, cells), (4, 4, cells)], "deal_id long, Board int, cells array<int>")
    rows = [(1, 1, "4SN"), (1, 1, "4SXS"), (2, 2, "4SS"), (4, 4, "6CW"), (1, 1, "7CXXW"), (1, 1, "1NE"), (1, 1, "PASS"), (1, 1, None), (9, 1, "1CN")]
    df = contracts.dd_score(contracts.join_deals(contracts.split_contract(spark.createDataFrame(rows, "deal_id long, Board int, Contract string")), deals))
    got = {(r.deal_id, r.Contract): (r.DD_Tricks, r.DD_Tricks_Dummy, r.DD_Score_Declarer, r.DD_Score_Max_Declarer, r.DD_Score_NS, r.DD_Score_EW) for r in df.collect()}
    assert got == {
        (1, "4SN"): (10, 9, 420, 420, 420, -420),
        (1, "4SXS"): (9, 10, -100, 140, -100, 100),  # one down, doubled whatever the contract's own doubling; two spades or three would make 140
        (2, "4SS"): (9, 10, -200, 140, -200, 200),  # vulnerable
        (4, "6CW"): (13, 4, 1390, 2140, -1390, 1390),  # a small slam and one over; the grand slam is worth most
        (1, "7CXXW"): (13, 4, 1440, 1440, -1440, 1440),
        (1, "1NE"): (5, 0, -300, -300, 300, -300),
        (1, "PASS"): (None, None, None, None, 0, 0), (1, None): (None, None, None, None, 0, 0), (9, "1CN"): (None, None, None, None, None, None),
    }
