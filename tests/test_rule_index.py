"""Packed predicates, the trie of rules and the rule tree against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tricklake.operators import bidding as R


def book(r, n, predicates):
    """Rules with shared beginnings, some without requirements, some equal."""
    rules = []
    for i in range(1, n + 1):
        base = r.choice(rules)[1][: r.randint(0, 3)] if rules and r.random() < 0.6 else []
        rules.append((i, base + [r.randint(1, predicates) for _ in range(r.randint(0, 4))]))
    return rules


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(5)
    n = 150  # three words
    rules = book(r, 60, n)
    truth = [(d, s, d % 36, [r.random() < 0.8 for _ in range(n)]) for d in range(40) for s in "NESW"]
    df = spark.createDataFrame(truth, "deal_id long, seat string, Board int, truth array<boolean>")
    needs = spark.createDataFrame([(i, p) for i, ps in rules for p in sorted(set(ps))], "rule_id int, predicate_id int")
    held = {(d, s, i) for d, s, _, t in truth for i, ps in rules if all(t[p - 1] for p in ps)}
    return truth, df, needs, spark.createDataFrame([(i,) for i, _ in rules], "rule_id int"), held, rules


def test_packing(data):
    truth, df, *_ = data
    packed = R.pack(df)
    assert all(len(x.words) == 3 for x in packed.collect())
    assert {(x.deal_id, x.seat, x.predicate_id) for x in R.bitmap(packed).collect()} == {(d, s, i + 1) for d, s, _, t in truth for i, v in enumerate(t) if v}
    none = df.withColumn("truth", F.array().cast("array<boolean>"))
    assert R.bitmap(R.pack(none)).count() == 0


@pytest.mark.parametrize("most", [10_000, 3])
def test_rules_that_hold(data, most):
    """Through the trie and, for a book that is too large for it, by division."""
    _, df, needs, rules, held, _ = data
    got = [tuple(x) for x in R.rules_that_hold(R.pack(df), needs, rules, most).collect()]
    assert len(got) == len(held) and set(got) == held
    opening = rules.where("rule_id % 2 = 0")
    lists = {(x.deal_id, x.seat): x.rules for x in R.candidates(R.pack(df), needs, opening, most).collect()}
    assert len(lists) == 160 and all(lists[d, s] == sorted(i for a, b, i in held if (a, b) == (d, s) and i % 2 == 0) for d, s in lists)


def test_deals_are_not_shuffled_for_a_book(data):
    _, df, needs, rules, *_ = data
    for out in (R.rules_that_hold(R.pack(df), needs, rules), R.candidates(R.pack(df), needs, rules)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_trie_shares_beginnings():
    trie = R.requirement_trie([(1, [3, 1]), (2, [1, 3, 2]), (3, [1]), (4, []), (5, [1, 3])])
    assert trie["rules"] == [4] and set(trie) == {"rules", 1} and trie[1]["rules"] == [3] and trie[1][3]["rules"] == [1, 5] and trie[1][3][2]["rules"] == [2]


@pytest.mark.parametrize("kind", ["chain", "bush"])
def test_tree(spark, kind):
    r = random.Random(9)
    parent = {i: i - 1 if kind == "chain" else r.choice((0, 500, *range(max(1, i - 6), i))) for i in range(1, 121)}  # 500 is no rule
    rules = spark.createDataFrame([(i, p, "1C") for i, p in parent.items()], "rule_id int, parent int, bid string")

    def way(i):
        out = []
        while i in parent:
            out.append(i)
            i = parent[i]
        return out

    got = [tuple(x) for x in R.with_ancestors(rules).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, a) for i in parent for a in way(i)}
    held = {(d, s, i) for d in range(6) for s in "NE" for i in parent if r.random() < (0.99 if d else 1)}
    holds = spark.createDataFrame(sorted(held), "deal_id long, seat string, rule_id int")
    want = {(d, s, i) for d, s, i in held if all((d, s, a) in held for a in way(i))}
    have = [tuple(x) for x in R.hold_with_ancestors(holds, rules).collect()]
    assert len(have) == len(want) and set(have) == want and {x[2] for x in have if x[0] == 0} == set(parent)
    assert R.check_tree(rules) <= 8


@pytest.mark.parametrize("rows", [[(1, 1)], [(1, 2), (2, 1)], [(1, 0), (2, 4), (3, 2), (4, 3), (5, 4)]])
def test_circles_are_errors(spark, rows):
    rules = spark.createDataFrame([(i, p, "1C") for i, p in rows], "rule_id int, parent int, bid string")
    holds = spark.createDataFrame([(1, "N", 1)], "deal_id long, seat string, rule_id int")
    for bad in (lambda: R.with_ancestors(rules), lambda: R.hold_with_ancestors(holds, rules), lambda: R.check_tree(rules), lambda: R.auctions(holds.withColumn("Board", F.lit(1)), holds, rules, "file:///tmp/none")):
        with pytest.raises(ValueError):
            bad()


def test_no_rules(spark):
    rules = spark.createDataFrame([], "rule_id int, parent int, bid string")
    holds = spark.createDataFrame([], "deal_id long, seat string, rule_id int")
    assert R.with_ancestors(rules).collect() == [] and R.hold_with_ancestors(holds, rules).collect() == []


def test_predicates_go_straight_to_bits(spark):
    # packing an array, and reading places out of words, called a function for each predicate of each row
    features = spark.createDataFrame([(d, s, 1, d if d % 5 else None, d % 3 == 0) for d in range(30) for s in "NE"], "deal_id long, seat string, Board int, HCP int, Balanced boolean")
    assert R.bitmap(R.evaluate_packed(features, [])).count() == 0
    for n in (1, 63, 64, 65):
        predicates = [("Balanced", "No_Such >= 1", f"HCP >= {i // 5}", f"HCP == {i % 30}", "HCP >= 0")[i % 5] for i in range(n)]
        long_way = R.pack(R.evaluate(features, predicates))
        packed = R.evaluate_packed(features, predicates)
        assert packed.dtypes == long_way.dtypes and sorted(map(str, packed.collect())) == sorted(map(str, long_way.collect()))
        held = {(x.deal_id, x.seat, i) for x in R.evaluate(features, predicates).collect() for i, t in enumerate(x.truth, 1) if t}
        got = [tuple(x) for x in R.bitmap(packed).collect()]
        assert len(got) == len(held) and set(got) == held
    plan = R.bitmap(packed)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
