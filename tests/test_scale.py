"""What keeps large inputs within a driver's and a task's bounds, on small ones."""

from pyspark.sql import functions as F

from tricklake import fixtures as X
from tricklake.functions import bridge as B
from tricklake.operators import bidding as R
from tricklake.operators import deals as D
from tricklake.sources import elements as E


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_deal_texts_against_plain_python(spark):
    def plain(n):
        order = sorted(range(52), key=lambda i: (i + 1) * (1 + (n * 7919 + 13) % 10006) % 10007)
        hands = [sorted(order[13 * s : 13 * s + 13]) for s in range(4)]
        return "N:" + " ".join(".".join("".join(B.RANKS[c % 13] for c in h if c // 13 == u) for u in range(4)) for h in hands)

    ids = [0, 1, 7, 10005, 10006, 123456, 2**40]
    df = X.with_pbn(spark.createDataFrame([(i,) for i in ids] + [(None,)], "deal_id long"))
    assert dict(df.select("deal_id", "PBN").collect()) == {i: plain(i) for i in ids} | {None: None}
    assert "ArrowEvalPython" in _plan(df)


def test_balanced_of_every_shape(spark):
    shapes = [(a, b, c, 13 - a - b - c) for a in range(14) for b in range(14 - a) for c in range(14 - a - b)]
    df = spark.createDataFrame([(list(s), ["2" * n for n in s]) for s in shapes], "n array<int>, h array<string>").select("n", D.balanced(F.col("h")).alias("b"))
    for n, b in df.collect():
        text = "".join(map(str, sorted(n, reverse=True)))
        assert b == (text in ("4333", "4432") or (text in ("5332", "5422") and 5 in n[2:])), n


def test_rows_of_deals_are_not_broadcast(spark):
    rules = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "rule_id int, parent int")
    holds = spark.createDataFrame([(d, "N", r) for d in range(9) for r in (1, 2, 3) if (d + r) % 4], "deal_id long, seat string, rule_id int")
    out = R.hold_with_ancestors(holds, rules)
    assert "SortMergeJoin" in _plan(out) and "BroadcastHashJoin" not in _plan(out)
    have = {(d, r) for d in range(9) for r in (1, 2, 3) if (d + r) % 4}
    assert {(r.deal_id, r.rule_id) for r in out.collect()} == {(d, r) for d, r in have if all((d, x) in have for x in range(1, r + 1))}
    # the book goes to the rows, not the rows to the book
    assert "BuildRight" in _plan(R._with_rules(holds, rules))


def test_fingerprint_sees_where_nulls_stand(spark):
    of = lambda *rows: R.fingerprint(spark.createDataFrame(list(rows), "a string, b string, c array<int>"))
    assert len({of(("x", None, [1])), of((None, "x", [1])), of(("x", None, None)), of(("x", None, [1, None])), of(("x", None, [None, 1]))}) == 5
    assert of(("x", "y", [1]), ("z", None, None)) == of(("z", None, None), ("x", "y", [1]))


def test_small_pages_share_batches(spark):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("<p>"), F.col("id").cast("string"), F.repeat(F.lit("<b>x</b>"), 40), F.lit("</p>"))).alias("html")).coalesce(1)
    got = E.elements(pages)
    assert got.count() == 240 * 41
    assert {r.page_id: r.text[: len(str(r.page_id))] for r in got.where("tag = 'p'").collect()} == {i: str(i) for i in range(300) if i % 5}


def test_total_tricks_broadcast_no_rows_of_deals(spark):
    sf = "/root/testdata/sf0.001"
    lengths = D.suits_long(X.deals(spark, sf)).groupBy("deal_id", B.side_of(F.col("seat")).alias("side"), "suit").agg(F.sum(F.length("cards")).cast("int").alias("length"))
    plan = _plan(D.total_tricks(X.dd_long(spark, sf), lengths))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_shared_auctions_are_analysed_once(spark):
    auctions = [("N", "1S-p-2S-p-p-p"), ("E", "1S-p-2S-p-p-p"), ("N", "p-p-p-p"), ("S", "1N-p-p-p"), ("S", "1N-p"), (None, "1N-p"), ("W", "1N-1C-p-p-p")]
    text = "deal_id long, Dealer string, t string"
    rows = spark.createDataFrame([(i, *auctions[i % 7]) for i in range(700)] + [(700, "N", None)], text).select("deal_id", "Dealer", F.split("t", "-").alias("auction"))
    shared, each = R.with_analysis(rows), R.with_analysis(rows, most=7)
    by_row = rows.withColumn("x", R.analyse(F.col("auction"), F.col("Dealer")))
    own = lambda df: sorted((x.asDict(recursive=True) for x in df.collect()), key=lambda x: x["deal_id"])
    assert own(shared) == own(each) == own(by_row)
    # eight different auctions: one more than the second call's bound
    assert "BroadcastHashJoin" in _plan(shared) and "Join" not in _plan(each)
