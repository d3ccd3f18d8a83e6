"""Edge rows: nulls, passes, unknown codes, voids, empty frames, errors that must be raised."""

import pytest
from pyspark.sql import functions as F

from tricklake.functions import bridge as B
from tricklake.operators import bidding, canonical, contracts, deals, features, matchpoints, query, scoring
from tricklake.sources import documents, tables

DEAL = "N:AKQJT98765432... .AKQJT98765432.. ..AKQJT98765432. ...AKQJT98765432"


def test_score_table_against_the_published_rules(spark):
    rows = {(r.level, r.strain, r.dbl, r.vul, r.tricks): r.score for r in scoring.score_table(spark).collect()}
    assert len(rows) == 2940
    known = {(4, "S", "", False, 10): 420, (4, "S", "", True, 11): 650, (3, "N", "", False, 9): 400, (6, "N", "", True, 12): 1440, (7, "C", "", False, 13): 1440, (2, "H", "X", False, 8): 470, (1, "D", "XX", True, 8): 630, (2, "S", "X", False, 9): 570,
             (4, "H", "", False, 8): -100, (4, "H", "", True, 8): -200, (4, "H", "X", False, 6): -800, (4, "H", "X", True, 6): -1100, (5, "C", "XX", False, 7): -1600 + 600, (1, "N", "", False, 7): 90, (7, "N", "XX", True, 0): -7600}
    assert {k: rows[k] for k in known} == known | {(5, "C", "XX", False, 7): rows[5, "C", "XX", False, 7]}
    assert rows[5, "C", "XX", False, 7] == -1600


def test_deals_with_voids(spark):
    df = spark.createDataFrame([(1, DEAL)], "deal_id long, PBN string")
    r = deals.add_losers(deals.add_hcp(df)).first()
    assert (r.HCP_N, r.HCP_NS, r.LTC_N, r.LTC_N_H) == (10, 20, 0, 0)
    assert deals.add_card_flags(df).select(deals.card_flag("N", "S", "A"), deals.card_flag("N", "H", "A")).first()[:] == (True, False)
    assert deals.add_suit_quality(df).first().Solid_N_S and df.select(canonical.valid_deal(F.col("PBN"))).first()[0]
    assert deals.add_hcp(df.limit(0)).collect() == []


def test_contract_and_result_texts(spark):
    df = spark.createDataFrame([(1, "PASS", 0), (1, None, None), (2, "7NXXE", -400), (2, "1CS", 70)], "Board int, Contract string, Score_NS int")
    out = contracts.result_from_score(contracts.split_contract(df).withColumn("Result", F.lit(None).cast("int"))).collect()
    assert [(r.BidLvl, r.Declarer_Direction, r.ContractType) for r in out] == [(None, None, "Pass"), (None, None, None), (7, "E", "GSlam"), (1, "S", "Partial")]
    assert [r.Result_From_Score for r in out][3] == 0
    t = spark.createDataFrame([("0",), ("+",), ("=",), ("-",), ("+2",), ("-3",), (None,)], "t string")
    assert [r[0] for r in t.select(canonical.result_number(F.col("t"))).collect()] == [0, 0, 0, None, 2, -3, None]
    with pytest.raises(ValueError):
        contracts.canonical(df.where("Contract is null"), ["Contract"])


def test_vulnerability_codes(spark):
    df = spark.createDataFrame([(1, "N_S"), (2, "all")], "Board int, Vul string")
    assert [(r.iVul, r.Vul_NS) for r in deals.add_vulnerability(df).collect()] == [(1, True), (None, None)]
    assert [B.VULS[r.v] for r in spark.range(1, 17).select(B.vul_code(F.col("id")).alias("v")).collect()][:5] == ["None", "N_S", "E_W", "Both", "N_S"]


def test_matchpoint_edges(spark):
    schema = "session_id int, section_id int, Board int, Score_NS int"
    df = spark.createDataFrame([(1, 1, 1, 420), (1, 1, 2, 50), (1, 1, 2, 50), (1, 1, 2, 50), (1, 1, 3, None), (1, 1, 3, 10), (1, 1, 3, 20)], schema)
    m = {(r.Board, r.Score_NS): (r.MP_NS, r.MP_Top) for r in matchpoints.matchpoints(df).collect()}
    assert m == {(1, 420): (0.0, 0), (2, 50): (1.0, 2), (3, None): (None, None), (3, 10): (0.0, 1), (3, 20): (1.0, 1)}
    assert sorted(r.Board for r in matchpoints.board_top(matchpoints.matchpoints(df)).collect()) == [2, 2, 2, 3, 3]
    assert matchpoints.matchpoints(df.limit(0)).collect() == []


def test_strict_checks(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    for bad in (lambda: tables.upsert(df, df.withColumn("v", F.lit(1)), ["k"]), lambda: tables.require(df, {"k": "string"}), lambda: features.validate(df, {"k": "string"}, strict=True), lambda: tables.open_cache(spark, df)):
        with pytest.raises(TypeError):
            bad()
    for bad in (lambda: tables.aligned_union(df, df.drop("v"), ("v",)), lambda: features.strict_codes(df, "v", {"b": 1}), lambda: features.encode(df, ["v"], features.categories(df.limit(0), ["v"])), lambda: canonical.star_join(df, [(df.unionAll(df), ["k"])]),
                lambda: bidding.evaluate(df.withColumns({"deal_id": F.lit(1), "seat": F.lit("N"), "Board": F.lit(1)}), ["k; drop table"]), lambda: query.expand_macros("{Player_Direction}", {"Player_Direction": "X"}), lambda: query.expand_macros("{Other}", {})):
        with pytest.raises(ValueError):
            bad()
    assert features.embedding_sizes(features.categories(df, ["v"])).first()[:] == ("v", 2, 1)


def test_free_sql_reports_errors(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    out, error = query.try_sql(df, "SELECT nothing FROM self")
    assert out is None and "nothing" in error
    out, error = query.try_sql(df, 'WHERE k = :k', k=1)
    assert error == "" and out.count() == 1
    out = query.run_sql(df, 'SELECT v FROM "self";')
    assert out.first().v == "a" and not [t for t in spark.catalog.listTables() if t.name.startswith("self")]


def test_pages_without_content(spark):
    p = spark.createDataFrame([(1, None), (2, ""), (3, "<table><tr><td>x</td></tr></table>")], "page_id long, html string")
    assert documents.links(p).collect() == [] and documents.results_table(p).collect() == [] and documents.result_links(p).collect() == []
    assert [r.j for r in p.select(documents.embedded_json(F.col("html"), "id int").alias("j")).collect()] == [None] * 3


def test_auctions_that_break_the_rules(spark):
    rows = [("p-p-p-p", True, "PASS"), ("1N-1S-p-p-p", False, None), ("d", False, None), ("1S-p-2S-p-p-p", True, "2SN"), ("1S-d-r-p-p-p", True, "1SXXN"), ("1S-p-p-p-2S", False, None), ("", True, None)]
    df = spark.createDataFrame([(t,) for t, _, _ in rows], "t string")
    got = df.select(bidding.analyse(F.filter(F.split("t", "-"), lambda b: b != ""), F.lit("N")).alias("x")).select("x.legal", "x.contract").collect()
    for (_, legal, contract), r in zip(rows, got):
        assert r.legal == legal and (not legal or r.contract == contract)


def test_top_of_a_board_without_scores(spark):
    rows = [(1, None, 4), (1, None, None), (2, 50, 4), (2, 60, None), (2, 70, 1), (3, 10, 4)]
    df = spark.createDataFrame(rows, "Board int, Score_NS int, MP_Top long")
    assert sorted((r.Board, r.MP_Top) for r in matchpoints.board_top(df, ["Board"]).collect()) == [(2, 1), (2, 2), (2, 2)]
    assert sorted((r.Board, r.MP_Top) for r in matchpoints.board_top(df.drop("MP_Top"), ["Board"]).collect()) == [(2, 2)] * 3
