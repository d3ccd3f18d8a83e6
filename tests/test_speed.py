"""Steps that decide whether the queries finish at size."""

import math
import random

from pyspark.sql import functions as F

from tricklake import fixtures, plans
from tricklake.operators import ratings, scoring
from tricklake.sources import records

SF = "/root/testdata/sf0.001"


def test_deals_are_dealt_to_all_tasks(spark):
    ids = fixtures.deal_ids(spark, SF)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ids.select(F.spark_partition_id().alias("p")).distinct().count() == parts
    # groups of a deal are made where its samples are: one exchange, that of the deals
    plan = scoring.trick_counts(fixtures.samples(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_generated_methods_are_compiled(spark):
    plans.QUERIES["sco3_contract_scores"](spark, SF)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_mean_scores_of_odd_rows(spark):
    rnd = random.Random(3)
    rows = [(i, "SHDCN"[i % 5], [rnd.random() for _ in range(14)]) for i in range(40)]
    rows += [(40, "N", None), (41, "S", [None] * 14), (42, "H", [0.5] * 13), (43, "X", [0.0] * 14), (44, "C", [0.0] * 14)]
    df = spark.createDataFrame(rows, "deal_id long, strain string, probs array<double>").repartition(3)
    got = {r.deal_id: r for r in scoring.ev_lists(df).collect()}
    assert 43 not in got and len(got) == 44
    lists = {r.strain: r for r in scoring.score_lists(spark).collect()}
    for i, strain, probs in rows:
        if i == 43:
            continue
        for side in ("nv", "v"):
            if probs is None or len(probs) != 14 or None in probs:
                assert got[i][side] == [None] * 7
            else:
                want = [sum(p * x for p, x in zip(probs, s)) for s in lists[strain][side]]
                assert all(math.isclose(a, b, abs_tol=6e-7) and round(a, 6) == a for a, b in zip(got[i][side], want))


def test_player_ratings_do_not_read_pair_ratings_columns(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ratings, "rate", lambda rows, *_: rows)
    monkeypatch.setattr(ratings, "session_start_end", lambda d, pairs=None, players=None: d.withColumns({f"Elo_{n}_{e}": F.lit(0.0) for n in (("NS", "EW") if pairs is not None else "NESW") for e in ("Start", "End")}))
    monkeypatch.setattr(ratings, "unpivot_pairs", lambda d: d)
    monkeypatch.setattr(ratings, "unpivot_players", lambda d: seen.append(d.columns) or d)
    df = spark.createDataFrame([], "session_id long, section_id long, Board int, Date date, Score_NS int, " + ", ".join(f"Player_ID_{d} string" for d in "NESW"))
    ratings.rating_pipeline(df)
    assert seen and "Pct_NS" in seen[0] and "Elo_NS_Start" not in seen[0]


def test_route_numbers_boards_without_a_second_window(spark):
    # a page's lists of contracts and leads were copied to each of its rows, which grew with the square of the page
    plan = plans.QUERIES["web6_route"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 1 and not any("contracts" in line for line in plan.splitlines()[: plan.splitlines().index(windows[0]) + 2])


def test_quality_reads_the_records_once(spark):
    texts = spark.createDataFrame([("a", "vg|E|qx|o1|md|1|mb|p|"), ("b", None)], "source_file string, value string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    reasons, issues = records.quality(records.parse_records(texts.mapInArrow(counted, texts.schema)))
    assert {(r.reason, r.n) for r in reasons.collect()} == {("error", 1), ("invalid_pbn", 1)}
    assert issues.count() == 3 and read.value == 2


def test_nulls_of_par_are_not_looked_for_below_the_deals(spark):
    # the test for null tables was copied to each result row, with all that makes a table, and each use read the results for itself
    plan = plans.QUERIES["fin11_roles"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("array_join" in line for line in plan.splitlines() if "Filter" in line)
    df = spark.createDataFrame([(1, 1), (2, None), (None, 3), (4, 3)], "deal_id long, Board int")
    cells = fixtures.trick_cells(df).withColumn("other", F.lit("x"))
    got = scoring.par(cells)
    assert got.columns == ["deal_id", "Board", "cells", "other", "par_score", "contracts"]
    assert {(r.deal_id, r.Board) for r in got.collect()} == {(1, 1), (None, 3), (4, 3)}
