"""Game records are read in batches."""

import re

import numpy as np
import pyarrow as pa

from tricklake import plans
from tricklake.sources import records as R

SF = "/root/testdata/sf0.001"


def test_boards_of_a_file_meet_before_they_are_shuffled(spark):
    # a file's boards are dealt together by number, so that its texts leave their task as one row
    plan = plans.QUERIES["src6_game_records"](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    exchanges = [line for line in plan if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and all("hashpartitioning(file#" in line for line in exchanges) and any("MapInArrow" in line for line in plan)


def test_no_lambda_runs_for_a_card_or_field(spark):
    texts = spark.createDataFrame([("f", "")], "source_file string, value string")
    plan = R.parse_records(texts)._jdf.queryExecution().optimizedPlan().toString()
    # lambdas are left for calls alone, some ten a board
    over = set(re.findall(r"(?:transform|filter|exists|forall|aggregate)\(([a-z_]+)#", plan))
    assert over == {"calls", "said"}


def test_chunks_do_not_change_rows(spark, monkeypatch):
    boards = "".join(f"qx|o{i}|md|{i % 4 + 1}SAK,HQ|sv|o|mb|1C!|an|x{i}|mb|p|pc|SA|pc|zz|" for i in range(1, 4))
    files = [("a", boards), ("b", None), ("c", "||x|"), ("d", "pn|S,W,N,E|vg|E,1|" + boards.replace("qx|", "zz|")), ("e", boards + "pc|H2")]
    rows = lambda a, b: R._fields(pa.array([f for f, _ in files[a:b]]), pa.array([t for _, t in files[a:b]], pa.string())).to_pylist()
    whole = sorted(rows(0, 5), key=str)
    assert whole == sorted(sum((rows(i, i + 1) for i in range(5)), []), key=str)
    assert [r["board"] for r in whole if r["source_file"] == "e"] == [0, 1, 2] and sum(r["board"] is None for r in whole) == 2
    assert [r["told"] for r in whole if r["source_file"] == "d"] == [[f"x{i}", None] for i in range(1, 4)] and all(r["cards"] == [0, None] for r in whole if r["board"] is not None)


def test_winners():
    four = np.array([[0, 12, 13, 5], [51, 0, 40, 39], [3, 2, 1, 15]], np.int16)
    assert R.winners(four, np.array([4, 3, 1])).tolist() == [0, 3, 3]
