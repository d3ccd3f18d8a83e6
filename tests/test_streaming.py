import datetime

from tricklake.operators import matchpoints as M
from tricklake.streaming import standings as S


def day(i):
    return datetime.date(2024, 1, i)


def rows(n, d, board=1):
    return [(1, 0, board, day(d), s, i, i + 1) for i, s in enumerate(range(0, 50 * n, 50))]


def put(spark, data, path):
    spark.createDataFrame(data, S.RESULTS).coalesce(1).write.mode("append").parquet(path)


def test_running_standings(spark, tmp_path):
    """A batch writes the boards that it touches alone; every board's last table is that of all its results."""
    src, out, cp = (f"file://{tmp_path}/{x}" for x in ("in", "out", "cp"))
    put(spark, rows(4, 1) + rows(3, 1, 2) + rows(2, 1, 3), src)
    S.keep_standings(S.results_stream(spark, src), out, cp).awaitTermination(120)
    put(spark, rows(6, 2) + [(1, 0, 2, day(2), None, 1, 2)], src)
    S.keep_standings(S.results_stream(spark, src), out, cp).awaitTermination(120)
    put(spark, rows(1, 3, 4) + rows(5, 3, 2), src)
    S.keep_standings(S.results_stream(spark, src), out, cp).awaitTermination(120)
    boards = lambda n: {x.Board for x in spark.read.parquet(f"{out}/b={n}").collect()}
    assert [boards(n) for n in range(3)] == [{1, 2, 3}, {1}, {2, 4}]
    want = M.score_frequencies(M.frequencies(spark.read.parquet(src))).select("Board", "score", "n", "mp", "pct")
    assert sorted(map(tuple, S.latest_standings(spark, out).select("Board", "score", "n", "mp", "pct").collect())) == sorted(map(tuple, want.collect()))


def test_late_sessions_are_kept_apart(spark, tmp_path):
    src, out, late, cp = (f"file://{tmp_path}/{x}" for x in ("in", "out", "late", "cp"))
    put(spark, rows(3, 5), src)
    S.split_late(S.results_stream(spark, src), out, late, cp).awaitTermination(120)
    put(spark, rows(2, 3) + rows(1, 9), src)
    S.split_late(S.results_stream(spark, src), out, late, cp).awaitTermination(120)
    assert spark.read.parquet(late).count() == 2 and spark.read.parquet(out).count() == 4


def test_record_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    src, out, bad, cp = (f"file://{tmp_path}/{x}" for x in ("in", "out", "bad", "cp"))
    passed = "mb|p|mb|p|mb|p|mb|p|"
    (tmp_path / "in" / "a.lin").write_text(f"md|1SAK,HAK,DAK,CAK|sv|o|ah|Board 3|{passed}")
    S.ingest_records(spark, src, out, bad, cp).awaitTermination(120)
    (tmp_path / "in" / "b.lin").write_text(f"md|2SAK,HAK,DAK,CAK|sv|b|ah|Board 4|{passed}md|2SAK,HAK,DAK,CAK|{passed}")
    (tmp_path / "in" / "c.lin").write_bytes(b"\xff\xff md|1|")
    S.ingest_records(spark, src, out, bad, cp).awaitTermination(120)
    assert sorted((r.board_num, r.dealer, r.contract, r.b) for r in spark.read.parquet(out).collect()) == [(3, "S", "PASS", 0), (4, "W", "PASS", 1)]
    assert sorted(r.reason for r in spark.read.parquet(bad).collect()) == ["error", "null_vulnerability"]
