"""Tables changed in place: touched buckets, lost runs, bins."""

import random

import pytest
from pyspark.sql import functions as F

from tricklake.sources import tables
from tricklake.sources.stored import StoredTable

SCHEMA = "PBN string, Dealer string, par int, trials int"


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(f"d{i}", r, i, i % 7) for i in range(60) for r in "NE"]
    return StoredTable(spark, f"file://{tmp_path}/t").create(spark.createDataFrame(rows, SCHEMA), ["PBN", "Dealer"], 8), spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.select(*SCHEMA.replace(" string", "").replace(" int", "").split(", ")).collect()), key=str)


def test_untouched_files_keep_their_names(spark, stored):
    t, frame = stored
    assert rows(t.read()) == rows(frame)
    new = spark.createDataFrame([("d3", "N", 100), ("d3", "S", None), ("x1", "N", 5)], "PBN string, Dealer string, par int")
    before = t.files()
    touched = t.upsert(new)
    assert touched <= 2 and rows(t.read()) == rows(tables.upsert(frame, new, ["PBN", "Dealer"]))
    kept = before & t.files()
    assert {f.split("_bucket=")[1].split("/")[0] for f in before - kept} == {f.split("_bucket=")[1].split("/")[0] for f in t.files() - kept} and len(kept) >= len(before) - 2 * touched
    assert t.version() == 1 and t.upsert(new.limit(0)) == 0 and t.version() == 1


def test_a_lost_run_leaves_the_old_table(spark, stored, monkeypatch):
    t, frame = stored
    new = spark.createDataFrame([(f"d{i}", "N", -1) for i in range(60)], "PBN string, Dealer string, par int")

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(StoredTable, "_commit", lost)
        with pytest.raises(KeyboardInterrupt):
            t.upsert(new)
    assert rows(t.read()) == rows(frame) and t.version() == 0
    assert t.vacuum() == 1 and rows(t.read()) == rows(frame)
    t.upsert(new)
    assert t.vacuum() >= 1 and rows(t.read()) == rows(tables.upsert(frame, new, ["PBN", "Dealer"]))


def test_two_runs_at_once(spark, stored):
    t, frame = stored
    new = spark.createDataFrame([("d1", "N", 7)], "PBN string, Dealer string, par int")

    def slow(old):
        StoredTable(spark, t.path).upsert(new)  # another run is done first
        return old

    with pytest.raises(RuntimeError):
        t.change(new, slow)
    assert rows(t.read()) == rows(tables.upsert(frame, new, ["PBN", "Dealer"]))
    with pytest.raises(FileExistsError):
        t.create(frame, ["PBN"])
    with pytest.raises(TypeError):
        t.change(new, lambda old: old.withColumn("par", F.lit("x")))


def test_null_keys(spark, tmp_path):
    rows_ = [(f"d{i}", None if i % 3 else "N", i, 1) for i in range(30)]
    frame = spark.createDataFrame(rows_, SCHEMA)
    t = StoredTable(spark, f"file://{tmp_path}/t").create(frame, ["PBN", "Dealer"], 4)
    wanted = spark.createDataFrame([("d1", "N"), ("d1", "S"), ("d4", "E"), ("d99", "N")], "PBN string, Dealer string")
    t.migrate_null_keys(wanted)
    assert rows(t.read()) == rows(tables.migrate_null_keys(frame, wanted, "PBN", ["Dealer"]))


def test_parts_and_bins(spark, stored):
    t, frame = stored
    r = random.Random(1)
    more = [spark.createDataFrame([(f"e{r.randrange(99)}", "W", k, k, f"x{k}") for _ in range(20)], SCHEMA + ", note string") for k in range(5)]
    for df in more:
        t.append(df)
    whole = rows(t.read())
    assert len(whole) == 220 and t.read().where("note is not null").count() == 100
    files = t.files()
    assert t.compact(most_bytes=1) == 0 and t.files() == files  # none is smaller
    size = {n: s for fs in t.manifest()["files"].values() for n, s in fs}
    done = t.compact(most_bytes=3 * max(size.values()))
    assert 0 < done <= len(files) and len(t.files()) < len(files) - done / 2 and rows(t.read()) == whole
    assert len(files & t.files()) == len(files) - done
    t.compact(valid=F.col("par") % 2 == 0)
    assert rows(t.read()) == [x for x in whole if x[2] % 2 == 0]
    with pytest.raises(TypeError):
        t.append(frame.withColumn("par", F.lit("text")))


def test_empty_table(spark, tmp_path):
    t = StoredTable(spark, f"file://{tmp_path}/t").create(spark.createDataFrame([], SCHEMA), ["PBN", "Dealer"])
    assert t.read().count() == 0 and t.compact() == 0 and t.files() == set()
    t.append(spark.createDataFrame([("a", None, 1, 2)], SCHEMA))
    assert rows(t.read()) == [("a", None, 1, 2)]
    with pytest.raises(FileNotFoundError):
        StoredTable(spark, f"file://{tmp_path}/none").read()
