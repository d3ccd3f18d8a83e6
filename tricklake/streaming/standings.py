"""Streaming forms: file streams of results, running standings, late sessions, incremental record ingest."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import matchpoints as M
from ..operators import ratings
from ..sources import records as R

RESULTS = "session_id long, section_id long, Board int, Date date, Score_NS int, Pair_Number_NS int, Pair_Number_EW int"


def results_stream(spark: SparkSession, path: str, schema: str = RESULTS) -> DataFrame:
    """Board results as their files arrive."""
    return spark.readStream.schema(schema).parquet(path)


def running_frequencies(stream: DataFrame) -> DataFrame:
    """(board, score, n) of the boards that a batch touches, with all scores that they ever had; the state of a board is one count for each of its scores."""
    kinds = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in M.BOARD)

    def add(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts = Counter(dict(zip(*state.get))) if state.exists else Counter()
        for part in parts:
            counts.update(Counter(part["Score_NS"].astype("int64").tolist()))
        scores = sorted(counts)
        state.update((scores, [counts[s] for s in scores]))
        yield pd.DataFrame(dict(zip(M.BOARD, key)) | {"score": scores, "n": [counts[s] for s in scores]})

    rows = stream.where("Score_NS is not null").select(*M.BOARD, "Score_NS")
    return rows.groupBy(*M.BOARD).applyInPandasWithState(add, f"{kinds}, score int, n long", "scores array<int>, counts array<long>", "update", GroupStateTimeout.NoTimeout)


def keep_standings(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Boards touched by a batch get their matchpoint table again, and no others; each batch writes its own folder below target, so a replay overwrites it.

    The latest batch of a board holds its standings: latest_standings reads them.
    """

    def write(batch: DataFrame, number: int) -> None:
        M.score_frequencies(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/b={number}")

    return running_frequencies(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_standings(spark: SparkSession, target: str) -> DataFrame:
    """The matchpoint tables of all boards as of the last batch that touched each."""
    every = spark.read.parquet(target).drop("b")
    last = every.groupBy(*M.BOARD).agg(F.max("batch").alias("batch"))
    return every.join(last, [*M.BOARD, "batch"])


def split_late(stream: DataFrame, target: str, late: str, checkpoint: str) -> StreamingQuery:
    """Rating input in order of Date: a batch's sessions older than the last committed date go to late, to be replayed in batch, the others to target."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        jvm = spark._jvm.org.apache.hadoop.fs.Path(target)
        there = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
        done = spark.read.parquet(target).where(F.col("b") < number).agg(F.max("Date")).first()[0] if there else None
        cut = F.lit(done).cast(T.DateType())
        on_time = F.lit(True) if done is None else F.col("Date") >= cut
        batch.where(~on_time).write.mode("overwrite").parquet(f"{late}/b={number}")
        batch.where(on_time).write.mode("overwrite").parquet(f"{target}/b={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_ratings(stream: DataFrame, unpivot, store: str, checkpoint: str) -> StreamingQuery:
    """Ratings of a stream of board results with Pct_NS, kept in a store; late sessions are put in their place and what follows from them is rated again."""

    def write(batch: DataFrame, number: int) -> None:
        ratings.rate_batch(unpivot(batch), store, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_records(spark: SparkSession, path: str, target: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Game-record files, whole, as they arrive: valid boards to target, the others and files that cannot be read to rejected with the reason.

    The checkpoint remembers which files are done; a batch writes its own folders, so a replay overwrites them.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = R.parse_records(batch)
        R.valid_records(rows).write.mode("overwrite").parquet(f"{target}/b={number}")
        R.quarantined(rows).write.mode("overwrite").parquet(f"{rejected}/b={number}")

    texts = R.read_record_files(spark, path, stream=True)
    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
