"""From raw documents to encoded training text: five stages, each one operator over all that the stage before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. run() applies them to the documents, writing each stage's result to the shared folder and removing it once the next stage is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tricklake.llm.common import discard, table, written
from tricklake.llm.curriculum import mix, schedule
from tricklake.llm.line_dedup import line_dedup
from tricklake.llm.minhash_dedup import near_duplicates
from tricklake.llm.piece_codec import encoded
from tricklake.llm.toxicity import fit_model, toxic_score

REJECT = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is REJECT or more go; the model learns from the labels of the documents given.

    Null and empty texts have the score of a text without hits, null doc_ids are scored like others, repeated rows share their fate, a score of REJECT itself goes. An empty table gives no rows.
    """
    model = fit_model(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxic_score(F.col("text"), model) < REJECT)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts; n_chars follows. Documents stay, even if all their lines went.

    Null texts stay null with a null n_chars, null doc_ids count as last, rows that repeat doc_id and text are one document, of equal runs that of the smaller doc_id stays. An empty table gives no rows.
    """
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the document of smallest id stays.

    Texts that are null or without words and null doc_ids are in no group and stay; rows that repeat a doc_id stay or go together. An empty table gives no rows.
    """
    gone = near_duplicates(docs, k=5, num=80, den=100).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each reading that the curriculum makes of a document, in training order; a document may be read twice or not at all.

    Documents without words are not read. A null source is a source like others, the last; null doc_ids count as one id; repeated rows are read each. An empty table gives no rows.
    """
    return schedule(mix(docs)).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every reading's text.

    Null texts have null ids, empty ones none; each row is encoded for itself, repeated or not. An empty table gives no rows.
    """
    return encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode_pieces),
]

#: Fitted scores, similarity on sets and Viterbi are not for SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
