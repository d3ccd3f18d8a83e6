"""Substring dedup by a log-structured fingerprint index.

Each 50-word window is represented by the least hash among the short shingles it
holds (its fingerprint), so equal windows have equal fingerprints and a stretch of
neighbouring windows shares one. The index is a list of immutable runs, bucketed
and sorted by fingerprint, with the smallest document of each. A batch becomes a run and is merge-joined with every older run (no shuffle
of the runs); runs are compacted when there are many. What the merges find is verified: the windows below shared fingerprints
are compared by two independent 64-bit digests of all their words. The index holds no words; verification reads the
texts of those documents, old and new, that hold a shared fingerprint, once for all batches of a call.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import remove
from .common import WordIds, discard, run_hashes, scratch, sliding_min, table, word_ids, written

WINDOW, SHINGLE = 50, 16
#: Batches that a corpus is taken in, runs that may stand side by side, pending rows of one fingerprint that one task may take.
BATCHES, MOST_RUNS, HOT_ROWS = 4, 2, 5000


def _fingerprints(ids: np.ndarray, window: int, shingle: int) -> np.ndarray:
    """The fingerprint of each window of the document."""
    return sliding_min(run_hashes(ids, shingle), window - shingle + 1).view(np.int64)


def fingerprint_rows(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Rows (fp, doc_id): the distinct window fingerprints of each document. Null texts, null ids and short texts give none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordIds()
        for batch in batches:
            fps, owners = [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                words = text.encode().split()
                if len(words) >= window:
                    m = _fingerprints(word_ids(words, memo), window, shingle)
                    fps.append(m := np.unique(m))
                    owners.append(np.full(len(m), doc, np.int64))
            if fps:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fps)), pa.array(np.concatenate(owners))], ["fp", "doc_id"])

    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(rows, "fp long, doc_id long")


class FingerprintIndex:
    """Sorted immutable runs (fp, lo, hi) in the shared folder, lo and hi being the smallest and largest doc_id of the run; all have the same buckets, so merging them needs no shuffle."""

    def __init__(self, spark: SparkSession, buckets: int, most_runs: int = MOST_RUNS):
        self.spark, self.buckets, self.most_runs = spark, buckets, most_runs
        self.folder = scratch(spark, "fingerprint-index")
        self.runs: list[str] = []
        self.compactions = 0

    def _write(self, rows: DataFrame) -> str:
        name = f"fingerprint_run_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "fp").write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def merge(self, batch: DataFrame) -> DataFrame:
        """Add a batch of rows (fp, doc_id) as a run and merge it with each older run; rows (fp) found in several documents, at least one of them new.

        A fingerprint that very many documents hold is one row a run, aggregated before the shuffle.
        """
        name = self._write(batch.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")))
        new = self.spark.table(name)
        found = new.where("lo < hi").select("fp")
        for old in self.runs:
            both = new.alias("n").join(self.spark.table(old).alias("o"), "fp")
            found = found.unionByName(both.where("least(n.lo, o.lo) < greatest(n.hi, o.hi)").select("fp"))
        self.runs.append(name)
        found = written(found.distinct(), "shared-fps")
        self._compact()
        return found

    def _compact(self) -> None:
        """Merge all runs into one when there are more than most_runs."""
        if len(self.runs) > self.most_runs:
            rows = None
            for name in self.runs:
                run = self.spark.table(name)
                rows = run if rows is None else rows.unionByName(run)
            merged = self._write(rows.groupBy("fp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
            self._drop(self.runs)
            self.runs, self.compactions = [merged], self.compactions + 1

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        """Drop the runs; nothing may read the index afterwards."""
        self._drop(self.runs)
        remove(self.spark, self.folder)


def _spans(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive positions of one row: (index of the first, its position, length); the rows are sorted."""
    if not len(doc):
        return (np.empty(0, np.int64),) * 3
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (pos[1:] != pos[:-1] + 1)])
    return cut, pos[cut], np.diff(np.r_[cut, len(doc)])


def _later(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which occurrences have an equal window in a document of smaller id."""
    order = np.lexsort((doc, h2, h1))
    a, b, d = h1[order], h2[order], doc[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    first = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.empty(len(d), bool)
    out[order] = d > first
    return out


#: tag tells rows that repeat a doc_id apart.
_PENDING = "doc_id long, tag long, start int, n int, fp long, h binary"


def _rows(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, fp: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> Iterator[pd.DataFrame]:
    """Windows -> spans of those that a smaller document among them holds too (h null), and the others with their digests."""
    late = _later(h1, h2, doc)
    order = np.lexsort((pos, tag, doc))
    doc, tag, pos, fp, h1, h2, late = (x[order] for x in (doc, tag, pos, fp, h1, h2, late))
    cut, start, n = _spans(doc[late], tag[late], pos[late])
    yield pd.DataFrame({"doc_id": doc[late][cut], "tag": tag[late][cut], "start": start, "n": n, "fp": None, "h": None})
    doc, tag, pos, fp, h1, h2 = (x[~late] for x in (doc, tag, pos, fp, h1, h2))
    if len(doc):
        cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (pos[1:] != pos[:-1] + 1) | (fp[1:] != fp[:-1])])
        end = np.r_[cut[1:], len(doc)]
        packed = [h1[i:j].tobytes() + h2[i:j].tobytes() for i, j in zip(cut, end)]
        yield pd.DataFrame({"doc_id": doc[cut], "tag": tag[cut], "start": pos[cut], "n": end - cut, "fp": fp[cut], "h": packed})


def candidate_windows(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text, fps): the windows below the shared fingerprints fps.

    Rows with h null are spans of windows already found in a smaller document of
    the same batch (so a passage that very many documents hold leaves one row a
    batch, not one a document); the others carry the digests of pending windows.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, other = WordIds(), WordIds(1)
        for pdf in batches:
            got = []
            for doc, tag, text, fps in zip(pdf["doc_id"], pdf["tag"], pdf["text"], pdf["fps"]):
                words = text.encode().split()
                ids = word_ids(words, memo)
                m = _fingerprints(ids, window, shingle)
                pos = np.flatnonzero(np.isin(m, np.asarray(fps, np.int64)))
                if len(pos):
                    got.append((np.full(len(pos), doc, np.int64), np.full(len(pos), tag, np.int64), pos, m[pos], run_hashes(ids, window, 1)[pos], run_hashes(word_ids(words, other), window, 2)[pos]))
            if not got:
                continue
            yield from _rows(*(np.concatenate(x) for x in zip(*got)))

    return docs.mapInPandas(rows, _PENDING)


def _unpack(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """The windows of pending rows: doc_id, tag, position, fingerprint, both digests."""
    n = pdf["n"].to_numpy()
    h = np.frombuffer(b"".join(pdf["h"]), np.uint64)
    off = np.repeat(np.cumsum(2 * n) - 2 * n, n) + (inner := np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    each = lambda c: np.repeat(pdf[c].to_numpy(), n)
    return each("doc_id"), each("tag"), each("start") + inner, each("fp").astype(np.int64), h[off], h[off + np.repeat(n, n)]


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pending windows sorted by fp -> spans (doc_id, tag, start, n) of those that a smaller document holds too."""
    rest = None

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, tag, pos, _, h1, h2 = _unpack(pdf)
        late = np.flatnonzero(_later(h1, h2, doc))
        late = late[np.lexsort((pos[late], tag[late], doc[late]))]
        cut, start, size = _spans(doc[late], tag[late], pos[late])
        return pd.DataFrame({"doc_id": doc[late][cut], "tag": tag[late][cut], "start": start, "n": size})

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = pdf["fp"].iloc[-1] if len(pdf) else 0
        rest, whole = pdf[pdf["fp"] == last], pdf[pdf["fp"] != last]
        if len(whole):
            yield done(whole)
    if rest is not None and len(rest):
        yield done(rest)


def _thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pending rows of hot fingerprints -> what candidate_windows gives: spans that are settled within the batch, and what still is pending."""
    for pdf in batches:
        if len(pdf):
            yield from _rows(*_unpack(pdf))


def repeated_spans(docs: DataFrame, fps: DataFrame, shared: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Verify: spans (doc_id, tag, start, n) of windows of docs that also start in a document of smaller id.

    fps(fp, doc_id) holds the documents' fingerprints, shared(fp) those in question. A fingerprint that leaves many pending rows is thinned
    out in several tasks before one task settles it.
    """
    holders = fps.join(shared, "fp").groupBy("doc_id").agg(F.collect_set("fp").alias("fps"))
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("tag"), "text")
    found = written(candidate_windows(texts.join(holders, "doc_id"), window, shingle), "windows")
    settled, pending = found.where("h is null"), found.where("h is not null")
    hot = written(pending.groupBy("fp").count().where(F.col("count") > hot_rows).select("fp"), "hot")
    thinned = []
    if hot.limit(1).count():
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(64))
        many = pending.join(hot, "fp", "left_semi").repartition("fp", salt)
        thin = written(many.mapInPandas(_thin, _PENDING), "thinned")
        thinned.append(thin)
        settled = settled.unionByName(thin.where("h is null"))
        pending = pending.join(hot, "fp", "left_anti").unionByName(thin.where("h is not null"))
    pending = pending.repartition("fp").sortWithinPartitions("fp").select("doc_id", "tag", "start", "n", "fp", "h")
    spans = written(settled.select("doc_id", "tag", "start", "n").unionByName(pending.mapInPandas(_settle, "doc_id long, tag long, start int, n int")), "spans")
    discard(found, hot, *thinned)
    return spans


def remove_spans(docs: DataFrame, spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) that have spans: (doc_id, whole_sha256, n_removed, kept_sha256, kept_text)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, spans in zip(pdf["doc_id"], pdf["text"], pdf["spans"]):
                words = text.encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                if len(words) >= window:
                    s = np.array([(x["start"], x["n"]) for x in spans], np.int64).reshape(-1, 2)
                    np.add.at(edge, s[:, 0], 1)
                    np.add.at(edge, s[:, 0] + s[:, 1] + window - 1, -1)
                keep = np.cumsum(edge[:-1]) == 0
                kept = b" ".join([w for w, k in zip(words, keep.tolist()) if k])
                out.append((doc, hashlib.sha256(text.encode()).hexdigest(), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pd.DataFrame(out, columns=["doc_id", "whole_sha256", "n_removed", "kept_sha256", "kept_text"])

    by_doc = spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("tag"), "text")
    return texts.join(by_doc, ["doc_id", "tag"]).mapInPandas(rows, "doc_id long, whole_sha256 string, n_removed long, kept_sha256 string, kept_text string")


def word_digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, whole_sha256 (of the text), kept_sha256 (of all its words joined by one space). Null texts have no words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, whole, kept = [], [], []
            for text in batch["text"].to_pylist():
                words = (text or "").encode().split()
                n.append(len(words))
                whole.append(None if text is None else hashlib.sha256(text.encode()).hexdigest())
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(whole, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "whole_sha256", "kept_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_words long, whole_sha256 string, kept_sha256 string")


def ingest(fps: DataFrame, index: FingerprintIndex, bounds: list[int]) -> DataFrame:
    """Feed fps(fp, doc_id) to the index in batches of ascending doc_id, cut after each of bounds; the distinct fingerprints (fp) that several documents hold, of which one at least is of these batches.

    An index that holds earlier documents finds what these batches share with them too.
    """
    founds, lower = [], None
    for upper in [*bounds, None]:
        part = fps if lower is None else fps.where(F.col("doc_id") > lower)
        part = part if upper is None else part.where(F.col("doc_id") <= upper)
        founds.append(index.merge(part))
        lower = upper
    shared = founds[0]
    for found in founds[1:]:
        shared = shared.unionByName(found)
    shared = written(shared.distinct(), "shared")
    discard(*founds)
    return shared


def substring_dedup(docs: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, batches: int = BATCHES, most_runs: int = MOST_RUNS) -> tuple[DataFrame, DataFrame]:
    """Remove every word covered by a window whose words also start in a document with a smaller doc_id.

    Returns (per-row digests: doc_id, n_words, n_removed, kept_sha256; the texts
    that changed: doc_id, kept_text). Null or empty texts have no words; a null
    doc_id is neither smaller nor larger than any, so its text stays whole. Rows
    repeating a doc_id do not remove each other. Columns beside doc_id and text
    are ignored. A text shorter than the window stays whole, texts of any length are read to their end; an empty
    table gives no rows. The number of batches and of runs does not change results.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = docs.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [0.5], 1000)).first()[0]
    index = FingerprintIndex(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), most_runs)
    fps = written(fingerprint_rows(docs, window, shingle), "fingerprints")
    shared = ingest(fps, index, sorted(set(cuts or [])) if batches > 1 else [])
    spans = repeated_spans(docs, fps, shared, window, shingle)
    index.close()
    changed = written(remove_spans(docs, spans, window), "kept")
    discard(fps, shared, spans)
    marks = changed.select("doc_id", "whole_sha256", "n_removed", F.col("kept_sha256").alias("new_sha256")).distinct()
    base = word_digests(docs)
    digests = base.join(marks, ["doc_id", "whole_sha256"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("new_sha256", "kept_sha256").alias("kept_sha256")
    )
    return digests, changed.select("doc_id", "kept_text")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))[0]
