"""Line dedup by prefix doubling over the line sequences of all documents.

Every line is a suffix of its document. Level k names the first 2**k lines of each suffix; suffixes of one name
are an interval of the suffix array whose longest common prefix is at least 2**k
lines, and joining the names of a suffix and of the one 2**k lines on gives level k + 1. Only suffixes in
intervals of two or more go on, so levels shrink. A window of any length is named by the two names of
the largest level in it, of its beginning and of its end. DataFrame functions only.

Of all windows with enough characters only the shortest from each line on and the shortest up to each line are
looked up: in a repeated run with enough characters every line lies in one of the first, or, where too little is left
behind it, in the shortest window up to the run's end. Their lengths follow from the text alone, so each copy has the same window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

MIN_CHARS = 40
_DOC = ("d", "t")  # order of a document: id (null last), then the text's hash


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("d"), F.xxhash64("text").alias("t"), "text")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _intervals(rows: DataFrame, *more: str) -> DataFrame:
    """rows(d, t, pos, a, b, more) -> those whose name (a, b) occurs twice or more, with earlier: whether an earlier suffix has it."""
    place = F.struct(*_DOC, "pos")
    names = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    return rows.join(names, ["a", "b"]).select(*_DOC, "pos", *more, "a", "b", (F.col("first") < place).alias("earlier"))


def _shortest_windows(level: DataFrame, min_chars: int) -> DataFrame:
    """Level 0 without lines in stretches of under min_chars characters, with until and since: the end of the shortest window from pos on, the start of the shortest up to pos; null without one."""
    least = max(min_chars, 1)
    order = Window.partitionBy(*_DOC).orderBy("pos")
    # a line counts min_chars at most, so the two searches below reach over less than twice that
    chars = F.least(F.greatest(F.col("chars"), F.lit(int(min_chars < 1))), F.lit(least)).cast("long")
    rows = level.withColumns({"chars": chars, "before": F.lag("pos").over(order)}).where("before is null or before < pos")
    rows = rows.withColumn("stretch", F.sum(F.when(F.col("before") + 1 == F.col("pos"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = Window.partitionBy(*_DOC, "stretch")
    rows = rows.withColumn("upto", F.sum("chars").over(one.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"total": F.max("upto").over(one), "lo": F.min("pos").over(one), "hi": F.max("pos").over(one)}).where(F.col("total") >= least)
    rows = rows.withColumn("ahead", F.col("upto") - F.col("chars"))
    behind = F.min("pos").over(one.orderBy("ahead").rangeBetween(least, 2 * least - 1))
    before = F.max("pos").over(one.orderBy("upto").rangeBetween(1 - 2 * least, -least))
    until = F.coalesce(behind, F.when(F.col("total") - F.col("ahead") >= least, F.col("hi") + 1))
    since = F.coalesce(before + 1, F.when(F.col("upto") >= least, F.col("lo")))
    return rows.select(*_DOC, "pos", "a", "b", "earlier", until.alias("until"), since.alias("since"))


def repeated_windows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (d, t, start, end) of windows that begin in an earlier place too, over docs(doc_id, text): they cover what all such windows of min_chars characters or more cover."""
    keyed = _keyed(docs.where("text is not null"))
    lines = keyed.select(*_DOC, F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    ids = lines.select(*_DOC, "pos", F.length("line").alias("chars"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    level = written(_shortest_windows(_intervals(ids, "chars"), min_chars), "suffixes")
    out = level.where("earlier and until = pos + 1").select(*_DOC, F.col("pos").alias("start"), F.col("until").alias("end"))
    both = F.array(F.struct(F.col("pos").alias("start"), F.col("until").alias("end")), F.struct(F.col("since").alias("start"), (F.col("pos") + 1).alias("end")))
    windows = level.select(*_DOC, F.explode(both).alias("w")).select(*_DOC, "w.*").where("end - start > 1").distinct()
    windows = written(windows.withColumn("lines", F.col("end") - F.col("start")), "windows")
    most, size = windows.agg(F.max("lines")).first()[0] or 0, 1
    level = level.select(*_DOC, "pos", "a", "b")
    while size * 2 <= most:
        on = Window.partitionBy(*_DOC).orderBy("pos").rangeBetween(size, size)
        pairs = level.select(*_DOC, "pos", "a", "b", *(F.first(c).over(on).alias(f"{c}2") for c in "ab")).where("a2 is not null")
        pairs = pairs.select(*_DOC, "pos", F.xxhash64("a", "a2").alias("a"), F.xxhash64(F.lit(2), "b", "b2").alias("b"))
        size *= 2
        level = written(_intervals(pairs).drop("earlier"), "suffixes")
        mine = windows.where((F.col("lines") >= size) & (F.col("lines") < 2 * size))
        first = level.select(*_DOC, F.col("pos").alias("start"), F.col("a").alias("a1"), F.col("b").alias("b1"))
        last = level.select(*_DOC, F.col("pos").alias("second"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        named = mine.join(first, [*_DOC, "start"]).withColumn("second", F.col("end") - size).join(last, [*_DOC, "second"])
        named = named.select(*_DOC, F.col("start").alias("pos"), "end", F.xxhash64("lines", "a1", "a2").alias("a"), F.xxhash64(F.lit(3), "lines", "b1", "b2").alias("b"))
        out = out.unionByName(_intervals(named, "end").where("earlier").select(*_DOC, F.col("pos").alias("start"), "end"))
    return out


def runs(windows: DataFrame) -> DataFrame:
    """Maximal runs (d, t, start, end) of windows(d, t, start, end); runs do not overlap or touch."""
    w = windows.groupBy(*_DOC, "start").agg(F.max("end").alias("end"))
    order = Window.partitionBy(*_DOC).orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    w = w.withColumn("new", F.when(F.coalesce(reach >= F.col("start"), F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    return w.groupBy(*_DOC, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with text rewritten, and n_lines, n_deleted added.

    A window of any number of consecutive lines that starts at an earlier place
    too (by doc_id, then by line; null ids last) and holds at least min_chars
    characters is a later copy: its lines are deleted. So the floor is that of the maximal repeated run. Lines are cut at line feeds and
    compared whole. Null texts stay null with 0 lines; an empty text is one empty
    line and stays. A text all of whose lines go becomes empty. Texts of any length are taken whole. Rows that repeat
    doc_id and text are one document and not each other's copies; of copies with equal doc_id and other texts the order of the texts' hashes decides. An
    empty table gives none. All other columns are kept as they are, whatever their names, but for n_lines and n_deleted, which are replaced.
    """
    found = runs(repeated_windows(docs, min_chars))
    spans = found.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    own = lambda c: F.col(f"`{c}`")
    keyed = docs.select(F.struct(*map(own, docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("d"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("t"))
    joined = keyed.join(spans, list(_DOC), "left")
    text, spans = F.col("row.text"), F.col("spans")
    lines = _lines(text)
    # what lies between two runs, before the first and after the last
    after = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.element_at(spans, F.greatest(k, F.lit(1)))["end"])
    until = lambda k: F.when(k == F.size(spans), F.size(lines)).otherwise(F.element_at(spans, F.least(k + 1, F.size(spans)))["start"])
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), lambda k: F.slice(lines, after(k) + 1, until(k) - after(k))))
    gone = F.aggregate(spans, F.lit(0), lambda s, x: s + x["end"] - x["start"])
    kept = F.when(spans.isNull(), text).otherwise(F.array_join(kept, "\n"))
    others = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    return joined.select(
        *[(kept if c == "text" else F.col("row")[c]).alias(c) for c in others],
        F.when(text.isNotNull(), F.size(lines)).otherwise(0).cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_deleted"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("kept_sha256"))


# equal lines of two places lie on a diagonal; unbroken stretches of one diagonal are the maximal runs that two places share
ORACLE = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
p AS (SELECT a.doc_id, a.i, length(a.line) AS chars, b.doc_id AS other, a.i - b.i AS diagonal FROM w a JOIN w b ON a.line = b.line AND (b.doc_id, b.i) < (a.doc_id, a.i)),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY i) AS run FROM p),
s AS (SELECT *, sum(chars) OVER (PARTITION BY doc_id, other, diagonal, run) AS whole FROM r),
x AS (SELECT doc_id, list(DISTINCT i) AS gone FROM s WHERE whole >= 40 GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_deleted,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN l ELSE list_filter(l, lambda y, j: NOT list_contains(gone, j)) END, chr(10))) AS kept_sha256
FROM d LEFT JOIN x ON d.doc_id = x.doc_id
"""
