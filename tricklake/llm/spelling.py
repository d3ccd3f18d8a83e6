"""Groups of spelling variants by permuterm rotations.

A word, marked by a terminator, is rotated at each of its places. The rotation that ends in the letter at place i reads: what
follows the letter, the terminator, what precedes it, the letter. Without that last letter it is a prefix which all words share that differ
from this one in the letter at i alone, and it is itself a whole rotation of the word that lacks the letter. So rotations are
posted under their whole and under their prefix, sorted, and scanned group by group: a group holds one word for each
letter and one without, which bounds it by the alphabet, and every two of its words are one edit apart.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, ranked, table, written

#: Letters of a word, once A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
#: Marks a word's end; no letter.
END = "$"
#: Rotations longer than this are sorted by a digest, so a row of a very long word stays small.
WHOLE = 64
#: Bytes of the words that a task counts before it passes them on.
HELD = 8_000_000


def word_counts(docs: DataFrame, least_length: int = 1, change: Callable[[str], Callable[[str], str]] | None = None) -> DataFrame:
    """docs(doc_id, text) -> (word, n): occurrences of each maximal run of letters, A-Z lower-cased, of at least least_length code points.

    change(doc_id as text) may give a function that replaces a document's words (before their length is judged). Null texts have no words; a null doc_id is the text `null`.
    Whole texts; tasks count before the shuffle, in bounded memory.
    """
    find = regex.compile(f"[{LETTERS}]+").findall

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch["d"].to_pylist(), batch["text"].to_pylist()):
                if not text:
                    continue
                new = change(doc_id) if change else None
                for word, n in Counter(find(text.encode().lower().decode())).items():
                    word = new(word) if new else word
                    if len(word) >= least_length:
                        if word not in counts:
                            held += len(word) + 100
                        counts[word] += n
                if held > HELD:
                    yield out()
                    counts.clear()
                    held = 0
        if counts:
            yield out()

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("d"), "text")
    return keyed.mapInArrow(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """words(id, word, n) -> (key, id, n, letter, once): each rotation under its whole (letter false) and, if it ends in a letter, under what precedes that (letter true).

    once: whether the letter differs from the one after it. Of a stretch of equal letters any one may be left out to the same effect; the last stands for all.
    """
    size, i = F.length("word"), F.col("i")
    places = words.select("*", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    tail, head = F.substring("word", i + 1, size), F.substring("word", F.lit(1), i)
    whole = F.concat(tail, F.lit(END), head)
    cut = F.concat(tail, F.lit(END), F.substring("word", F.lit(1), i - 1))
    kept = lambda key: F.when(F.length(key) > WHOLE, F.sha2(key, 256)).otherwise(key)
    once = F.substring("word", i, F.lit(1)) != F.substring("word", i + 1, F.lit(1))  # at the word's end the letter after is empty
    post = lambda key, letter, once: F.struct(kept(key).alias("key"), letter.alias("letter"), once.alias("once"))
    both = F.array(post(whole, F.lit(False), F.lit(False)), F.when(i > 0, post(cut, F.lit(True), once)))
    return places.select("id", "n", F.explode(both).alias("p")).where("p is not null").select("p.key", "id", "n", "p.letter", "p.once")


def neighbours(words: DataFrame) -> DataFrame:
    """words(id, word, n), distinct words -> (id, n_near, best_id, best_n): of words that have one, the number of words one edit away and of those the one of largest n (ties: smallest id)."""
    group = Window.partitionBy("key").orderBy(F.desc("n"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct("id", "n")
    scanned = rotations(words).select(
        "id", "letter", "once", F.first(me).over(group).alias("top"), F.nth_value(me, 2).over(group).alias("next"),
        F.sum(F.col("letter").cast("int")).over(group).alias("letters"), F.sum(F.col("once").cast("int")).over(group).alias("shorter"), F.max(~F.col("letter")).over(group).alias("lacks"),
    ).where("next is not null")
    near = F.when(F.col("letter"), F.col("letters") - 1 + (F.col("once") & F.col("lacks")).cast("int")).otherwise(F.col("shorter"))
    other = F.when(F.col("top.id") == F.col("id"), F.col("next")).otherwise(F.col("top"))
    best = F.min(F.struct((-other["n"]).alias("minus"), other["id"].alias("id")))
    out = scanned.groupBy("id").agg(F.sum(near).alias("n_near"), best.alias("best"))
    return out.select("id", "n_near", F.col("best.id").alias("best_id"), (-F.col("best.minus")).alias("best_n"))


def last_forms(forms: DataFrame) -> DataFrame:
    """forms(id, to) without circles -> (id, root): where the forms lead in the end. A round doubles the steps taken, so rounds grow with the log of the longest chain."""
    here = written(forms.select("id", F.col("to").alias("root")), "roots")
    while True:
        ahead = here.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = written(here.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(here)
        here = step.select("id", "root")
        here.scratch = step.scratch
        if not step.where("moved").limit(1).count():
            return here


def spelling_variants(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """counts(word, n), distinct words -> word, n, form, root, n_near, form_n.

    Words are near if they differ by one inserted, deleted or replaced code point. A word's form is its near word of largest n (ties: the
    smallest in code-point order) if that n is at least ratio times the word's own, else null; root is where forms lead in the end, the word itself without a form.
    ratio is 2 or more, so that forms lead in no circle. Null words are left out, and so is the empty one; words must not hold END. Other columns are ignored; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("a ratio under 2 could lead in circles")
    words = written(ranked(counts.where("word <> ''").select("word", "n"), ["word"], "id"), "words")  # ids in code-point order
    near = written(neighbours(words), "near")
    forms = near.join(words.select("id", "n"), "id").where(F.col("best_n") >= ratio * F.col("n")).select("id", F.col("best_id").alias("to"), F.col("best_n").alias("form_n"))
    forms = written(forms, "forms")
    roots = last_forms(forms)
    name = lambda key, word: words.select(F.col("id").alias(key), F.col("word").alias(word))
    named = forms.join(roots, "id").join(name("to", "form"), "to").join(name("root", "root_word"), "root").select("id", "form", "form_n", F.col("root_word").alias("root"))
    out = words.join(near.select("id", "n_near"), "id", "left").join(named, "id", "left")
    return out.select("word", "n", "form", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def misspelling(doc_id: str) -> Callable[[str], str]:
    """The slips that the query plants: of a document's word whose checksum 97 divides, one letter is lost, by the checksum."""
    start = zlib.crc32(f"{doc_id}:".encode())

    def change(word: str) -> str:
        h = zlib.crc32(word.encode(), start)
        if h % 97:
            return word
        i = h % len(word)
        return word[:i] + word[i + 1 :]

    return change


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = word_counts(table(spark, sf_dir, "documents"), 5, misspelling)
    return spelling_variants(counts.where("n >= 3"), 2)


_CRC = "xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] ELSE [195::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1, unicode(c) - 64, -1, -1, -1, -1, -1, -1, -1, -1] END)), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
# words that share what is before and after a place, with a letter there or none
ORACLE = f"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY ALL),
h AS (SELECT w, n, {_CRC} AS h FROM c),
e AS (SELECT CASE WHEN h % 97 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
i AS (SELECT word, n, unnest(range(0, length(word) + 1)) AS i FROM v),
k AS (SELECT word, n, word[1:i] AS a, word[i + 2:] AS b FROM i WHERE i < length(word) UNION ALL SELECT word, n, word[1:i], word[i + 1:] FROM i),
p AS (SELECT DISTINCT x.word, x.n, y.word AS other, y.n AS m FROM k x JOIN k y ON x.a = y.a AND x.b = y.b AND x.word <> y.word),
f AS (SELECT word, n, count(*) AS n_near, max(m) AS m, min(other) FILTER (m = top) AS best FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM p) GROUP BY word, n),
s AS (SELECT v.word, v.n, CASE WHEN m >= 2 * v.n THEN best END AS form, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN f USING (word)),
r AS (SELECT word, word AS at FROM s UNION ALL SELECT r.word, s.form FROM r JOIN s ON r.at = s.word WHERE s.form IS NOT NULL),
z AS (SELECT r.word, r.at AS root FROM r JOIN s ON r.at = s.word WHERE s.form IS NULL)
SELECT word, n, form, root, n_near, form_n FROM s JOIN z USING (word)
"""
