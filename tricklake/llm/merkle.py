"""Merkle manifest of a dataset, and the proofs of all its rows by one multiproof for each slice of leaves.

Leaves lie in trees (one for each value of a group column), whose roots are the leaves of one upper tree. Nodes have coordinates
(tree, level, idx). A slice holds consecutive leaves; from their coordinates alone follow those of
the nodes that it needs and cannot derive, at most twice a run less one at each level. They are fetched by one join, then the slice derives the interior nodes that
its leaves share once, and writes out each leaf's own proof from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, ranked, table, written

ARITY = 8
#: Leaves that one task holds at a time.
SLICE = 2048
#: The upper tree, whose leaves are the other trees' roots.
UPPER = -1
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Manifest(NamedTuple):
    """leaves: the rows with tree, pos (in the tree), size (of the tree) and at (in all); nodes(tree, level, idx, hash) above the leaves, UPPER's own included; trees: their number."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None
    trees: int


def record_hash(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields, each as `-` if null, else its length in bytes of UTF-8, `:` and its value: no two rows have one encoding."""
    coded = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*coded), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UP, _LOW)


def _grow(level: DataFrame, most: int, tables: list) -> list[DataFrame]:
    """level(tree, idx, hash, size) and the levels above it, each of one row for ARITY below, until a tree has one node."""
    levels = [level]
    while most > 1:
        run = levels[-1].where("size > 1").groupBy("tree", F.floor(F.col("idx") / ARITY).cast("long").alias("idx"))
        members = F.sort_array(F.collect_list(F.struct("idx", "hash")))  # ARITY at most
        up = run.agg(F.sha2(F.array_join(members["hash"], ""), 256).alias("hash"), F.ceil(F.first("size") / ARITY).cast("long").alias("size"))
        levels.append(written(up, "nodes"))
        tables.append(levels[-1])
        most = -(-most // ARITY)
    return levels


def _numbered(levels: list[DataFrame]) -> DataFrame:
    out = None
    for k, level in enumerate(levels):
        rows = level.select("tree", F.lit(k).alias("level"), "idx", "hash", "size")
        out = rows if out is None else out.unionByName(rows)
    return out


def build(rows: DataFrame, group: str, key: str, leaf: str) -> Manifest:
    """The trees over rows(group, key, leaf, ...): leaves of one group in ascending order of key (null first; ties by leaf), groups in ascending order (null first, bytewise).

    A tree of one leaf is that leaf; otherwise each ARITY consecutive nodes of a level, the last run being as long as it comes, are hashed together until one is left.
    """
    tables: list = []
    base = ranked(rows, [group, key, leaf], "at")
    groups = written(base.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("_first")), "groups")
    trees = ranked(groups, [group], "tree").withColumnRenamed(group, "_group")
    joined = base.join(trees, F.col(group).eqNullSafe(F.col("_group"))).withColumn("pos", F.col("at") - F.col("_first")).drop("_group", "_first")
    leaves = written(joined, "leaves")
    most, n = groups.agg(F.max("size"), F.count(F.lit(1))).first()
    levels = _grow(leaves.select("tree", F.col("pos").alias("idx"), F.col(leaf).alias("hash"), "size"), most or 0, tables)
    subroots = written(_numbered(levels).where("size = 1").select(F.lit(UPPER).cast("long").alias("tree"), F.col("tree").alias("idx"), "hash", F.lit(n).cast("long").alias("size")), "subroots")
    upper = _grow(subroots, n, tables)
    nodes = written(_numbered(levels).where("level > 0").unionByName(_numbered(upper)).select("tree", "level", "idx", "hash"), "nodes")
    root = upper[-1].select("hash").first()
    discard(groups, subroots, *tables)
    return Manifest(leaves, nodes, root.hash if root else None, n)


def missing(lo: int, hi: int, size: int) -> list[tuple[int, int]]:
    """(level, idx) of the nodes that the proofs of leaves lo to hi of a tree of that size need and that do not follow from those leaves: the least such set."""
    out, level = [], 0
    while size > 1:
        first, last = lo // ARITY * ARITY, min(hi // ARITY * ARITY + ARITY, size)
        out += [(level, i) for i in (*range(first, lo), *range(hi + 1, last))]
        lo, hi, size, level = lo // ARITY, hi // ARITY, -(-size // ARITY), level + 1
    return out


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(s, tree, *node) for s, tree, lo, hi, size in zip(*(batch[c].to_pylist() for c in ("slice", "tree", "lo", "hi", "size"))) for node in missing(lo, hi, size)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["slice", "tree", "level", "idx"])


def _climb(tree: int, lo: int, known: list[str], size: int, fetched: dict) -> tuple[list, str]:
    """From consecutive nodes of a tree's level 0 to its top: per level the first idx and each node's (left, right) siblings, hashes joined; the top."""
    steps, level = [], 0
    while size > 1:
        end = lo + len(known)
        first, last = lo // ARITY * ARITY, min((end - 1) // ARITY * ARITY + ARITY, size)
        full = [fetched[tree, level, i] for i in range(first, lo)] + known + [fetched[tree, level, i] for i in range(end, last)]
        runs = [full[i : i + ARITY] for i in range(0, len(full), ARITY)]
        sides = [("".join(r[:i]), "".join(r[i + 1 :])) for r in runs for i in range(len(r))]
        steps.append((first, sides))
        known = [hashlib.sha256("".join(r).encode()).hexdigest() for r in runs]
        lo, size, level = first // ARITY, -(-size // ARITY), level + 1
    return steps, known[0]


def _expand(leaf: str, trees: int, kept: list[str]):
    def expand(mine: pa.Table, others: pa.Table) -> pa.Table:
        mine = mine.sort_by("at")
        fetched = {(t, k, i): h for t, k, i, h in zip(*(others[c].to_pylist() for c in ("tree", "level", "idx", "hash")))}
        of, pos, size, hashes = (mine[c].to_pylist() for c in ("tree", "pos", "size", leaf))
        cuts = [i for i in range(len(of)) if not i or of[i] != of[i - 1]] + [len(of)]
        climbed = [_climb(of[a], pos[a], hashes[a:b], size[a], fetched) for a, b in zip(cuts, cuts[1:])]
        upper, root = _climb(UPPER, of[0], [top for _, top in climbed], trees, fetched)
        before, after, subroot = [], [], []
        for (steps, top), a, b in zip(climbed, cuts, cuts[1:]):
            for i in range(a, b):
                path = []
                for p, levels in ((pos[i], steps), (of[i], upper)):
                    for first, sides in levels:
                        path.append(sides[p - first])
                        p //= ARITY
                before.append([x for x, _ in path])
                after.append([x for _, x in path])
                subroot.append(top)
        more = {"before": pa.array(before, pa.list_(pa.string())), "after": pa.array(after, pa.list_(pa.string())), "subroot": pa.array(subroot, pa.string()), "root": pa.array([root] * len(of), pa.string())}
        return pa.table({c: mine[c] for c in kept} | more)

    return expand


def multiproofs(manifest: Manifest, leaf: str, slice_rows: int = SLICE) -> DataFrame:
    """Each leaf's row with before and after (per level, from the leaf up through its tree and the upper tree: the siblings to its left and right, hashes joined), subroot and root.

    fold() gets a root from a leaf and these alone. Slices are equal cuts of the leaves in order, so none is large whatever the groups' sizes.
    """
    own = ("tree", "pos", "size", "at")
    leaves = manifest.leaves.withColumn("slice", F.floor(F.col("at") / slice_rows).cast("long"))
    spans = leaves.groupBy("slice", "tree").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.first("size").alias("size"))
    above = leaves.groupBy("slice").agg(F.min("tree").alias("lo"), F.max("tree").alias("hi")).select("slice", F.lit(UPPER).cast("long").alias("tree"), "lo", "hi", F.lit(manifest.trees).cast("long").alias("size"))
    wanted = spans.unionByName(above).mapInArrow(_requests, "slice long, tree long, level int, idx long")
    # a leaf that another slice needs lies within a run of the cut between them
    place = F.pmod("at", F.lit(slice_rows))
    edges = manifest.leaves.where((place < ARITY) | (place >= slice_rows - ARITY)).select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col(leaf).alias("hash"))
    fetched = wanted.join(manifest.nodes.unionByName(edges), ["tree", "level", "idx"]).select("slice", "tree", "level", "idx", "hash")
    kept = [c for c in manifest.leaves.columns if c not in own]
    kinds = ", ".join(f"`{c}` {manifest.leaves.schema[c].dataType.simpleString()}" for c in kept)
    expand = _expand(leaf, manifest.trees, kept)
    return leaves.groupBy("slice").cogroup(fetched.groupBy("slice")).applyInArrow(expand, f"{kinds}, before array<string>, after array<string>, subroot string, root string")


def fold(leaf: Column, before: Column, after: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(F.zip_with(before, after, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), leaf, lambda h, s: F.sha2(F.concat(s["x"], h, s["y"]), 256))


def dataset_proofs(docs: DataFrame, claim: Column | None = None) -> DataFrame:
    """docs(doc_id, source, lang, n_chars, text, ...) -> doc_id, lang, leaf, claimed, before, after, subroot, root: one row per row, of which leaf is the record's hash and claimed that with text replaced by `claim` (a column over docs; the text itself if None).

    Any of the five columns may be null. Null doc_ids come first in their tree; rows of one doc_id are ordered by leaf, and equal rows have equal leaves at
    places of their own. Texts of any length count whole. Other columns are ignored. An empty table gives no rows.
    """
    fields = lambda text: record_hash(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text)
    rows = docs.select("doc_id", "lang", fields(F.col("text")).alias("leaf"), fields(F.col("text") if claim is None else claim).alias("claimed"))
    return multiproofs(build(rows, "lang", "doc_id", "leaf"), "leaf")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    proofs = dataset_proofs(docs, F.when(tampered, lower_ascii(F.col("text"))).otherwise(F.col("text")))
    siblings = F.array_join(F.zip_with("before", "after", lambda x, y: F.concat(x, y)), "")
    done = proofs.withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": fold(F.col("claimed"), F.col("before"), F.col("after"))})
    return done.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _oracle(levels: int, upper: int) -> str:
    """DuckDB SQL for trees of up to 8**levels leaves and 8**upper groups. A CRC-32 is eight steps a byte over a list."""
    coded = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    record = lambda text: f"sha256({' || '.join(map(coded, ('doc_id', 'source', 'lang', 'n_chars')))} || {coded(text)})"
    crc = "xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
    sql = [
        f"t AS (SELECT *, CASE WHEN {crc} % 3 = 0 THEN translate(text, '{_UP}', '{_LOW}') ELSE text END AS claim FROM documents)",
        f"d AS (SELECT doc_id, lang, {record('text')} AS leaf, {record('claim')} AS claimed FROM t)",
        "a0 AS (SELECT *, leaf AS h, claimed AS f, '' AS proof, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d)",
    ]
    step = """{new} AS (SELECT p.doc_id, p.lang, p.leaf, p.claimed, CASE WHEN p.n > 1 THEN sha256(array_to_string(hs, '')) ELSE p.h END AS h,
      CASE WHEN p.n > 1 THEN sha256(array_to_string(hs[1:p.i % 8] || [p.f] || hs[p.i % 8 + 2:], '')) ELSE p.f END AS f,
      CASE WHEN p.n > 1 THEN p.proof || array_to_string(hs[1:p.i % 8] || hs[p.i % 8 + 2:], '') ELSE p.proof END AS proof, p.i // 8 AS i, (p.n + 7) // 8 AS n{more}
      FROM {old} p JOIN (SELECT {key} i // 8 AS run, list(h ORDER BY i) AS hs FROM (SELECT DISTINCT {key} i, h FROM {old}) GROUP BY ALL) r ON {on} r.run = p.i // 8)"""
    for k in range(levels):
        sql.append(step.format(new=f"a{k + 1}", old=f"a{k}", key="lang,", on="r.lang IS NOT DISTINCT FROM p.lang AND", more=""))
    sql.append(f"b0 AS (SELECT * EXCLUDE (i, n), h AS subroot, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, (SELECT count(*) FROM (SELECT DISTINCT lang FROM documents)) AS n FROM a{levels})")
    for k in range(upper):
        sql.append(step.format(new=f"b{k + 1}", old=f"b{k}", key="", on="", more=", p.subroot"))
    return "WITH " + ",\n".join(sql) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM b{upper}"


ORACLE = _oracle(6, 2)
