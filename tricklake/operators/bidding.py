"""Bidding rules against deals: phrases to predicates, predicate tables, relational division, auctions."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bridge as B
from ..sources.folders import remove, shared_folder

#: Rules that go to every task as one trie; their predicates may be four times as many.
SMALL_BOOK = 100_000
#: Different auctions that are analysed once each and go to every task.
FEW_AUCTIONS = 20_000

# fixed values: rule phrases and the predicates they stand for, first match wins; * before a template marks one predicate for each card of that group
PHRASES = [
    (r"^(\d+)$", "HCP == $1"), (r"^(\d+)-$", "HCP <= $1"), (r"^(\d+)\+$", "HCP >= $1"), (r"^(\d+)-(\d+)$", "HCP >= $1, HCP <= $2"),
    (r"^(\d+) losers$", "Losers == $1"), (r"^(\d+)- losers$", "Losers <= $1"), (r"^(\d+)\+ losers$", "Losers >= $1"), (r"^(\d+)-(\d+) losers$", "Losers >= $1, Losers <= $2"),
    (r"^(\d+) !([CDHS])$", "SL_$2 == $1"), (r"^(\d+)- !([CDHS])$", "SL_$2 <= $1"), (r"^(\d+)-card !([CDHS])$", "SL_$2 == $1"), (r"^(\d+)\+ !([CDHS])$", "SL_$2 >= $1"), (r"^(\d+)-(\d+) !([CDHS])$", "SL_$3 >= $1, SL_$3 <= $2"),
    (r"^(\d+) HCP$", "HCP == $1"), (r"^(\d+)- HCP$", "HCP <= $1"), (r"^(\d+)\+ HCP$", "HCP >= $1"), (r"^(\d+)-(\d+) HCP$", "HCP >= $1, HCP <= $2"),
    (r"^(\d+) total_points$", "Total_Points == $1"), (r"^(\d+)- total_points$", "Total_Points <= $1"), (r"^(\d+)\+ total_points$", "Total_Points >= $1"), (r"^(\d+)-(\d+) total_points$", "Total_Points >= $1, Total_Points <= $2"),
    (r"^([AKQ]+)\+_in !([CDHS])$", "*1 C_$2"), (r"^!?([CDHS])([AKQ]+)$", "*2 C_$1"), (r"^at_best (\d+)-card !([CDHS])$", "SL_$2 <= $1"), (r"^at_best_stop_in !([CDHS])$", "At_Best_Stop_In_$1"),
    (r"^at_best_likely_stop_in !([CDHS])$", "At_Best_Likely_Stop_In_$1"), (r"^at_best_partial_stop_in !([CDHS])$", "At_Best_Partial_Stop_In_$1"), (r"^biddable !([CDHS])$", "Biddable_$1"), (r"^forcing$", "Forcing_One_Round"),
    (r"^forcing_to (\d[CDHSN])$", "Forcing_To_$1"), (r"^likely_stop(?:-stop)?_in !([CDHS])$", "Likely_Stop_In_$1"), (r"^no !([CDHS])$", "SL_$1 == 0"), (r"^no !([CDHS])([AKQ]+)$", "*2 C_$1 == False"),
    (r"^opponents_cannot_play_undoubled_below (\d[CDHSN])$", "Opponents_Cannot_Play_Undoubled_Below_$1"), (r"^partial_stop(?:-stop)?_in !([CDHS])$", "Partial_Stop_In_$1"), (r"^partial_stop[-_]likely_stop_in !([CDHS])$", "Partial_Stop_Likely_Stop_In_$1"),
    (r"^rebiddable !([CDHS])$", "Rebiddable_$1"), (r"^solid (\d)-card !([CDHS])$", "Solid_$2, SL_$2 >= $1"), (r"^stop_in !([CDHS])$", "Stop_In_$1"), (r"^strong_rebiddable !([CDHS])$", "Strong_Rebiddable_$1"),
    (r"^twice_rebiddable !([CDHS])$", "Twice_Rebiddable_$1"), (r"^two_stops_in !([CDHS])$", "Two_Stops_In_$1"),
]


def _a_card_each(cards: Column, suit: Column, tail: str) -> Column:
    return F.transform(cards, lambda c: F.concat(F.lit("C_"), suit, c, F.lit(tail)))


def predicates_of(phrase: Column) -> Column:
    """array<string> of the predicates of a rule phrase; null if no pattern fits."""
    out = None
    for pattern, template in PHRASES:
        if template.startswith("*"):
            group, tail = int(template[1]), template[3:].partition(" ")[2]
            cards = F.filter(F.split(F.regexp_extract(phrase, pattern, group), ""), lambda c: c != "")
            value = _a_card_each(cards, F.regexp_extract(phrase, pattern, 3 - group), f" {tail}" if tail else "")
        else:
            value = F.split(F.regexp_replace(phrase, pattern, template), ", ")
        out = F.when(phrase.rlike(pattern), value) if out is None else out.when(phrase.rlike(pattern), value)
    return out


def clean_text(rule: Column) -> Column:
    """Without the comment after #, trimmed; empty becomes null."""
    t = F.trim(F.regexp_replace(rule, "#.*$", ""))
    return F.when(t != "", t)


def distinct_predicates(rules: DataFrame, column: str) -> DataFrame:
    """(predicate, variables): the distinct cleaned texts in order, with the names in them."""
    p = rules.select(clean_text(F.col(column)).alias("predicate")).where("predicate is not null").distinct()
    return p.withColumn("variables", F.array_distinct(F.regexp_extract_all("predicate", F.lit("([A-Za-z]\\w*)"), F.lit(1))))


def for_seat(predicate: Column, seat: str) -> Column:
    """HCP >= 12 -> HCP_N >= 12; SL_S -> SL_N_S; C_SA -> C_NSA; quality flags get the seat before their suit."""
    p = F.regexp_replace(predicate, r"\bC_([SHDC])([AKQJT2-9])\b", f"C_{seat}$1$2")
    p = F.regexp_replace(p, r"\b(HCP|Total_Points|Losers)\b", f"$1_{seat}")
    return F.regexp_replace(p, r"\b(SL|[A-Z][A-Za-z_]*(?:iddable|_In|Solid|Suit)|Solid)_([SHDC])\b", f"$1_{seat}_$2")


def with_predicate_ids(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rules(rule_id, requirements array) -> (predicate, predicate_id by text order) and (rule_id, predicate_id).

    Predicates are a rule book's, few; ids are dense over their distinct texts.
    """
    from pyspark.sql import Window

    pairs = rules.select("rule_id", F.explode(F.transform("requirements", clean_text)).alias("predicate")).where("predicate is not null").distinct()
    ids = pairs.select("predicate").distinct().withColumn("predicate_id", F.dense_rank().over(Window.orderBy("predicate")))
    return ids, pairs.join(ids, "predicate").select("rule_id", "predicate_id")


_ALLOWED = re.compile(r"^[A-Za-z_]\w*( *(==|=|<=|>=|<|>|!=) *(\d+|True|False|true|false))?$")


def seat_features(deals: DataFrame) -> DataFrame:
    """deals(deal_id, Board, PBN) -> per deal and seat: HCP, Total_Points, Losers, SL_s, Balanced, quality flags by suit."""
    from .deals import balanced, quality_flags

    rows = deals.select("deal_id", "Board", F.posexplode(B.hands(F.col("PBN"))).alias("_i", "h"))
    # lengths, points and losers are worked out once, in a projection of their own
    kinds = {"n": F.length, "p": B.suit_hcp, "l": B.suit_losers}
    rows = rows.select("deal_id", "Board", "_i", balanced(F.col("h")).alias("Balanced"), *[f(F.col("h")[j]).alias(f"_{k}{j}") for k, f in kinds.items() for j in range(4)])
    n, p, losers = ([F.col(f"_{k}{j}") for j in range(4)] for k in kinds)
    total = lambda c: c[0] + c[1] + c[2] + c[3]
    return rows.select(
        "deal_id", "Board", B.nth(B.SEATS, F.col("_i")).alias("seat"), total(p).alias("HCP"), total([p[j] + F.greatest(F.lit(0), 3 - n[j]) for j in range(4)]).alias("Total_Points"), total(losers).alias("Losers"),
        "Balanced", *[n[j].alias(f"SL_{s}") for j, s in enumerate(B.SUITS)], *[c.alias(f"{k}_{s}") for j, s in enumerate(B.SUITS) for k, c in quality_flags(n[j], p[j]).items()],
    )


def _tests(features: DataFrame, predicates: list[str]) -> list[Column]:
    """Each predicate as a column that is never null; on a column that isn't there it is false."""
    def one(p: str) -> Column:
        if not _ALLOWED.match(p.strip()):
            raise ValueError(f"not a predicate: {p!r}")
        name = re.match(r"\w+", p.strip())[0]
        return F.coalesce(F.expr(p.replace("==", "=")), F.lit(False)) if name in features.columns else F.lit(False)

    return [one(p) for p in predicates]


def evaluate(features: DataFrame, predicates: list[str]) -> DataFrame:
    """(deal_id, seat, Board, truth array<boolean>) of all predicates in one projection.

    Only `name` or `name operator constant` is accepted; a predicate on a column that isn't there is false.
    """
    return features.select("deal_id", "seat", "Board", F.array(*_tests(features, predicates)).alias("truth"))


def evaluate_packed(features: DataFrame, predicates: list[str]) -> DataFrame:
    """pack(evaluate(features, predicates)), where each predicate's bit is known beforehand, so that nothing runs over an array."""
    bits = [F.when(t, F.lit(1 << i % 64 if i % 64 < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i, t in enumerate(_tests(features, predicates))]
    words = [reduce(Column.bitwiseOR, bits[at : at + 64]) for at in range(0, len(bits), 64)]
    return features.select("deal_id", "seat", "Board", F.array(*words).cast("array<long>").alias("words"))


def pack(truth: DataFrame) -> DataFrame:
    """truth as bits: (deal_id, seat, Board, words array<long>), predicate i (from 1) being bit (i - 1) % 64 of word (i - 1) / 64. A row a deal and seat, 64 predicates in 8 bytes."""
    def word(part: Column) -> Column:
        bits = F.transform(part, lambda t, i: F.when(t, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(0))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda w, x: w.bitwiseOR(x))

    n = F.floor((F.size("truth") + 63) / 64).cast("int")
    words = F.transform(F.filter(F.sequence(F.lit(0), n), lambda w: w < n), lambda w: word(F.slice("truth", w * 64 + 1, 64)))
    return truth.select("deal_id", "seat", "Board", words.alias("words"))


def bitmap(packed: DataFrame) -> DataFrame:
    """Long form of the true predicates: deal_id, seat, predicate_id (from 1).

    Places of bits are rows that a filter tests, which is generated code; a filter over an array would call a function for each of 64 places.
    """
    words = packed.select("deal_id", "seat", F.posexplode("words").alias("_w", "_word")).where("_word <> 0")
    places = words.select("deal_id", "seat", "_w", "_word", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_i"))
    return places.where(F.getbit("_word", F.col("_i")) == 1).select("deal_id", "seat", (F.col("_w") * 64 + F.col("_i") + 1).alias("predicate_id"))


def fingerprint(*sources: DataFrame) -> str:
    """What tables hold, as a text: rows and the sum of the rows' hashes, whatever their order."""
    parts = []
    for df in sources:
        # a hash leaves nulls out, so where they stand is hashed too; what nests is hashed as text
        nested = lambda c: isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))  # noqa: E731, B023
        values = [F.to_json(F.struct(c)) if nested(c) else F.col(c) for c in df.columns]
        nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns])
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*values, nulls).cast("decimal(38,0)")).alias("h")).first()
        parts.append(f"{r.n}.{r.h or 0}")
    return "_".join(parts)


def stored_bitmap(deals: DataFrame, predicates: list[str], path: str) -> DataFrame:
    """The packed predicates of these deals, stored by the fingerprint of both: the table is built anew as soon as one of them has changed."""
    from ..sources.tables import read_through

    spark = deals.sparkSession
    key = fingerprint(deals, spark.createDataFrame([(i, p) for i, p in enumerate(predicates)], "i int, p string"))
    return read_through(spark, path, key, lambda: evaluate_packed(seat_features(deals), predicates))


def seat_of_turn(dealer: Column, turn: Column) -> Column:
    """Compass seat of the turn-th bidder (from 1) after the dealer, and back."""
    return B.nth(B.SEATS, F.pmod(F.instr(F.lit(B.SEATS), dealer) + turn - 2, F.lit(4)))


def turn_of_seat(dealer: Column, seat: Column) -> Column:
    return F.pmod(F.instr(F.lit(B.SEATS), seat) - F.instr(F.lit(B.SEATS), dealer), F.lit(4)) + 1


def requirement_trie(rules: list[tuple[int, list[int]]]) -> dict:
    """(rule_id, predicate ids) as a trie: a node is {"rules": ids that end here, predicate: node}.

    A rule's predicates stand in the order of how many rules have them, so rules share long beginnings and a beginning is tested once for all of them.
    """
    used = Counter(p for _, needs in rules for p in set(needs))
    root: dict = {"rules": []}
    for rule, needs in rules:
        node = root
        for p in sorted(set(needs), key=lambda p: (-used[p], p)):
            node = node.setdefault(p, {"rules": []})
        node["rules"].append(rule)
    return root


def _matches(trie: dict, words: np.ndarray) -> Iterator[tuple[np.ndarray, list[int]]]:
    """(rows, rules): for each node at which rules end, the rows of words(row, word) that have all its predicates. Rows fall out at the first predicate they lack."""
    flags: dict[int, np.ndarray] = {}
    stack = [(trie, np.arange(len(words)))]
    while stack:
        node, rows = stack.pop()
        if node["rules"]:
            yield rows, node["rules"]
        for p, below in node.items():
            if p == "rules":
                continue
            if p not in flags:
                w, bit = divmod(p - 1, 64)
                flags[p] = (words[:, w] >> np.uint64(bit) & np.uint64(1)).astype(bool) if w < words.shape[1] else np.zeros(len(words), bool)
            left = rows[flags[p][rows]]
            if len(left):
                stack.append((below, left))


def _words_of(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch["words"]
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(batch.num_rows, -1) if batch.num_rows and len(lists.flatten()) else np.zeros((batch.num_rows, 0), np.uint64)


def _small_book(needs: DataFrame, rules: DataFrame, most: int) -> dict | None:
    """The trie of the rules, or None if they or their predicates are more than most."""
    lists = rules.select("rule_id").distinct().join(needs.groupBy("rule_id").agg(F.collect_set("predicate_id").alias("set")), "rule_id", "left")
    n, total = lists.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.size("set"), F.lit(0)))).first()
    if n > most or (total or 0) > 4 * most:
        return None
    return requirement_trie([(r.rule_id, r.set or []) for r in lists.collect()])


def rules_that_hold(packed: DataFrame, needs: DataFrame, rules: DataFrame, most: int = SMALL_BOOK) -> DataFrame:
    """(deal_id, seat, rule_id) of the rules all of whose predicates are true.

    packed(deal_id, seat, words), needs(rule_id, predicate_id), rules(rule_id); a rule without predicates holds everywhere. A book of up to
    most rules goes to the tasks as a trie and is tested where the deals are, without a shuffle; a larger one is divided by joins.
    """
    trie = _small_book(needs, rules, most)
    if trie is None:
        return _divided(packed, needs, rules)
    kind = rules.schema["rule_id"].dataType
    to = pa.int64() if kind.simpleString() == "bigint" else pa.int32()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ids in _matches(trie, _words_of(batch)):
                for lo in range(0, len(ids), 64):  # so that a batch stays small where very many rules end
                    some = ids[lo : lo + 64]
                    take = pa.array(np.repeat(at, len(some)))
                    yield pa.RecordBatch.from_arrays([batch["deal_id"].take(take), batch["seat"].take(take), pa.array(np.tile(some, len(at)), to)], ["deal_id", "seat", "rule_id"])

    keys = packed.select("deal_id", "seat", "words")
    return keys.mapInArrow(rows, f"deal_id {keys.schema['deal_id'].dataType.simpleString()}, seat string, rule_id {kind.simpleString()}")


def _divided(packed: DataFrame, needs: DataFrame, rules: DataFrame) -> DataFrame:
    """rules_that_hold for a book of any size: true predicates are counted against each distinct set of requirements, whose rules follow by a join."""
    lists = rules.select("rule_id").distinct().join(needs.groupBy("rule_id").agg(F.sort_array(F.collect_set("predicate_id")).alias("set")), "rule_id", "left")
    lists = lists.select("rule_id", F.coalesce("set", F.array().cast("array<int>")).alias("set")).withColumn("set_id", F.sha2(F.array_join("set", ","), 256))
    sets = lists.groupBy("set_id").agg(F.first("set").alias("set"))
    wanted = sets.select("set_id", F.size("set").alias("size"), F.explode("set").alias("predicate_id"))
    hit = bitmap(packed).join(wanted, "predicate_id").groupBy("deal_id", "seat", "set_id").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    out = hit.where("n = size").join(lists.select("set_id", "rule_id"), "set_id").select("deal_id", "seat", "rule_id")
    # rules without requirements are posted under the rows' one key, in parts
    free = lists.where(F.size("set") == 0).select("rule_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("part"))
    return out.unionByName(packed.select("deal_id", "seat", F.pmod(F.xxhash64("deal_id", "seat"), F.lit(64)).cast("int").alias("part")).join(free, "part").select("deal_id", "seat", "rule_id"))


def _steps_up(rules: DataFrame) -> DataFrame:
    """(rule_id, at): each rule's parent; 0 where that is the root or no rule of the book."""
    known = rules.select(F.col("rule_id").alias("at")).distinct()
    up = rules.select("rule_id", F.col("parent").alias("at"))
    return up.join(known.withColumn("known", F.lit(True)), "at", "left").select("rule_id", F.when(F.col("known"), F.col("at")).otherwise(0).alias("at"))


def _doubled(spark, rules: DataFrame):
    """Yield (rule_id, at) with at 1, 2, 4 ... steps up (0 past the root), until all are past it; a circle of parents is an error.

    Tables of the shared folder, removed with the next one; a book of n rules has no way up longer than n, so rounds end after log n.
    """
    path = shared_folder(spark, "steps-up")
    longest, here = math.ceil(math.log2(max(rules.count(), 1))) + 1, _steps_up(rules)
    for k in range(longest + 1):
        here.write.parquet(f"{path}/{k}")
        here = spark.read.schema(here.schema).parquet(f"{path}/{k}")
        yield here
        if not here.where("at <> 0").limit(1).count():
            remove(spark, path)
            return
        here = here.join(here.select(F.col("rule_id").alias("at"), F.col("at").alias("further")), "at", "left").select("rule_id", F.coalesce("further", F.lit(0)).alias("at"))
    raise ValueError("rules are their own ancestors")


def check_tree(rules: DataFrame) -> int:
    """How often ways up must be doubled to pass the root of rules(rule_id, parent); an error if parents run in a circle."""
    return sum(1 for _ in _doubled(rules.sparkSession, rules))


def with_ancestors(rules: DataFrame) -> DataFrame:
    """rules(rule_id, parent; 0 is the root) -> (rule_id, ancestor) with the rule itself, by doubling: from all ancestors less than 2**k steps up follow those less than 2**(k+1), so the joins grow with the log of the depth."""
    spark = rules.sparkSession
    path, k = shared_folder(spark, "ancestors"), 0
    out = rules.select("rule_id", F.col("rule_id").alias("ancestor"))
    for up in _doubled(spark, rules):
        above = up.where("at <> 0").join(out.withColumnRenamed("rule_id", "at"), "at").select("rule_id", "ancestor")
        out = out.unionByName(above)
        out.write.parquet(f"{path}/{k}")
        out = spark.read.schema(out.schema).parquet(f"{path}/{k}")
        if k:
            remove(spark, f"{path}/{k - 1}")
        k += 1
    return out


def _with_rules(rows: DataFrame, book: DataFrame) -> DataFrame:
    """Rows of deals joined to columns of their rules. A book of up to SMALL_BOOK rules goes to the rows; the rows, whose size is underrated before they are worked out, never go to the book."""
    small = book.limit(SMALL_BOOK + 1).count() <= SMALL_BOOK
    return rows.join(F.broadcast(book) if small else book.hint("merge"), "rule_id")


def hold_with_ancestors(holds: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that hold together with all rules above them, at the same seat.

    A rule that holds looks up to its parent at the same deal and seat, then as far again as that one has looked, and so on: a way that meets a rule which does not hold is
    dropped, and with it, in later rounds, whatever looks through it. Rounds grow with the log of the depth; no table of ancestors is made. Rows of deals meet in merge
    joins: their files are small for what they hold, so that by size they would be taken for tables to broadcast.
    """
    spark = holds.sparkSession
    path = shared_folder(spark, "held")
    rounds = check_tree(rules)
    here = _with_rules(holds.select("deal_id", "seat", "rule_id"), _steps_up(rules))
    for k in range(rounds):
        here.write.parquet(f"{path}/{k}")
        here = spark.read.schema(here.schema).parquet(f"{path}/{k}")
        if k:
            remove(spark, f"{path}/{k - 1}")
        above = here.select("deal_id", "seat", F.col("rule_id").alias("at"), F.col("at").alias("further")).hint("merge")
        seen = here.where("at <> 0").join(above, ["deal_id", "seat", "at"]).select("deal_id", "seat", "rule_id", F.col("further").alias("at"))
        here = here.where("at = 0").select("deal_id", "seat", "rule_id", "at").unionByName(seen)
    return here.select("deal_id", "seat", "rule_id")


def candidates(packed: DataFrame, needs: DataFrame, opening: DataFrame, most: int = SMALL_BOOK) -> DataFrame:
    """Per deal and seat the opening rules that hold, in order; empty where none does. A book of up to most rules is tested in one pass over the deals."""
    trie = _small_book(needs.join(opening.select("rule_id"), "rule_id", "left_semi"), opening, most)
    seats = packed.select("deal_id", "seat")
    if trie is None:
        mine = _divided(packed, needs, opening).groupBy("deal_id", "seat").agg(F.sort_array(F.collect_list(F.col("rule_id").cast("int"))).alias("rules"))
        return seats.join(mine.hint("merge"), ["deal_id", "seat"], "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<int>")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.repeat(at, len(ids)), np.tile(ids, len(at))) for at, ids in _matches(trie, _words_of(batch))]
            at, ids = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
            order = np.lexsort((ids, at))
            ends = np.r_[0, np.cumsum(np.bincount(at, minlength=batch.num_rows))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["deal_id"], batch["seat"], pa.ListArray.from_arrays(ends, pa.array(ids[order], pa.int32()))], ["deal_id", "seat", "rules"])

    keys = packed.select("deal_id", "seat", "words")
    return keys.mapInArrow(rows, f"deal_id {keys.schema['deal_id'].dataType.simpleString()}, seat string, rules array<int>")


def for_four_seats(rules: DataFrame) -> DataFrame:
    """rules(bt_index, Auction, Expr) -> four rows each: leading passes off, index 4 * bt_index + seat - 1, the requirement in its own seat's column only."""
    r = rules.withColumn("seat", F.explode(F.sequence(F.lit(1), F.lit(4))))
    r = r.withColumns({"index": F.col("bt_index") * 4 + F.col("seat") - 1, "Auction": F.regexp_replace("Auction", "^(?:p-)+", "")})
    return r.withColumns({f"Agg_Expr_Seat_{i}": F.when(F.col("seat") == i, F.col("Expr")) for i in range(1, 5)})


def auctions(deals: DataFrame, holds: DataFrame, rules: DataFrame, folder: str, prefixes: bool = False) -> DataFrame:
    """All auctions a deal can reach: (deal_id, Dealer, auction array); with prefixes also all their beginnings of one bid or more.

    The seat to bid takes each rule below the last bid that holds for its hand, if
    its own side made that bid (any rule of the root before the first bid), else it passes; three passes
    after a bid, or four at the start, end an auction. Openings of 4N or more are not followed. Steps go to tables
    below folder until no auction is open; as each bid goes one rule down the tree, a tree of rules has an end (a circle is an error). Only the table of the result stays.
    A step reads the moves of the seats whose turn it is, by merge joins, as the compressed moves of all deals would be taken for a table to broadcast.
    """
    spark = deals.sparkSession
    check_tree(rules)
    moves = _with_rules(holds, rules.select("rule_id", "parent", "bid")).where("not (parent = 0 and bid >= '4N' and bid < 'p')")
    moves = moves.select("deal_id", (F.instr(F.lit(B.SEATS), F.col("seat")) - 1).alias("turn"), F.col("parent").alias("node"), "rule_id", "bid")
    path = f"{folder.rstrip('/')}/auctions-{uuid.uuid4().hex}"
    dealers = deals.select("deal_id", "Board").distinct().hint("merge")
    after = F.pmod(F.col("turn") - F.instr(F.lit(B.SEATS), B.dealer_of(F.col("Board"))) + 1, F.lit(4)).cast("int")
    moves.join(dealers, "deal_id").select(*moves.columns, after.alias("after")).write.partitionBy("after").parquet(f"{path}/moves")
    every_move = spark.read.schema(f"{', '.join(f'{c} {t}' for c, t in moves.dtypes)}, after int").parquet(f"{path}/moves")
    front = deals.select("deal_id", B.dealer_of(F.col("Board")).alias("Dealer"), F.array().cast("array<string>").alias("auction"), F.lit(0).alias("node"), F.lit(-1).alias("bidder"), F.lit(0).alias("passes"))
    front = front.withColumn("turn", F.instr(F.lit(B.SEATS), F.col("Dealer")) - 1)
    step = 0
    while True:
        moves = every_move.where(F.col("after") == step % 4).drop("after")
        m = front.join(moves.hint("merge"), ["deal_id", "turn", "node"], "left")
        mine = F.col("rule_id").isNotNull() & ((F.col("bidder") < 0) | (F.pmod(F.col("turn") - F.col("bidder"), F.lit(2)) == 0))
        m = m.select("deal_id", "Dealer", F.concat("auction", F.array(F.when(mine, F.col("bid")).otherwise("p"))).alias("auction"), F.when(mine, F.col("rule_id")).otherwise(F.col("node")).alias("node"),
                     F.when(mine, F.col("turn")).otherwise(F.col("bidder")).alias("bidder"), F.when(mine, 0).otherwise(F.col("passes") + 1).alias("passes"), F.pmod(F.col("turn") + 1, F.lit(4)).alias("turn")).distinct()
        m.withColumn("over", F.col("passes") == F.when(F.col("bidder") < 0, 4).otherwise(3)).write.parquet(f"{path}/{step}")
        m = spark.read.parquet(f"{path}/{step}")
        front = m.where("not over").drop("over")
        if not front.limit(1).count():
            break
        step += 1
    every = spark.read.parquet(*[f"{path}/{i}" for i in range(step + 1)])
    out = (every if prefixes else every.where("over")).select("deal_id", "Dealer", "auction").distinct()
    out.write.parquet(f"{path}/result")
    for name in ("moves", *range(step + 1)):
        remove(spark, f"{path}/{name}")
    return spark.read.schema(out.schema).parquet(f"{path}/result")


def analyse(auction: Column, dealer: Column) -> Column:
    """Fold over the bids: legal, over, contract (with doubling), opener, declarer and leader seats.

    A bid must be higher than the last; d only of an opponents' bid that isn't doubled, r
    only of an own doubled one; nothing follows three passes after a bid or four passes.
    """
    first = F.instr(F.lit(B.SEATS), dealer) - 1
    state = F.struct(
        F.lit(True).alias("legal"), F.lit(0).alias("n"), F.lit(0).alias("passes"), F.lit(0).alias("rank"), F.lit(-1).alias("last"), F.lit("").alias("dbl"), F.lit(-1).alias("opener"),
        F.array(*[F.lit(-1)] * 10).alias("named"), F.lit("").alias("bid"),
    )

    def step(s, b):
        seat = F.pmod(first + s["n"], F.lit(4))
        bid, dbl, rdb, ps = b.rlike("^[1-7][CDHSN]$"), b == "d", b == "r", b == "p"
        strain = F.instr(F.lit(B.STRAINS), F.substring(b, 2, 1)) - 1
        rank = F.coalesce(F.substring(b, 1, 1).try_cast("int"), F.lit(0)) * 5 + strain
        ended = (s["passes"] == 4) | ((s["passes"] == 3) & (s["last"] >= 0))
        foe = (s["last"] >= 0) & (F.pmod(seat - s["last"], F.lit(2)) == 1)
        own = (s["last"] >= 0) & (F.pmod(seat - s["last"], F.lit(2)) == 0)
        ok = ~ended & (ps | (bid & (rank > s["rank"])) | (dbl & foe & (s["dbl"] == "")) | (rdb & own & (s["dbl"] == "X")))
        cell = seat % 2 * 5 + strain  # who of a side named a strain first
        named = F.transform(s["named"], lambda x, i: F.when(bid & (i == cell) & (x < 0), seat).otherwise(x))
        return F.struct(
            (s["legal"] & F.coalesce(ok, F.lit(False))).alias("legal"), (s["n"] + 1).alias("n"), F.when(ps, s["passes"] + 1).otherwise(0).alias("passes"), F.when(bid, rank).otherwise(s["rank"]).alias("rank"), F.when(bid, seat).otherwise(s["last"]).alias("last"),
            F.when(bid, "").when(dbl, "X").when(rdb, "XX").otherwise(s["dbl"]).alias("dbl"), F.when((s["opener"] < 0) & bid, seat).otherwise(s["opener"]).alias("opener"), named.alias("named"), F.when(bid, b).otherwise(s["bid"]).alias("bid"),
        )

    def finish(s):
        over = ((s["passes"] == 3) & (s["last"] >= 0)) | (s["passes"] == 4)
        strain = F.instr(F.lit(B.STRAINS), F.substring(s["bid"], 2, 1)) - 1
        declarer = F.when(s["last"] >= 0, F.element_at(s["named"], (s["last"] % 2 * 5 + strain + 1).cast("int")))
        seat = lambda i: F.when(i >= 0, B.nth(B.SEATS, F.pmod(i, F.lit(4))))
        return F.struct(s["legal"].alias("legal"), over.alias("over"), F.when(over, F.when(s["last"] < 0, "PASS").otherwise(F.concat(s["bid"], s["dbl"], seat(declarer)))).alias("contract"), seat(s["opener"]).alias("opener"), seat(declarer).alias("declarer"), seat(declarer + 1).alias("leader"))

    return F.aggregate(auction, state, step, finish)


def with_analysis(rows: DataFrame, most: int = FEW_AUCTIONS) -> DataFrame:
    """rows(auction, Dealer) with x, the analysis of their auction.

    Deals share their auctions, as those are ways through one rule book: up to most different ones, counted first, are analysed once each and go to the rows; more are analysed row by row.
    """
    x = analyse(F.col("auction"), F.col("Dealer"))
    path = shared_folder(rows.sparkSession, "auction-kinds")
    kinds = rows.select("auction", "Dealer").distinct()
    kinds.limit(most + 1).write.parquet(path)
    kinds = rows.sparkSession.read.schema(kinds.schema).parquet(path)
    if kinds.count() > most:
        return rows.withColumn("x", x)
    kinds = kinds.select(F.col("auction").alias("_auction"), F.col("Dealer").alias("_dealer"), x.alias("x"))
    return rows.join(F.broadcast(kinds), F.col("auction").eqNullSafe(F.col("_auction")) & F.col("Dealer").eqNullSafe(F.col("_dealer")), "left").drop("_auction", "_dealer")
