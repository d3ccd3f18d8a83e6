"""Ratings of pairs and players over sessions.

A session reads the ratings as they were at its start and writes them at its end, so sessions that share
somebody are rated in order of date. Sessions are taken in rounds of whole dates. In a round
those that share somebody in a pool, directly or through others, form a group; groups are rated side by side, a group's sessions in order. Pools
never meet, so each has groups of its own. A round reads and writes the state of those alone who play in it. History and state are tables in the shared folder.

What does not depend on ratings is worked out beforehand, for all sessions side by side: a session's results in a pool are one row of short arrays (pack), and a
group only runs over them.

A group that is too large for one task, which only a single date's can be, is rated in waves instead: the sessions that come first for all who play in them, at once, by joins
and aggregates; then those that come first among the rest. A store goes on from what it has: see rate_batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.folders import remove, shared_folder
from .graph import components

# fixed values of the rating rules
INITIAL, K_BASE, BOOST_UNTIL, BOOST, LOW, HIGH, VISIBLE_AFTER, MOST_PAIRS = 1500.0, 24.0, 100, 1.5, 200.0, 3000.0, 10, 60
SPREAD = 50.0
#: seats that one group, which is one task, does not pass; larger groups of a single date go by waves
GROUP_SEATS = 4_000_000
#: results in one row of a session; those beyond go to further rows
PIECE = 65_536
#: bytes of a row group of packed sessions: each file has all dates in order, and a round reads the groups of its own
ROW_GROUP = 8 << 20
#: tasks that the groups of a round are dealt over at least, so that few groups seldom meet in one
LANES = 64
#: state tables are merged into one when there are more
MOST_STATES = 8

HISTORY = "session_id long, pool string, id string, before double, after double, sessions long, first date, boards long"
STATE = "pool string, id string, rating double, boards long, sessions long"


def stratum_scale(ratio: Column) -> Column:
    """1 up to a spread ratio of 0.8, 0.25 from 1.3 on, linear between; null counts as 1."""
    return F.coalesce(F.when(ratio <= 0.8, 1.0).when(ratio >= 1.3, 0.25).otherwise(1 - 0.75 * (ratio - 0.8) / 0.5), F.lit(1.0))


def strength_scale(z: Column) -> Column:
    """0.25 for fields two deviations below the mean and weaker, 1 from the mean on, linear between; null counts as 1."""
    return F.coalesce(F.when(z >= 0, 1.0).when(z <= -2, 0.25).otherwise(1 + 0.375 * z), F.lit(1.0))


def spread_seed(df: DataFrame, column: str) -> float:
    """Population deviation of a rating column without null and NaN; 50 where there is none above 0. One number comes to the driver."""
    if column not in df.columns:
        return SPREAD
    x = df.where(F.col(column).isNotNull() & ~F.isnan(column)).agg(F.stddev_pop(column)).first()[0]
    return x if x and x > 0 else SPREAD


def unpivot_pairs(df: DataFrame) -> DataFrame:
    """Board results with Pct_NS -> one row a result and side: session_id, Date, board, pool, ids (one sorted pair id), pct, scale.

    scale grows with the size of the section: Section_Pairs, else Num_Pairs, else half of MP_Top and one, at most sixty; 1 without any.
    """
    return _sides(df, [_pairs_of])


def unpivot_players(df: DataFrame) -> DataFrame:
    """The same with the side's two players as ids."""
    return _sides(df, [_players_of])


def _pairs_of(side: str, pct: Column) -> Column:
    return F.struct(F.lit(side).alias("pool"), F.array(pair_id(side)).alias("ids"), pct.alias("pct"))


def _players_of(side: str, pct: Column, pool: str = "") -> Column:
    return F.struct(F.lit(pool + side).alias("pool"), F.array(*[F.col(f"Player_ID_{d}") for d in side]).alias("ids"), pct.alias("pct"))


def pair_id(side: str) -> Column:
    """Both player ids in order, joined; null if one is."""
    both = [F.col(f"Player_ID_{d}") for d in side]
    return F.concat(F.array_min(F.array(*both)), F.lit("-"), F.array_max(F.array(*both)))


def _sides(df: DataFrame, kinds: list) -> DataFrame:
    size = next((F.col(c) for c in ("Section_Pairs", "Num_Pairs") if c in df.columns), F.col("MP_Top") / 2 + 1 if "MP_Top" in df.columns else F.lit(None))
    size = F.coalesce(F.nanvl(size.cast("double"), F.lit(1.0)), F.lit(1.0))
    size = F.when(size == float("inf"), 1.0).otherwise(F.least(size, F.lit(float(MOST_PAIRS))))
    scale = F.when(size > 1, F.sqrt(F.greatest(size - 1, F.lit(1.0)) / 11)).otherwise(1.0)
    rows = df.select("session_id", "Date", F.col("Board").alias("board"), scale.alias("scale"), F.explode(F.array(*[side(p, pct) for side in kinds for p, pct in (("NS", F.col("Pct_NS")), ("EW", 1 - F.col("Pct_NS")))])).alias("x"))
    return rows.select("session_id", "Date", "board", F.monotonically_increasing_id().alias("row"), "x.pool", "x.ids", "x.pct", "scale")


def _numbered(run: np.ndarray, code: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes as numbers from 0 within each run; where each number first stands; where each run's numbers begin. Runs ascend."""
    _, at, number = np.unique(run * (code.max(initial=0) + 1) + code, return_index=True, return_inverse=True)
    begin = np.searchsorted(run[at], np.arange(runs + 1))
    return number - begin[run], at, begin


def _codes(values: pa.Array) -> np.ndarray:
    """Equal values by equal numbers; null is a value."""
    return values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _bytes(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """Slices of numbers as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array, kind: str) -> np.ndarray:
    """The numbers of all binary values, end to end."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind) if len(column) else np.empty(0, kind)


def _one(t: pa.Table, column: str) -> pa.Array:
    c = t[column].combine_chunks()
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c


def _ends(lengths) -> np.ndarray:
    return np.r_[0, np.cumsum(lengths)]


PIECES = "session_id long, first date, pool string, seats long, entries long, ids array<string>, who binary, n binary, field binary, pct binary, scale binary"


def pack(batches: Iterator[pa.RecordBatch], piece: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Entries(session_id, Date, pool, board, ids, pct, scale), sorted by session, date (null last) and pool -> a row a session and pool: PIECES and boards.

    first is the session's first date; ids and boards are the distinct ones. As bytes: who has the place of each seat's id, n the seats of each entry, field the place of its board (ints), pct (NaN for null)
    and scale are by entry (doubles). A session of several dates or of more than about `piece` entries goes to several rows.
    """
    held: list[pa.RecordBatch] = []
    open_session, open_first = None, 0

    def made(t: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
        nonlocal open_session, open_first
        begin, run, runs = np.flatnonzero(new), np.cumsum(new) - 1, int(new.sum())
        # a session's first row has its first date; what has none comes first
        session, day = t["session_id"].to_numpy()[begin], t["Date"].cast(pa.int32()).fill_null(-719162).to_numpy()[begin]
        leads = np.r_[session[0] != open_session, session[1:] != session[:-1]]
        first = np.r_[open_first, day[leads]][np.cumsum(leads)]
        open_session, open_first = session[-1], first[-1]
        ends, n, flat = np.r_[begin, len(new)], pc.list_value_length(t["ids"]).to_numpy(), t["ids"].flatten()
        who, id_at, id_begin = _numbered(np.repeat(run, n), _codes(flat), runs)
        field, board_at, board_begin = _numbered(run, _codes(t["board"]), runs)
        seat_ends = _ends(n)[ends]
        floats = [_bytes(ends, t[c].to_numpy(zero_copy_only=False).astype(float)) for c in ("pct", "scale")]
        columns = [pa.array(session), pa.array(first.astype(np.int32)).cast(pa.date32()), t["pool"].take(pa.array(begin)), pa.array(np.diff(seat_ends).astype(np.int64)), pa.array(np.diff(ends).astype(np.int64)), _lists(id_begin, flat.take(pa.array(id_at))),
                   _bytes(seat_ends, who.astype(np.int32)), _bytes(ends, n.astype(np.int32)), _bytes(ends, field.astype(np.int32)), *floats, _lists(board_begin, t["board"].take(pa.array(board_at)))]
        return pa.RecordBatch.from_arrays(columns, [*(c.split()[0] for c in PIECES.split(", ")), "boards"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        session, pool = t["session_id"].to_numpy(), _codes(t["pool"])
        new = np.r_[True, (session[1:] != session[:-1]) | (pool[1:] != pool[:-1])]
        cut = int(np.flatnonzero(new)[-1])
        if t.num_rows - cut >= piece:
            cut = t.num_rows
        held = [t.slice(cut)] if cut < t.num_rows else []
        if cut:
            yield made(t.slice(0, cut), new[:cut])
    if held:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield made(t, np.arange(t.num_rows) == 0)  # what is held is of one session and pool


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of packed sessions: session_id, first, pool, board, ids, pct, scale."""
    for t in batches:
        who, n, field = (_numbers(t[c], "int32") for c in ("who", "n", "field"))
        row = np.repeat(np.arange(t.num_rows), t["entries"].to_numpy())
        place = lambda c: _ends(pc.list_value_length(t[c]).to_numpy())[:-1]  # noqa: E731, B023
        ids = t["ids"].flatten().take(pa.array(who + np.repeat(place("ids"), t["seats"].to_numpy())))
        columns = [*[t[c].take(pa.array(row)) for c in ("session_id", "first", "pool")], t["boards"].flatten().take(pa.array(field + place("boards")[row])), _lists(_ends(n), ids), *[pa.array(_numbers(t[c], "float64")) for c in ("pct", "scale")]]
        yield pa.RecordBatch.from_arrays(columns, ["session_id", "first", "pool", "board", "ids", "pct", "scale"])


#: history by session and pool, numbers as bytes; rows without a session are the state that a group leaves
RATED = "session_id long, pool string, first date, ids array<string>, before binary, after binary, sessions binary, boards binary"


def rate_group(pieces: pa.Table, state: pa.Table, spread: float) -> pa.Table:
    """RATED of a group of packed sessions, in order of date and id, from the state(pool, id, rating, boards, sessions) at the round's start.

    A session reads the state at its start and writes it at its end. A null id starts anew in each. The field of a result is its board in the whole session, all sections together.
    Alone on a board, one is measured against oneself.
    """
    t = pieces.take(pa.array(np.lexsort((_codes(_one(pieces, "pool")), pieces["session_id"].to_numpy(), pieces["first"].to_numpy()))))
    session, pools, lists = t["session_id"].to_numpy(), _one(t, "pool").dictionary_encode(), _one(t, "ids")
    pool, many_ids = pools.indices.to_numpy(), pc.list_value_length(lists).to_numpy()
    ids, board_lists = lists.flatten().dictionary_encode(null_encoding="encode"), _one(t, "boards")
    code, names, board = ids.indices.to_numpy().astype(np.int64), ids.dictionary, _codes(board_lists.flatten())
    person, named = np.repeat(pool, many_ids) * len(names) + code, names.is_valid().to_numpy(zero_copy_only=False)[code]
    of_ids, of_boards, of_entries, of_seats = (_ends(x) for x in (many_ids, pc.list_value_length(board_lists).to_numpy(), t["entries"].to_numpy(), t["seats"].to_numpy()))
    who, n, field = (_numbers(_one(t, c), "int32") for c in ("who", "n", "field"))
    pct, scale = (_numbers(_one(t, c), "float64") for c in ("pct", "scale"))
    has = ~np.isnan(pct)
    gain, factor = np.where(has, pct, 0.0), np.where(has, K_BASE * scale / n, 0.0)
    played = np.bincount(who + np.repeat(of_ids[:-1], np.diff(of_seats)), np.repeat(has, n), minlength=len(person)).astype(np.int64)
    paired = np.bincount(field + np.repeat(of_boards[:-1], np.diff(of_entries)), minlength=len(board))
    begins, all_single = _ends(n)[:-1], len(who) == len(n)
    # the state by person; a null id's is never kept
    kinds = len(names) * len(pools.dictionary)
    rating, boards, sessions = np.full(kinds, INITIAL), np.zeros(kinds, np.int64), np.zeros(kinds, np.int64)
    place, own_pool = (pc.index_in(_one(state, c), value_set=x) for c, x in (("id", names), ("pool", pools.dictionary)))
    known = np.flatnonzero(pc.and_(place.is_valid(), own_pool.is_valid()).to_numpy(zero_copy_only=False))
    at = own_pool.take(pa.array(known)).to_numpy().astype(np.int64) * len(names) + place.take(pa.array(known)).to_numpy()
    rating[at], boards[at], sessions[at] = (state[c].to_numpy()[known] for c in ("rating", "boards", "sessions"))
    before, after, total_boards, total_sessions, keep = np.empty(len(person)), np.empty(len(person)), np.empty(len(person), np.int64), np.empty(len(person), np.int64), np.ones(len(person), bool)
    units = np.flatnonzero(np.r_[True, (session[1:] != session[:-1]) | (pool[1:] != pool[:-1]), True])  # the rows of a session and pool
    for lo, hi in zip(units[:-1].tolist(), units[1:].tolist()):
        slots, e, r = slice(of_ids[lo], of_ids[hi]), slice(of_entries[lo], of_entries[hi]), slice(of_seats[lo], of_seats[hi])
        mine, played_, who_, field_, pairs = person[slots], played[slots], who[r], field[e], paired[of_boards[lo] : of_boards[hi]]
        if hi - lo > 1:  # persons and fields of several rows are numbered anew
            mine, first_at, number = np.unique(mine, return_index=True, return_inverse=True)
            who_, played_ = number[who_ + np.repeat(of_ids[lo:hi] - of_ids[lo], np.diff(of_seats[lo : hi + 1]))], np.bincount(number, played_).astype(np.int64)
            keep[slots] = False
            slots = slots.start + first_at
            keep[slots] = True
            number = np.unique(board[of_boards[lo] : of_boards[hi]], return_inverse=True)[1]
            field_, pairs = number[field_ + np.repeat(of_boards[lo:hi] - of_boards[lo], np.diff(of_entries[lo : hi + 1]))], np.bincount(number, pairs)
        old, old_boards = rating[mine], boards[mine]
        own = old[who_]
        if not all_single:
            own = np.add.reduceat(own, begins[e] - r.start) / n[e]
        total = np.bincount(field_, own)
        mean = total / pairs
        dev = np.sqrt(np.bincount(field_, (own - mean[field_]) ** 2) / pairs)
        # the rules of stratum_scale and strength_scale
        damp = np.interp(dev / spread, (0.8, 1.3), (1.0, 0.25)) * np.interp((mean - INITIAL) / spread, (-2.0, 0.0), (0.25, 1.0))
        damp[pairs == 1] = 1.0
        rest = np.maximum(pairs - 1, 1)[field_]
        others = np.where(pairs[field_] > 1, (total[field_] - own) / rest, own)
        move = damp[field_] * factor[e] * (gain[e] - 1 / (1 + 10.0 ** ((others - own) / 400)))
        moves = np.bincount(who_, move if all_single else np.repeat(move, n[e]), minlength=len(mine))
        new = np.minimum(np.maximum(old + np.where(old_boards < BOOST_UNTIL, BOOST, 1.0) * moves, LOW), HIGH)
        new_boards, new_sessions = old_boards + played_, sessions[mine] + (played_ > 0)
        before[slots], after[slots], total_boards[slots], total_sessions[slots] = old, new, new_boards, new_sessions
        stay = named[slots]
        if not stay.all():
            mine, new, new_boards, new_sessions = mine[stay], new[stay], new_boards[stay], new_sessions[stay]
        rating[mine], boards[mine], sessions[mine] = new, new_boards, new_sessions
    if not keep.all():
        lists = _lists(_ends(np.bincount(np.repeat(np.arange(len(session)), many_ids), keep, len(session)).astype(np.int64)), lists.flatten().filter(pa.array(keep)))
        before, after, total_boards, total_sessions = before[keep], after[keep], total_boards[keep], total_sessions[keep]
    ends = _ends(pc.list_value_length(lists).to_numpy())
    history = [t["session_id"], t["pool"], t["first"], lists, *[_bytes(ends, x) for x in (before, after, total_sessions, total_boards)]]
    there = np.unique(person[named])
    ends = np.searchsorted(there, np.arange(len(pools.dictionary) + 1) * len(names))
    of_pool = [pools.dictionary, _lists(ends, names.take(pa.array(there % len(names)))), *[_bytes(ends, x[there]) for x in (rating, rating, sessions, boards)]]
    none = lambda kind: pa.nulls(len(pools.dictionary), kind)
    columns = [c.split()[0] for c in RATED.split(", ")]
    return pa.concat_tables([pa.table(history, names=columns), pa.table([none(pa.int64()), of_pool[0], none(pa.date32()), *of_pool[1:]], names=columns)]).cast(pa.schema([(c, pa.table(history, names=columns).schema.field(c).type) for c in columns]))


def _unrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RATED -> HISTORY."""
    for t in batches:
        row = pa.array(np.repeat(np.arange(t.num_rows), pc.list_value_length(t["ids"]).to_numpy()))
        before, after, sessions, boards = (pa.array(_numbers(t[c], kind)) for c, kind in (("before", "float64"), ("after", "float64"), ("sessions", "int64"), ("boards", "int64")))
        yield pa.RecordBatch.from_arrays([t["session_id"].take(row), t["pool"].take(row), t["ids"].flatten(), before, after, sessions, t["first"].take(row), boards], [c.split()[0] for c in HISTORY.split(", ")])


def _latest(states: list[DataFrame]) -> DataFrame:
    """The last state of each id; later tables are later rounds."""
    every = None
    for n, s in enumerate(states):
        s = s.select("pool", "id", "rating", "boards", "sessions", F.lit(n).alias("n"))
        every = s if every is None else every.unionByName(s)
    last = every.groupBy("pool", "id").agg(F.max_by(F.struct("rating", "boards", "sessions"), "n").alias("s"))
    return last.select("pool", "id", "s.rating", "s.boards", "s.sessions")


def _groups(seats: DataFrame, folder: str, *more: str) -> DataFrame:
    """(session_id, *more, g): sessions that share a pool's id, directly or through others; with more = pool, each pool by itself. Sessions without ids have none."""
    link = F.struct(F.concat_ws("=", F.lit("s"), F.col("session_id").cast("string"), *more).alias("a"), F.concat("pool", F.lit("="), "id").alias("b"))
    links = seats.where("id is not null").select(F.xxhash64(link["a"]).alias("a"), F.xxhash64(link["b"]).alias("b"), "session_id", *more).distinct()
    # equal hashes would only make a group larger
    found = components(links.select("a", "b"), f"{folder}/groups")
    return links.select("session_id", *more, "a").distinct().join(found, F.col("a") == F.col("v")).select("session_id", *more, F.col("component").alias("g"))


def rate_wave(seats: DataFrame, spread: float) -> DataFrame:
    """History rows of sessions of which no two share an id, by the rules of rate_group; seats carry the state at the sessions' start (null: none yet)."""
    rating, boards, sessions = F.coalesce("rating", F.lit(INITIAL)), F.coalesce("boards", F.lit(0)), F.coalesce("sessions", F.lit(0))
    seats = seats.withColumns({"rating": rating, "boards": boards, "sessions": sessions})
    entry, field = ["session_id", "pool", "board", "row"], ["session_id", "pool", "board"]
    own = seats.groupBy(*entry).agg(F.avg("rating").alias("own"))
    fields = own.groupBy(*field).agg(F.count(F.lit(1)).alias("pairs"), F.sum("own").alias("total"), F.avg("own").alias("mean"), F.stddev_pop("own").alias("dev"))
    damp = F.when(F.col("pairs") > 1, stratum_scale(F.col("dev") / spread) * strength_scale((F.col("mean") - INITIAL) / spread)).otherwise(1.0)
    others = F.when(F.col("pairs") > 1, (F.col("total") - F.col("own")) / (F.col("pairs") - 1)).otherwise(F.col("own"))
    expected = 1 / (1 + F.pow(F.lit(10.0), -(F.col("own") - F.col("others")) / 400))
    judged = own.join(fields, field).withColumn("others", others).select(*entry, damp.alias("damp"), expected.alias("expected"))
    boost = F.when(F.col("boards") < BOOST_UNTIL, BOOST).otherwise(1.0)
    has = F.col("pct").isNotNull() & ~F.isnan("pct")
    move = F.when(has, K_BASE * F.col("damp") * F.col("scale") * boost * (F.col("pct") - F.col("expected")) / F.col("n")).otherwise(0.0)
    out = seats.join(judged, entry).groupBy("session_id", "pool", "id").agg(
        F.first("rating").alias("before"), F.first("boards").alias("b"), F.first("sessions").alias("s"), F.first("first").alias("first"), F.sum(move).alias("move"), F.sum(has.cast("long")).alias("played")
    )
    after = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.col("before") + F.col("move")))
    return out.select("session_id", "pool", "id", "before", after.alias("after"), (F.col("s") + (F.col("played") > 0).cast("long")).alias("sessions"), "first", (F.col("b") + F.col("played")).alias("boards"))


def _by_waves(seats: DataFrame, folder: str, spread: float) -> DataFrame:
    """History of seats of any number that carry the state at their start, wave by wave; a wave's jobs have as many tasks as its boards need."""
    spark = seats.sparkSession
    seats = _kept(seats, f"{folder}/seats")
    plays = _kept(seats.where("id is not null").select("first", "session_id", "pool", "id").distinct(), f"{folder}/plays")
    order = F.struct("first", "session_id")
    rest = _kept(seats.select("first", "session_id").distinct(), f"{folder}/rest-0")
    state, waves = None, 0
    while rest.limit(1).count():
        mine = plays.join(rest.select("session_id"), "session_id")
        first = mine.groupBy("pool", "id").agg(F.min(order).alias("at"))
        later = mine.join(first, ["pool", "id"]).where(order != F.col("at")).select("session_id").distinct()
        ready = _kept(rest.join(later, "session_id", "left_anti"), f"{folder}/ready-{waves}")
        now = seats.join(ready.select("session_id"), "session_id")
        if state is not None:
            new = state.select("pool", "id", *[F.col(c).alias(f"_{c}") for c in ("rating", "boards", "sessions")])
            now = now.join(new, ["pool", "id"], "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("rating", "boards", "sessions")}).drop("_rating", "_boards", "_sessions")
        done = _kept(rate_wave(now, spread).select(*[c.split()[0] for c in HISTORY.split(", ")]), f"{folder}/history/{waves}")
        fresh = done.where("id is not null").select("pool", "id", F.col("after").alias("rating"), "boards", "sessions")
        state = _kept(_latest([fresh] if state is None else [state, fresh]), f"{folder}/state-{waves}")
        waves += 1
        rest = _kept(rest.join(ready.select("session_id"), "session_id", "left_anti"), f"{folder}/rest-{waves}")
    return spark.read.schema(HISTORY).parquet(*[f"{folder}/history/{i}" for i in range(waves)])


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _entries(rows: DataFrame) -> DataFrame:
    """Rows of unpivot_*, dealt by session and sorted as pack needs them."""
    rows = rows.where(F.size("ids") > 0).select(F.col("session_id").cast("long").alias("session_id"), F.col("Date").cast("date").alias("Date"), "pool", "board", "ids", F.col("pct").cast("double").alias("pct"), F.col("scale").cast("double").alias("scale"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "session_id").sortWithinPartitions("session_id", F.asc_nulls_last("Date"), "pool")


def _seats(entries: DataFrame) -> DataFrame:
    """A row a seat."""
    numbered = entries.select("*", F.monotonically_increasing_id().alias("row"), F.size("ids").alias("n"))
    return numbered.select("session_id", "first", "board", "row", "pool", F.explode("ids").alias("id"), "n", "pct", "scale")


def _packed(entries: DataFrame, path: str) -> DataFrame:
    """Packed sessions as a table, each file in order of date."""
    schema = T.StructType.fromDDL(PIECES).add("boards", T.ArrayType(entries.schema["board"].dataType))
    entries.mapInArrow(pack, schema).sortWithinPartitions("first", "session_id").write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return entries.sparkSession.read.schema(schema).parquet(path)


def _unpacked(pieces: DataFrame) -> DataFrame:
    board = pieces.schema["boards"].dataType.elementType.simpleString()
    return pieces.mapInArrow(unpack, f"session_id long, first date, pool string, board {board}, ids array<string>, pct double, scale double")


def _visible(history: DataFrame, visible_after: int) -> DataFrame:
    seen = lambda c: F.when(F.col("sessions") >= visible_after, F.col(c))
    return history.select("session_id", "pool", "id", "before", "after", seen("before").alias("seen_before"), seen("after").alias("seen_after"))


def rate(rows: DataFrame, spread: float = SPREAD, visible_after: int = VISIBLE_AFTER, group_seats: int = GROUP_SEATS) -> DataFrame:
    """History (session_id, pool, id, before, after, seen_before, seen_after) of all sessions in order.

    seen_*: null until the id has played visible_after sessions, this one included;
    a session without a percentage for it does not count. A session whose rows carry several dates is one session
    at its first date. Null percentages enter the field means but change no rating. group_seats bounds what one task
    takes; it does not change results. Without rows there is no history.
    """
    return _visible(_history(_entries(rows), None, spread, group_seats), visible_after)


def rate_both(df: DataFrame, spread: float = SPREAD, visible_after: int = VISIBLE_AFTER, group_seats: int = GROUP_SEATS) -> tuple[DataFrame, DataFrame]:
    """The histories of pairs and of players, rated side by side in the same rounds: rate(unpivot_pairs(df)) and rate(unpivot_players(df))."""
    mark = "players "
    done = rate(_sides(df, [_pairs_of, lambda side, pct: _players_of(side, pct, mark)]), spread, visible_after, group_seats)
    single = F.startswith("pool", F.lit(mark))
    return done.where(~single), done.where(single).withColumn("pool", F.substring("pool", len(mark) + 1, 2))


def _history(entries: DataFrame, start: DataFrame | None, spread: float, group_seats: int) -> DataFrame:
    """The full history of the sessions of entries, from the state start(pool, id, rating, boards, sessions) if there is one."""
    spark = entries.sparkSession
    folder = shared_folder(spark, "ratings")
    pieces = _packed(entries, f"{folder}/pieces")
    of_pool = pieces.groupBy("first", "pool").agg(F.sum("seats").alias("n"))
    sizes = of_pool.groupBy("first").agg(F.max("n").alias("n")).orderBy("first").toArrow()  # twelve bytes a date
    days, until = sizes["first"].to_numpy(), _ends(sizes["n"].to_numpy())
    lanes = max(LANES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    states, waves, at, n, width, limit = [] if start is None else [start], [], 0, 0, group_seats, None
    while at < len(days):
        end = max(at + 1, int(np.searchsorted(until, until[at] + width, "right")) - 1)
        size = until[end] - until[at]
        part = pieces.where(F.col("first").between(F.lit(days[at].item()), F.lit(days[end - 1].item())))
        if size <= group_seats:
            part, largest = part.withColumn("g", F.xxhash64("pool")), size
        else:
            groups = _kept(_groups(part.select("session_id", "pool", F.explode("ids").alias("id")), folder, "pool"), f"{folder}/groups/{n}-{width}")
            part = part.join(groups, ["session_id", "pool"], "left").withColumn("g", F.coalesce("g", F.xxhash64("session_id", "pool")))
            largest = part.groupBy("g").agg(F.sum("seats").alias("n")).agg(F.max("n")).first()[0]
        if largest > group_seats and end - at > 1:  # too large a group: fewer dates from now on
            limit, width = width, max(1, width // 2)
            continue
        # each state goes to the group that its id plays in
        state = spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in f"{STATE}, g long".split(", "))])
        if states:
            home = part.select(F.col("g").alias("g"), "pool", F.explode("ids").alias("id")).where("id is not null").distinct()
            state = _latest(states).join(home.hint("merge"), ["pool", "id"])
        fresh = []
        if largest > group_seats:
            large = part.groupBy("g").agg(F.sum("seats").alias("size")).where(F.col("size") > group_seats).select("g")
            made = _by_waves(_seats(_unpacked(part.join(large, "g", "left_semi").drop("g"))).join(state.drop("g"), ["pool", "id"], "left"), f"{folder}/waves/{n}", spread)
            waves.append(f"{folder}/history/waves-{n}")
            last = _kept(made.select(*[c.split()[0] for c in HISTORY.split(", ")]), waves[-1]).where("id is not null")
            last = last.groupBy("pool", "id").agg(F.max_by(F.struct(F.col("after").alias("rating"), "boards", "sessions"), F.struct("first", "session_id")).alias("s"))
            fresh.append(_kept(last.select("pool", "id", "s.*"), f"{folder}/state/waves-{n}"))
            remove(spark, f"{folder}/waves/{n}")
            part, state = (x.join(large, "g", "left_anti") for x in (part, state))
        one = part.repartition(lanes, "g").groupBy("g").cogroup(state.repartition(lanes, "g").groupBy("g"))
        rated = _kept(one.applyInArrow(lambda a, b: rate_group(a, b, spread), RATED), f"{folder}/history/{n}")
        left = rated.where("session_id is null").mapInArrow(_unrated, HISTORY)
        fresh.append(_kept(left.select("pool", "id", F.col("after").alias("rating"), "boards", "sessions"), f"{folder}/state/{n}"))
        states.extend(fresh)
        if len(states) > MOST_STATES:
            states = [_kept(_latest(states), f"{folder}/state/to-{n}")]
        at, n = end, n + 1
        if limit is None or width * 2 < limit:
            width *= 2
    for done in ("pieces", "state", "groups"):
        remove(spark, f"{folder}/{done}")
    if not n:
        return spark.createDataFrame([], HISTORY)
    rated = spark.read.schema(RATED).parquet(*[f"{folder}/history/{i}" for i in range(n)])
    done = rated.where("session_id is not null").mapInArrow(_unrated, HISTORY)
    return done if not waves else done.unionByName(spark.read.schema(HISTORY).parquet(*waves))


ROWS = "session_id long, Date date, board int, row string, pool string, ids array<string>, pct double, scale double"


def _stored(spark: SparkSession, path: str, schema: str, before: int | None) -> DataFrame:
    """The store's table with the batch b of each row; only batches before a number if one is given."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{schema}, b int")
    df = spark.read.schema(f"{schema}, b int").parquet(path)
    return df if before is None else df.where(F.col("b") < before)


def _newest(history: DataFrame) -> DataFrame:
    """Of a session's rows those of its latest replay: a session is replayed whole."""
    last = history.groupBy("session_id").agg(F.max("b").alias("b"))
    return history.join(last, ["session_id", "b"]).drop("b")


def rate_batch(rows: DataFrame, store: str, number: int, spread: float = SPREAD, group_seats: int = GROUP_SEATS) -> int:
    """Take the batch `number` (0, 1, 2 ...) of rows of unpivot_* into the store, a folder; gives how many sessions were rated.

    Sessions may come late, in any order, and in parts. From the first date of the batch on, those stored sessions are rated again which share somebody with the batch's, directly or through others
    that play from that date on; all others keep their history. The state at that date is looked up in the history, of those who play alone. A batch writes its own folders
    and reads earlier ones, so that it may be run again. Any split of sessions into batches ends in the same history as one run.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, "rating-batch")
    columns = [c.split()[0] for c in ROWS.split(", ")]
    new = rows.select(*[(F.concat(F.lit(f"{number}-"), F.col("row").cast("string")) if c.startswith("row ") else F.col(c.split()[0])).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in ROWS.split(", ")])
    new.write.mode("overwrite").parquet(f"{store}/rows/b={number}")
    every = _stored(spark, f"{store}/rows", ROWS, number + 1)
    mine = every.where(F.col("b") == number).select("session_id").distinct()
    day = F.coalesce(F.min("Date"), F.lit("0001-01-01").cast("date"))
    dates = _kept(every.groupBy("session_id").agg(day.alias("first")), f"{folder}/dates")
    cut = dates.join(mine, "session_id").agg(F.min("first")).first()[0]  # one date
    if cut is None:
        spark.createDataFrame([], HISTORY).write.mode("overwrite").parquet(f"{store}/history/b={number}")
        remove(spark, folder)
        return 0
    open_ = every.join(dates.where(F.col("first") >= F.lit(cut)).select("session_id"), "session_id", "left_semi")
    entries = _kept(_entries(open_.select(*columns)), f"{folder}/entries")
    seats = entries.select("session_id", "pool", F.explode("ids").alias("id"))
    groups = _kept(_groups(seats, folder), f"{folder}/of-session")
    touched = groups.join(mine, "session_id").select("g").distinct()
    again = groups.join(touched, "g").select("session_id").union(mine).distinct()
    seats = seats.join(again, "session_id", "left_semi")
    history = _newest(_stored(spark, f"{store}/history", HISTORY, number)).where((F.col("first") < F.lit(cut)) & F.col("id").isNotNull())
    who = seats.where("id is not null").select("pool", "id").distinct()
    state = history.join(who, ["pool", "id"], "left_semi").groupBy("pool", "id").agg(F.max_by(F.struct(F.col("after").alias("rating"), "boards", "sessions"), F.struct("first", "session_id")).alias("s"))
    state = _kept(state.select("pool", "id", "s.*"), f"{folder}/state")
    _history(_entries(entries.join(again, "session_id", "left_semi")), state, spread, group_seats).write.mode("overwrite").parquet(f"{store}/history/b={number}")
    done = spark.read.schema(HISTORY).parquet(f"{store}/history/b={number}").select("session_id").distinct().count()
    remove(spark, folder)
    return done


def stored_ratings(spark: SparkSession, store: str, visible_after: int = VISIBLE_AFTER) -> DataFrame:
    """The history that a store has now, as rate gives it."""
    return _visible(_newest(_stored(spark, f"{store}/history", HISTORY, None)), visible_after)


def session_start_end(df: DataFrame, pairs: DataFrame | None = None, players: DataFrame | None = None) -> DataFrame:
    """Elo_p_Start and Elo_p_End of both pairs and Elo_d_Start and Elo_d_End of the four players on every board result, from their histories; null until they are seen.

    A side's two players meet the histories once a session, not once a result; results then meet their sides.
    """
    given = [("pair", pairs)] * (pairs is not None) + [("player", players)] * (players is not None)
    for side in ("NS", "EW"):
        a, b = (f"Player_ID_{d}" for d in side)
        jobs = [x for kind, history in given for x in ([(side, pair_id(side), history)] if kind == "pair" else [(d, F.col(f"Player_ID_{d}"), history) for d in side])]
        seated = df.select("session_id", a, b).distinct()
        for name, who, history in jobs:
            mine = history.where((F.col("pool") == side) & F.col("id").isNotNull()).select("session_id", F.col("id").alias("_id"), F.col("seen_before").alias(f"Elo_{name}_Start"), F.col("seen_after").alias(f"Elo_{name}_End"))
            seated = seated.withColumn("_id", who).join(mine.hint("merge"), ["session_id", "_id"], "left").drop("_id")
        if jobs:
            seated = seated.withColumnsRenamed({"session_id": "_session", a: "_a", b: "_b"}).hint("merge")
            df = df.join(seated, (F.col("session_id") == F.col("_session")) & F.col(a).eqNullSafe(F.col("_a")) & F.col(b).eqNullSafe(F.col("_b")), "left").drop("_session", "_a", "_b")
    return df


def stage(name: str, needs: list[str], gives: list[str], run):
    """A pipeline stage: refuses frames without the columns it needs, skips work already there, checks what it promised."""

    def apply(df: DataFrame) -> DataFrame:
        if missing := [c for c in needs if c not in df.columns]:
            raise ValueError(f"{name}: columns {missing} are missing")
        if all(c in df.columns for c in gives):
            return df
        out = run(df)
        if lacking := [c for c in gives if c not in out.columns]:
            raise ValueError(f"{name} did not make {lacking}")
        return out

    return apply


def rating_pipeline(df: DataFrame, spread: float = SPREAD, visible_after: int = VISIBLE_AFTER) -> DataFrame:
    """Board results -> top, percentages, pair ratings, player ratings, start and end columns of both."""
    from . import matchpoints as M

    for s in (stage("matchpoints", ["session_id", "section_id", "Board", "Score_NS"], ["MP_NS", "MP_Top"], M.matchpoints), stage("percentages", ["MP_NS", "MP_Top"], ["Pct_NS"], M.percentages)):
        df = df.transform(s)
    # both ratings are made from the percentages, not through the joins of the other's columns, and together if neither is there
    scored = df
    of_pairs, of_players = ["Elo_NS_Start", "Elo_EW_End"], ["Elo_N_Start", "Elo_W_End"]
    if not any(c in df.columns for c in of_pairs + of_players):
        return df.transform(stage("ratings", ["Pct_NS", "Date"], of_pairs + of_players, lambda d: session_start_end(d, *rate_both(scored, spread, visible_after))))
    pairs = stage("pair ratings", ["Pct_NS", "Date"], of_pairs, lambda d: session_start_end(d, pairs=rate(unpivot_pairs(scored), spread, visible_after)))
    players = stage("player ratings", ["Pct_NS", "Date"], of_players, lambda d: session_start_end(d, players=rate(unpivot_players(scored), spread, visible_after)))
    for s in (pairs, players):
        df = df.transform(s)
    return df


def contract_pipeline(df: DataFrame, deals: DataFrame | None = None) -> DataFrame:
    """Board results -> dealer, vulnerability, contract parts, scores by side, results, flags, matchpoints.

    With deals(deal_id, Board, cells, Par_NS, EV_Max_NS, EV_Max_EW), a row a deal, also trick table, theoretical scores, par, expected values and roles: the full augmentation.
    """
    from . import contracts as C
    from . import deals as D
    from . import matchpoints as M

    stages = [
        stage("dealer", ["Board"], ["Dealer"], D.add_dealer), stage("vulnerability", ["Board"], ["Vul", "iVul"], D.add_vulnerability), stage("contract", ["Contract"], ["BidLvl", "Declarer_Pair"], C.split_contract),
        stage("scores", ["BidLvl"], ["Score_NS", "Score_EW", "Score_Declarer"], C.side_scores), stage("tricks", ["Result"], ["Tricks_From_Result"], C.tricks_from_result), stage("flags", ["Result"], ["OverTricks"], C.trick_flags),
        stage("matchpoints", ["Score_NS"], ["MP_NS", "MP_Top"], M.matchpoints), stage("percentages", ["MP_NS"], ["Pct_NS"], M.percentages),
    ]
    if deals is not None:
        stages += [
            stage("trick table, par, expected values", ["deal_id", "BidSuit"], ["DD_Tricks", "Par_NS", "EV_Max_NS"], lambda d: C.join_deals(d, deals)), stage("theoretical scores", ["DD_Tricks"], ["DD_Score_Declarer"], C.dd_score),
            stage("differences", ["Par_NS", "EV_Max_NS", "Tricks"], ["Par_Diff_NS", "EV_Max_Diff_NS"], C.differences), stage("roles", ["DD_Score_Declarer", "Par_NS"], ["Is_Par_Contract", "Defender_Par_GE"], C.roles),
        ]
    for s in stages:
        df = df.transform(s)
    return df
