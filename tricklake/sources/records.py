"""Game records: text files of `key|value|` fields, one or more boards a file, to board rows.

Keys read: qx (a board begins; o or c and its number), pn (players: South, West, North, East; of two tables eight), vg (event), ah (board title),
md (dealer 1 to 4 for South, West, North, East; hands in that order, the last may be left out), sv (vulnerability), mb (a call; a bang alerts it),
an (what the call before means), pc (a card played), mc (tricks of the declaring side, claimed). Others are passed over.

Fields are found by the bars of whole files, a few megabytes at a time, hands and play are worked out in arrays of a batch's boards; no Python runs for a board.
A hand is a row of 52 marks, so the hand that is left out is what three leave over. Auctions, contracts, scores and issues are expressions.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bridge as B
from ..functions.rows import computed
from .folders import shared_folder

# fixed values of the record format and of the names in board rows
EMPTY_DEAL = "N:... ... ... ..."
DENOMS = {"S": "spades", "H": "hearts", "D": "diamonds", "C": "clubs", "N": "nt"}
PLAYERS = ("north", "east", "south", "west")
PENALTIES = {"passed": "", "doubled": "X", "redoubled": "XX"}
VULS = {"o": 0, "0": 0, "-": 0, "": 0, "b": 1, "n": 2, "e": 3}
#: Seats by N, E, S, W = 0 to 3 in the order of the record's hands and players.
RECORD_SEATS = (2, 3, 0, 1)

_int = lambda c: c.cast("int")


def read_record_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(source_file, value) of whole files; value is null where a file's bytes are no UTF-8. Files of no bytes give no row."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    return reader.format("binaryFile").load(path).select(F.col("path").alias("source_file"), F.try_validate_utf8(F.col("content").cast("string")).alias("value"))


def _word_bytes() -> np.ndarray:
    """The lower-cased byte for each byte of a word, 0 for others."""
    out = np.zeros(256, np.int32)
    for c in string.ascii_letters + string.digits + "_":
        out[ord(c)] = ord(c.lower())
    return out


_WORD = _word_bytes()
_key = lambda k: ord(k[0]) * 256 + ord(k[1])


def _runs(n: np.ndarray) -> pa.Array:
    """Offsets of lists of so many elements."""
    return pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))


def _card_codes(texts: pa.Array) -> pa.Array:
    """Codes of cards, suit by suit from spades, high to low; null for what is no card. Each distinct text is read once."""
    different = texts.dictionary_encode()
    plain = [t.upper().replace("10", "T") for t in different.dictionary.to_pylist()]
    codes = [B.SUITS.index(t[0]) * 13 + B.RANKS.index(t[1]) if len(t) == 2 and t[0] in B.SUITS and t[1] in B.RANKS else None for t in plain]
    return pa.array(codes, pa.int8()).take(different.indices)


def _fields(files: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Whole files to a row a board (see _BOARD); a file without boards gives one row without a board's number."""
    lists = pc.split_pattern(texts.fill_null(""), "|")
    pieces, ends = lists.flatten(), lists.offsets.to_numpy()
    off = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
    data = np.frombuffer(b"\0\0" + (pieces.buffers()[2] or b""), np.uint8)
    # a key is the two word bytes before a bar, its value is what follows up to the next bar
    one, two = _WORD[data[off[1:]]], _WORD[data[off[1:] + 1]]
    open_end = np.zeros(len(pieces), bool)
    open_end[ends[1:] - 1] = True
    may = (np.diff(off) >= 2) & (one > 0) & (two > 0) & ~open_end
    # after a piece that can't be a key a key may follow; in a run of those that can, keys and values alternate
    fresh = np.concatenate(([True], ~may[:-1])) if len(may) else may
    fresh[ends[:-1]] = True
    at = np.arange(len(pieces))
    is_key = may & ((at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0)
    is_key[:-1] &= ~open_end[1:]
    keys = np.flatnonzero(is_key)
    code, file = one[keys] * 256 + two[keys], np.repeat(np.arange(len(texts)), np.diff(ends))[keys]
    has_qx = np.zeros(len(texts), bool)
    has_qx[file[code == _key("qx")]] = True
    start = np.flatnonzero(code == np.where(has_qx[file], _key("qx"), _key("md")))
    n, owner = len(start), file[start]
    board = np.searchsorted(start, np.arange(len(keys)), "right") - 1
    board[(board >= 0) & (owner[board] != file if n else False)] = -1
    end = np.searchsorted(file, owner, "right")
    if n:
        end[:-1] = np.minimum(end[:-1], start[1:])
    bare = np.setdiff1d(np.arange(len(texts)), owner)
    whose = np.concatenate((owner, bare))
    value = lambda i: pc.utf8_trim(pieces.take(pa.array(np.where(i < 0, 0, keys[np.maximum(i, 0)] + 1) if len(keys) else np.zeros(len(i), int), mask=i < 0)), " ")

    def first(key: str, group: np.ndarray, n: int) -> np.ndarray:
        """The place of the first field of a key in each group, -1 without one."""
        i, out = np.flatnonzero((code == _key(key)) & (group >= 0)), np.full(n, -1)
        out[group[i][::-1]] = i[::-1]
        return out

    def last_names() -> np.ndarray:
        i = np.flatnonzero(code == _key("pn"))
        k = np.searchsorted(i, np.concatenate((end, np.searchsorted(file, bare, "right")))) - 1
        found = i[np.maximum(k, 0)] if len(i) else np.zeros(len(k), int)
        return np.where((k >= 0) & (file[found] == whose if len(i) else False), found, -1)

    def each(key: str) -> tuple[np.ndarray, pa.Array]:
        """All fields of a key and where each row's begin."""
        i = np.flatnonzero((code == _key(key)) & (board >= 0))
        return i, _runs(np.concatenate((np.bincount(board[i], minlength=n), np.zeros(len(bare), int))))

    none = pa.array(np.arange(n + len(bare)) >= n)
    listed = lambda runs, values: pa.ListArray.from_arrays(runs, values, mask=none)
    (calls, of_calls), (cards, of_cards) = each("mb"), each("pc")
    after = np.minimum(calls + 1, len(keys) - 1)
    told = np.where((after > calls) & (code[after] == _key("an")) & (board[after] == board[calls]), after, -1)
    numbers = np.arange(n) - np.searchsorted(owner, owner)
    single = [value(np.concatenate((first(k, board, n), np.full(len(bare), -1)))) for k in ("md", "sv", "ah", "qx", "mc")]
    return pa.RecordBatch.from_arrays([
        files.take(pa.array(whose)), pa.array(np.concatenate((numbers, bare)), pa.int32(), mask=none.to_numpy(zero_copy_only=False)), *single, value(last_names()), value(first("vg", file, len(texts))[whose]),
        listed(of_calls, value(calls)), listed(of_calls, value(told)), listed(of_cards, _card_codes(value(cards))),
    ], ["source_file", "board", "md", "sv", "ah", "qx", "mc", "names", "event", "said", "told", "cards"])


_BOARD = "source_file string, board int, md string, sv string, ah string, qx string, mc string, names string, event string, said array<string>, told array<string>, cards array<tinyint>"
#: bytes of text whose fields a task holds at once; one file may be longer
CHUNK = 2 << 20


def _boards(texts: DataFrame) -> DataFrame:
    """A row a board: source_file, board (its place in the file; null without any), the first of each single field, names (of the players, given last up to its end), event, what was said and told with it, cards as codes."""

    def rows(batches):
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + CHUNK, "right")))
                yield _fields(batch.column(0).slice(a, b - a), pa.concat_arrays([batch.column(1).slice(a, b - a)]))
                a = b

    df = texts.select("source_file", "value").mapInArrow(rows, _BOARD)
    return df.withColumns({"names": F.split("names", ","), "event": F.get(F.split("event", ","), F.lit(0))})


_KIND = np.full(256, 99, np.int16)  # ranks by their place, suits from 20, a comma 30
for _i, _c in enumerate(B.RANKS):
    _KIND[ord(_c)] = _i
for _i, _c in enumerate(B.SUITS):
    _KIND[ord(_c)] = 20 + _i
_KIND[ord(",")] = 30


def _held(deals: pa.Array) -> np.ndarray:
    """Which cards the hands (N, E, S, W) hold, row by row: the cards after the first letter of each suit, of a hand left out what three leave over."""
    n, deals = len(deals), deals.fill_null("")
    off = np.frombuffer(deals.buffers()[1], np.int32)[deals.offset : deals.offset + n + 1]
    kind = _KIND[np.frombuffer(deals.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]]
    row, at = np.repeat(np.arange(n), np.diff(off)), np.arange(len(kind))
    begin = (off[:-1] - off[0])[row]
    commas = np.cumsum(kind == 30) - (kind == 30)
    hand = commas - commas[begin]
    suit = (kind >= 20) & (kind < 24)
    # the suit letter, comma or beginning that a card follows
    owner = np.maximum.accumulate(np.where(suit | (kind == 30) | (at == begin), at, 0))
    letters = np.flatnonzero(suit & (hand < 4))
    good = np.zeros(len(kind), bool)
    good[letters[np.unique((row[letters] * 4 + hand[letters]) * 4 + kind[letters] - 20, return_index=True)[1]]] = True
    use = np.flatnonzero((kind < 13) & good[owner])
    held = np.zeros((n, 4, 52), bool)
    held[row[use], hand[use], (kind[owner[use]] - 20) * 13 + kind[use]] = True
    sizes, union = held.sum(2), held.any(1)
    left = (union.sum(1) == 39) & (np.sort(sizes, axis=1) == (0, 13, 13, 13)).all(1)
    i, seat = np.nonzero(left[:, None] & (sizes == 0))
    held[i, seat] = ~union[i]
    return held[:, [RECORD_SEATS.index(seat) for seat in range(4)]]


def _hand_texts(held: np.ndarray) -> pa.Array:
    """Lists of four hands, suits from spades joined by dots."""
    shown = np.ones((len(held) * 4, 55), bool)
    at = np.arange(52) + np.arange(52) // 13
    shown[:, at] = held.reshape(-1, 52)
    chars = np.full(55, ord("."), np.uint8)
    chars[at] = np.frombuffer((B.RANKS * 4).encode(), np.uint8)
    texts = pa.StringArray.from_buffers(len(shown), _runs(shown.sum(1)).buffers()[1], pa.py_buffer(np.ascontiguousarray(np.broadcast_to(chars, shown.shape)[shown])))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * 4), texts)


def winners(four: np.ndarray, trump: np.ndarray) -> np.ndarray:
    """Places (0 to 3) of the cards that take tricks of four: the highest trump, else the highest of the suit led."""
    suit = four // 13
    return (np.where(suit == trump[:, None], 200, np.where(suit == suit[:, :1], 100, 0)) + 12 - four % 13).argmax(1)


_FLAGS = ("dealt", "whole", "known", "twice", "unheld")
_LIST = T.ArrayType(T.StringType())
_PLAY = T.StructType([T.StructField("hands", _LIST), *[T.StructField(x, T.BooleanType()) for x in _FLAGS], T.StructField("taken", T.IntegerType()), T.StructField("play_rank", _LIST), T.StructField("play_suit", _LIST)])


@F.arrow_udf(_PLAY)
def _play(deal: pa.Array, cards: pa.Array, declarer: pa.Array, trump: pa.Array) -> pa.Array:
    """Hands of record texts and what the cards played tell: of _PLAY, unheld is whether one was not in its hand, taken the tricks of the declaring side (the last trick may be left out)."""
    n, ints = len(deal), lambda a: a.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int16)
    held, decl, trump = _held(deal), ints(declarer), ints(trump)
    whole = (held.sum(2) == 13).all(1) & held.any(1).all(1)
    every, size = cards.flatten(), cards.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    codes, row = ints(every), np.repeat(np.arange(n), size)
    place = np.arange(len(codes)) - (np.cumsum(size) - size)[row]
    count = np.bincount(row * 53 + codes + 1, minlength=53 * n).reshape(n, 53)
    known, played = count[:, 0] == 0, count[:, 1:] > 0
    card = np.full((n, 52), -1, np.int16)
    card[row[place < 52], place[place < 52]] = codes[place < 52]
    tricks = np.where(known & (decl >= 0), np.minimum(size // 4, 12), 0)
    leader = np.full((n, 13), -1, np.int16)
    leader[:, 0] = np.where(decl >= 0, (decl + 1) % 4, -1)
    for t in range(12):
        leader[:, t + 1] = np.where(tricks > t, (leader[:, t] + winners(card[:, 4 * t : 4 * t + 4], trump)) % 4, -1)
    # the last trick may be left out: each hand has one card then
    rest = held & ~played[:, None]
    only, last, who = np.where(rest.sum(2) == 1, rest.argmax(2), -1), card[:, 48:].copy(), leader[:, 12]
    for i in range(4):
        last[:, i] = np.where(size > 48 + i, last[:, i], np.where(who >= 0, only[np.arange(n), (who + i) % 4], -1))
    told = known & (size >= 48) & (size <= 52) & (who >= 0) & (last >= 0).all(1)
    ours = lambda seat: (seat - decl) % 2 == 0
    taken = sum(ours(leader[:, t]).astype(np.int32) for t in range(1, 13)) + ours(who + winners(last, trump))
    led = np.repeat(leader, 4, axis=1)
    i, c = np.nonzero((led >= 0) & (card >= 0))
    unheld = np.bincount(i[~held[i, (led[i, c] + c) % 4, card[i, c]]], minlength=n) > 0
    runs, null = _runs(size), cards.is_null()
    rank, suit = (pa.array(x).take(pa.array(np.maximum(codes, 0) // d % 13, mask=codes < 0)) for x, d in ((["R" + r for r in B.RANKS], 1), ([DENOMS[s] for s in B.SUITS], 13)))
    lists = [pa.ListArray.from_arrays(runs, x, mask=null) for x in (rank, suit)]
    parts = [_hand_texts(held), held.any((1, 2)), whole, known, (count > 1).any(1), whole & unheld, pa.array(taken.astype(np.int32), mask=~told), *lists]
    return pa.StructArray.from_arrays([p if isinstance(p, pa.Array) else pa.array(p) for p in parts], _PLAY.names)


def _with_calls(df: DataFrame) -> DataFrame:
    """calls: the auction as structs, each with the explanation that follows it."""
    def call(x: Column, i: Column) -> Column:
        plain = F.upper(F.replace(x, F.lit("!"), F.lit("")))
        bid = plain.rlike("^[1-7](C|D|H|S|N|NT)$")
        penalty = F.when(plain.isin("P", "PASS"), "passed").when(plain.isin("D", "DBL", "X"), "doubled").when(plain.isin("R", "RDBL", "XX"), "redoubled")
        return F.struct(
            F.when(bid, "Contract").when(penalty.isNotNull(), "Penalty").alias("type"), F.when(bid, B.lookup(DENOMS, F.substring(plain, 2, 1))).alias("denom"), penalty.alias("penalty"),
            F.when(bid, _int(F.substring(plain, 1, 1))).alias("level"), F.contains(x, F.lit("!")).alias("alertable"), F.get("told", i).alias("announcement"),
        )

    return df.withColumn("calls", F.transform("said", call))


def _with_contract(df: DataFrame) -> DataFrame:
    """passout, level, denom, penalty, declarer_no of auctions that are over: three passes after a bid, or four calls without one."""
    size = F.size("calls")
    passes = F.forall(F.slice("calls", F.greatest(size - 2, F.lit(1)), 3), lambda c: F.coalesce(c["penalty"] == "passed", F.lit(False)))
    df = df.withColumns({"last": F.array_max(F.transform("calls", lambda c, i: F.when(c["level"].isNotNull(), i))), "over": (size >= 4) & passes & F.forall("calls", lambda c: c["type"].isNotNull())})
    df = df.withColumn("final", F.when(F.col("over"), F.get("calls", F.col("last"))))
    doubled = F.filter(F.slice("calls", F.col("last") + 1, F.size("calls")), lambda c: c["penalty"].isin("doubled", "redoubled"))
    named = F.array_min(F.transform("calls", lambda c, i: F.when((c["denom"] == F.col("final.denom")) & ((F.col("last") - i) % 2 == 0), i)))
    bid = F.col("final").isNotNull()
    return df.withColumns({
        "passout": F.when(F.col("over"), F.col("last").isNull()), "level": F.col("final.level"), "denom": F.col("final.denom"),
        "penalty": F.when(bid, F.coalesce(F.get(F.reverse(doubled), F.lit(0))["penalty"], F.lit("passed"))), "declarer_no": F.when(bid, F.pmod(F.col("dealer_no") + named, F.lit(4))),
    }).drop("final", "last")


def _with_play(df: DataFrame) -> DataFrame:
    """Hands, what is known of them and of the cards, and the tricks that the declaring side took."""
    deal = F.replace(F.upper(F.regexp_replace("md", r"^\d", "")), F.lit("10"), F.lit("T"))
    trump = F.instr(F.lit(B.TRICK_STRAINS), F.upper(F.substring(F.when(F.col("denom") == "nt", "N").otherwise(F.col("denom")), 1, 1))) - 1
    return df.withColumn("p", _play(deal, F.col("cards"), _int(F.col("declarer_no")), trump)).withColumns({name: F.col(f"p.{name}") for name in _PLAY.names}).drop("p")


def parse_records(texts: DataFrame) -> DataFrame:
    """texts(source_file, value), whole files -> a row a board, and an error row for each file that holds none or is null.

    vulnerability: 0 none, 1 both, 2 North-South, 3 East-West. trump is the contract's denomination, nt for a board passed out. contract: level, denomination, X or XX, declarer, or PASS; null while the auction
    is not over. result: tricks over or under the contract, by the claim, else by the play (of which the last trick may be missing); null where neither tells. score: of the declaring side.
    issues: what is missing or does not fit; a row with issues may be valid. Fields and files of any length are read whole.
    """
    df = _boards(texts)
    dealer = F.instr(F.lit("1234"), F.substring("md", 1, 1))
    df = df.withColumn("dealer_no", F.when((dealer > 0) & (F.length("md") > 0), F.pmod(dealer + 1, F.lit(4))))
    df = _with_play(_with_contract(_with_calls(df)))
    df = df.withColumns({
        "board_num": F.coalesce(F.regexp_extract("ah", r"(\d+)\s*$", 1).try_cast("int"), F.regexp_extract("qx", r"(\d+)", 1).try_cast("int")), "vulnerability": B.lookup(VULS, F.lower(F.substring("sv", 1, 1))),
        "PBN": F.when(F.col("dealt"), F.concat(F.lit("N:"), F.concat_ws(" ", "hands"))).otherwise(EMPTY_DEAL), "claim": F.col("mc").try_cast("int"),
    })
    tricks = F.when(F.col("claim").between(0, 13), F.col("claim")).otherwise(F.when(F.col("mc").isNull(), F.col("taken")))
    df = df.withColumn("result", tricks - 6 - F.col("level"))
    letter = lambda c: F.when(c == "nt", "N").otherwise(F.upper(F.substring(c, 1, 1)))
    doubled, seat = B.lookup(PENALTIES, F.col("penalty")), B.nth(B.SEATS, F.col("declarer_no"))
    vulnerable = (F.col("vulnerability") == 1) | (F.col("vulnerability") == 2 + F.col("declarer_no") % 2)
    score = F.when(F.col("vulnerability").isNotNull() & F.col("declarer_no").isNotNull(), B.contract_score(F.col("level"), letter(F.col("denom")), doubled, vulnerable, F.col("result")))
    contract = F.when(F.col("passout"), "PASS").otherwise(F.concat(F.col("level").cast("string"), letter(F.col("denom")), doubled, seat))
    wrong = {
        "no board": F.col("board_num").isNull(), "no dealer": F.col("dealer_no").isNull(), "no vulnerability": F.col("vulnerability").isNull(), "no deal": F.col("PBN") == EMPTY_DEAL,
        "deal not whole": (F.col("PBN") != EMPTY_DEAL) & ~F.col("whole"), "unknown call": F.exists("calls", lambda c: c["type"].isNull()), "auction not over": ~F.col("over"), "unknown card": ~F.col("known"),
        "card played twice": F.col("twice"), "card not held": F.col("unheld"),
        "claim out of range": F.col("mc").isNotNull() & ~F.coalesce(F.col("claim").between(0, 13), F.lit(False)), "play not over": F.col("level").isNotNull() & F.col("mc").isNull() & F.col("taken").isNull(),
    }
    no_board = F.col("board").isNull()
    issues = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in wrong.items()]), lambda x: x.isNotNull())
    player = lambda i: F.nullif(F.trim(F.get("names", F.lit(RECORD_SEATS.index(i)))), F.lit(""))
    hand = lambda i: F.get("hands", F.lit(i))
    given = lambda c: F.when(~no_board, c)
    part = lambda name: F.transform("calls", lambda c: c[name])
    whose = F.when(F.col("declarer_no").isNotNull(), F.get(F.array(*map(F.lit, PLAYERS)), F.col("declarer_no")))
    # a filter on a row's columns must not be pushed down into copies of what makes them
    return computed(
        df, "source_file", "board", "board_num", B.nth(B.SEATS, F.col("dealer_no")).alias("dealer"), "vulnerability", given(F.col("passout")).alias("passout"), contract.alias("contract"), "level", "denom",
        F.when(F.col("passout"), "nt").otherwise(F.col("denom")).alias("trump"), "penalty", whose.alias("declarer"), F.col("result").cast("int").alias("result"), score.alias("score"), given(F.col("mc").isNotNull()).alias("claimed"), "PBN",
        *[given(hand(i)).alias(f"Hand_{s}") for i, s in enumerate(B.SEATS)], given(F.struct(*[player(i).alias(p.title()) for i, p in enumerate(PLAYERS)], F.col("event").alias("Event"))).alias("info"),
        *[part(p).alias(f"bid_{p}") for p in ("type", "denom", "penalty", "level", "alertable", "announcement")],
        "play_rank", "play_suit",
        *[player(i).alias(f"Player_{s}") for i, s in enumerate(B.SEATS)], given(issues).alias("issues"), no_board.alias("error"), F.when(no_board, "no board in the file, or no text").alias("error_message"),
    )


def rejection() -> Column:
    """Why a row of parse_records is not kept, by the first rule that it breaks; null for a valid one. Boards passed out and boards without contract are valid."""
    deal = F.coalesce(F.col("PBN") == EMPTY_DEAL, F.lit(True))
    return F.when(F.col("error"), "error").when(deal, "invalid_pbn").when(~F.coalesce(F.col("vulnerability").between(0, 3), F.lit(False)), "null_vulnerability").when(F.col("dealer").isNull(), "null_dealer")


def valid_records(records: DataFrame) -> DataFrame:
    """Valid rows without the columns that tell of errors: what a merge of parts keeps."""
    return records.where(rejection().isNull()).drop("error", "error_message")


def quarantined(records: DataFrame) -> DataFrame:
    """The other rows, with their reason."""
    return records.withColumn("reason", rejection()).where("reason is not null")


def new_records(texts: DataFrame, done: DataFrame) -> DataFrame:
    """Records of files that are not in the output yet."""
    return parse_records(texts.join(done.select("source_file").distinct(), "source_file", "left_anti"))


def quality(records: DataFrame, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """(reason, n): rows by reason of rejection, `valid` for those kept; (issue, n): the most frequent issues.

    Both are counted in one reading of the records; the counts, a row a reason or issue, are a table in the shared folder.
    """
    spark, path = records.sparkSession, shared_folder(records.sparkSession, "quality")
    told = lambda kind, what: F.struct(F.lit(kind).alias("kind"), what.alias("what"))
    rows = computed(records, F.coalesce(rejection(), F.lit("valid")).alias("reason"), "issues")
    found = rows.select(F.inline(F.concat(F.array(told("reason", F.col("reason"))), F.coalesce(F.transform("issues", lambda i: told("issue", i)), F.array().cast("array<struct<kind:string,what:string>>")))))
    counts = found.groupBy("kind", "what").agg(F.count(F.lit(1)).alias("n"))
    counts.write.parquet(path)
    counts = spark.read.schema(counts.schema).parquet(path)
    of = lambda kind: counts.where(F.col("kind") == kind).select(F.col("what").alias(kind), "n")
    return of("reason"), of("issue").orderBy(F.desc("n"), "issue").limit(top)
