"""Encoding and decoding with a SentencePiece vocabulary by streaming Viterbi.

The pieces of the file get log scores by rank. The search goes through a text and keeps the scores of a window as long as
the longest piece alone; as soon as the backpointer paths of all boundaries in the window meet in one boundary, the ids up
to it are committed and forgotten. As no piece goes on behind a word's end, all paths meet at each word start, and what lies between
two such places is a piece of the search by itself, whose ids are remembered within a bound of bytes. One search serves all text, whatever its length.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of stretches and ids that a worker remembers from earlier texts.
MEMO_BYTES = 60_000_000


class PieceVocabulary:
    """Pieces with blanks for word marks; characters that no piece holds are spelled as bytes, the mark itself too, so decoding is exact."""

    def __init__(self, model_file: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, tuple[int, float]] = {}
        self.byte_ids, self.raw = {}, {}
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i):
                continue
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif " " not in piece and not re.search("[^▁]▁", piece):
                text = piece.replace("▁", " ")
                self.raw[i] = text.encode()
                self.ids[text] = (i, -math.log(i + 10))
        if len(self.byte_ids) < 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.longest = max(map(len, self.ids), default=1)
        self.tails = {p[k:]: self.ids.get(p[k:]) for p in self.ids for k in range(len(p))}
        free = "".join(c for c in "\n\r\t" if not any(c in p for p in self.ids))
        self.units = re.compile(f" *[^ {free}]+| +|[{free}]" if free else " *[^ ]+| +")

    def spell(self, char: str) -> tuple[list[int], float]:
        ids = [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]
        return ids, -sum(math.log(i + 10) for i in ids) - 10.0


class Beginning:
    """Scores and ways back of a stretch's boundaries while its window fills. The next stretch goes on from the characters that both share."""

    def __init__(self):
        self.chars, self.best, self.back = "", [0.0], [(0, [])]

    def shared(self, chars: str, most: int) -> int:
        """Keep what holds for chars too; how many characters that are."""
        same, n = 0, min(len(self.chars), len(chars))
        while same < n and self.chars[same] == chars[same]:
            same += 1
        del self.best[same + 1 :], self.back[same + 1 :]
        self.chars = chars[:most]
        return same


def _arrive(chars: str, j: int, low: int, best: list | dict, v: PieceVocabulary) -> tuple[float, tuple[int, list[int]]]:
    """The best score of boundary j, from those of low and later ones, and the way back: the boundary before and the ids between. Equal scores go to the longer last piece."""
    tails, top, i, at, ids = v.tails, -math.inf, j - 1, 0, []
    while i >= low and (p := chars[i:j]) in tails:
        if (e := tails[p]) is not None and (s := best[i] + e[1]) >= top:
            top, at, ids = s, i, [e[0]]
        i -= 1
    if chars[j - 1] not in v.ids:
        spelled, s = v.spell(chars[j - 1])
        if (s := best[j - 1] + s) > top:
            top, at, ids = s, j - 1, spelled
    return top, (at, ids)


def viterbi(chars: str, v: PieceVocabulary, begun: Beginning | None = None) -> Iterator[list[int]]:
    """Ids of the best segmentation, in parts, each as soon as it is certain.

    best holds the window's boundaries. Once boundaries leave it, back, kids and heirs hold those on paths that survive: the way back,
    the number of boundaries that come directly from one, and their sum, which is the only child when the number is 1. A boundary
    that leaves the window without children dies, and so may those before it; a root outside of the window with one child is certain.
    """
    longest, n, root = v.longest, len(chars), 0
    begun = begun or Beginning()
    for j in range(begun.shared(chars, longest) + 1, min(n, longest) + 1):
        top, way = _arrive(chars, j, 0, begun.best, v)
        begun.best.append(top)
        begun.back.append(way)
    back: list | dict = begun.back
    if n > longest:
        best = dict(enumerate(begun.best[: longest + 1]))
        back = dict(enumerate(begun.back[: longest + 1]))
        kids, heirs = dict.fromkeys(back, 0), dict.fromkeys(back, 0)
        for j in range(1, longest + 1):
            kids[back[j][0]] += 1
            heirs[back[j][0]] += j
        for j in range(longest, n + 1):
            if j > longest:
                best[j], way = _arrive(chars, j, j - longest, best, v)
                back[j], kids[j], heirs[j] = way, 0, 0
                kids[way[0]] += 1
                heirs[way[0]] += j
            old = j - longest
            del best[old]
            while not kids[old]:
                parent = back.pop(old)[0]
                del kids[old], heirs[old]
                kids[parent] -= 1
                heirs[parent] -= old
                old = parent
            sure: list[int] = []
            while root not in best and kids[root] == 1:
                child = heirs.pop(root)
                del kids[root]
                sure += back.pop(child)[1]
                root = child
            if sure:
                yield sure
    rest, at = [], n
    while at > root:
        at, ids = back[at]
        rest.append(ids)
    yield [i for part in reversed(rest) for i in part]


class _Units(dict):
    """Ids (as 32-bit words) of the stretches between certain boundaries, remembered within a bound of bytes."""

    def __init__(self, v: PieceVocabulary):
        super().__init__()
        self.v, self.held = v, 0

    def learn(self, texts: list[list[str]]) -> None:
        """Search the stretches of some texts that are new, sorted, each from the beginning that it shares with the one before."""
        if self.held > MEMO_BYTES:
            self.clear()
            self.held = 0
        begun = Beginning()
        for unit in sorted({u for units in texts for u in units if u not in self}):
            ids = self[unit] = array("i", [i for part in viterbi(unit, self.v, begun) for i in part]).tobytes()
            self.held += len(unit) + len(ids) + 200


def encode_texts(texts: list[str | None], units: _Units) -> list[np.ndarray | None]:
    """Ids of whole texts; like the library, a blank is put before a text that isn't empty; null stays null."""
    cut = [units.v.units.findall(" " + t) if t else [] for t in texts]
    units.learn(cut)
    return [None if t is None else np.frombuffer(b"".join(map(units.__getitem__, c)), np.int32) for t, c in zip(texts, cut)]


def decode_ids(ids: np.ndarray, raw: dict[int, bytes]) -> str:
    return b"".join(map(raw.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def encode(text: Column, model_file: str = MODEL) -> Column:
    """Column of texts -> array<int> of piece ids; null gives null, the empty text an empty array."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        units = _Units(PieceVocabulary(model_file))
        for texts in batches:
            yield pd.Series(encode_texts(list(texts), units), dtype=object)

    return run(text)


def decode(ids: Column, model_file: str = MODEL) -> Column:
    """Column of array<int> -> the text that was encoded; null gives null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        raw = PieceVocabulary(model_file).raw
        for rows in batches:
            yield pd.Series([None if x is None else decode_ids(np.asarray(x), raw) for x in rows], dtype=object)

    return run(ids)


def encoded(docs: DataFrame, model_file: str = MODEL, slice_rows: int = 1024) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, ids, n_pieces (0 for null and empty texts), n_bytes of the text, round_trip (the decoded ids equal the text; null for null).

    Each row stands for itself: null doc_ids stay, repeated rows get equal ids, an empty table gives no rows, other columns are left out.
    Texts of any length are encoded whole; of equally good segmentations that with the longer last piece is taken. One worker encodes and decodes a few rows at a time, so its memory is that of a slice, not of a batch.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _Units(PieceVocabulary(model_file))
        raw = units.v.raw
        for batch in batches:
            for lo in range(0, batch.num_rows, slice_rows):
                part = batch.slice(lo, slice_rows)
                texts = part["text"].to_pylist()
                ids = encode_texts(texts, units)
                same = [None if t is None else decode_ids(x, raw) == t for t, x in zip(texts, ids)]
                sizes = [0 if x is None else len(x) for x in ids]
                flat = np.concatenate([np.empty(0, np.int32), *(x for x in ids if x is not None)])
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array([x is None for x in ids]))
                n_bytes = pa.array([None if t is None else len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part["doc_id"], lists, pa.array(sizes, pa.int32()), n_bytes, pa.array(same, pa.bool_())], ["doc_id", "ids", "n_pieces", "n_bytes", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, ids array<int>, n_pieces int, n_bytes long, round_trip boolean")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
