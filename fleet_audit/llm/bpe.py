"""Byte-level BPE: encoding and decoding with a public vocabulary.

Texts are cut into pieces without a regex. Every code point has a class; a small automaton over
the classes decides where contractions end, and since its transitions are functions that compose
associatively, whole columns of code points are scanned at once: first the composed function of
each block, then the state in front of each block, then all states inside. Pieces are made of
bytes; equal pieces are merged once and cached.

The pieces are those of the pattern::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

A null text counts as empty and has no ids. Repeated rows are kept. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The white space of Unicode, and the letters that may follow an apostrophe.
_WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters and numbers of Unicode 16 that the tables of Python 3.13 (Unicode 15.1) do not have yet, first and last of each range.
_NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
    (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
_NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
_ONE_LETTER, _TWO_LETTERS = "stmd", ("re", "ve", "ll")

#: Code points worked on at a time; a longer text is a block of its own.
_BLOCK_CHARS = 1 << 19
#: Ids decoded at a time.
_BLOCK_IDS = 1 << 17
#: Pieces of more bytes than this are merged one by one, with a heap.
_LONG_PIECE = 256
_NO_MERGE = np.int64(1) << 60

# Classes of code points. TEXT_END stands between texts.
LETTER, NUMBER, OTHER, BLANK, SPACE, APOSTROPHE_1, APOSTROPHE_2, TEXT_END = range(8)
# States after a code point: an apostrophe may start a piece, may not, or two or one letters of a contraction are due, or it just ended.
OPEN, SHUT, TWO_DUE, ONE_DUE, ENDED = range(5)


def _transitions() -> np.ndarray:
    """``[class, state] -> state``."""
    step = np.empty((8, 5), np.uint8)
    step[[NUMBER, SPACE, TEXT_END]] = OPEN
    step[[OTHER, BLANK]] = SHUT
    step[LETTER] = [OPEN, OPEN, ONE_DUE, ENDED, OPEN]
    step[APOSTROPHE_1] = [ONE_DUE, SHUT, SHUT, SHUT, ONE_DUE]
    step[APOSTROPHE_2] = [TWO_DUE, SHUT, SHUT, SHUT, TWO_DUE]
    return step


_STEP = _transitions()


@lru_cache(maxsize=1)
def _code_point_classes() -> np.ndarray:
    classes = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            classes[c] = LETTER if kind == "L" else NUMBER
    for kind, ranges in ((LETTER, _NEW_LETTERS), (NUMBER, _NEW_NUMBERS)):
        for first, last in ranges:
            classes[first : last + 1] = kind
    classes[_WHITE_SPACE] = SPACE
    classes[0x20] = BLANK
    return classes


def scan_states(classes: np.ndarray) -> np.ndarray:
    """The automaton's state in front of every code point, by composing transition functions block by block."""
    n = len(classes)
    width = max(1, int(np.sqrt(n)) // 2)
    rows = -(-n // width)
    grid = np.full(rows * width, TEXT_END, np.uint8)
    grid[:n] = classes
    columns = np.ascontiguousarray(grid.reshape(rows, width).T)
    composed = np.tile(np.arange(5, dtype=np.uint8), (rows, 1))
    for column in columns:
        composed = _STEP[column[:, None], composed]
    before = np.empty(rows, np.uint8)
    state = OPEN
    for row, function in enumerate(composed.tolist()):
        before[row] = state
        state = function[state]
    states = np.empty((width, rows), np.uint8)
    for k, column in enumerate(columns):
        states[k] = before
        before = _STEP[column, before]
    return states.T.reshape(-1)[:n]


def piece_starts(points: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
    """Flags the code points at which a piece starts.

    ``points`` holds several texts, each followed by one filler whose position is in ``text_ends``; fillers are flagged too.
    """
    classes = _code_point_classes()[points]
    classes[text_ends] = TEXT_END
    apostrophes = np.flatnonzero(points == 0x27)
    apostrophes = apostrophes[apostrophes + 2 < len(points)]
    first, second = points[apostrophes + 1], points[apostrophes + 2]
    one = np.isin(first, [ord(c) for c in _ONE_LETTER])
    two = np.zeros(len(apostrophes), bool)
    for a, b in _TWO_LETTERS:
        two |= (first == ord(a)) & (second == ord(b))
    classes[apostrophes[one & (classes[apostrophes + 1] == LETTER)]] = APOSTROPHE_1
    classes[apostrophes[two & (classes[apostrophes + 2] == LETTER)]] = APOSTROPHE_2
    states = scan_states(classes)
    kind = classes.copy()
    kind[classes >= APOSTROPHE_1] = OTHER
    kind[classes == BLANK] = SPACE
    kind[text_ends] = TEXT_END
    starts = np.ones(len(points), bool)
    starts[1:] = kind[1:] != kind[:-1]
    # A blank in front of letters, numbers or other signs opens their piece; any other last white space stands alone.
    starts[text_ends] = True
    solid = np.isin(kind, (LETTER, NUMBER, OTHER))
    last = np.flatnonzero((kind[:-1] == SPACE) & solid[1:])
    starts[last] = True
    starts[last[classes[last] == BLANK] + 1] = False
    letters = classes == LETTER
    starts[letters & ((states == ONE_DUE) | (states == TWO_DUE))] = False
    starts[letters & (states == ENDED)] = True
    return starts


@dataclass
class Vocabulary:
    """The byte sequences of a rank file, their ids, and which pairs of ids merge into which id."""

    ranks: dict[bytes, int]
    #: Ids of merged pieces as packed 32-bit numbers.
    pieces: dict[bytes, bytes] = field(default_factory=dict)
    #: Merged pieces held at most; the cache starts anew beyond it.
    cache_pieces: int = 200_000

    def __post_init__(self) -> None:
        tokens = {rank: token for token, rank in self.ranks.items()}
        size = max(tokens) + 1
        self.lengths = np.zeros(size, np.int32)
        for rank, token in tokens.items():
            self.lengths[rank] = len(token)
        self.starts = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)
        self.bytes = np.frombuffer(b"".join(tokens.get(r, b"") for r in range(size)), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})

    @cached_property
    def merges(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of ids that merge, as sorted 64-bit numbers, and what they merge into."""
        found = {
            (self.ranks[token[:k]] << 32) | self.ranks[token[k:]]: rank
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        }
        keys = np.fromiter(found, np.int64, len(found))
        order = np.argsort(keys)
        return keys[order], np.fromiter(found.values(), np.int64, len(found))[order]

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, into = self.merges
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, into[at], _NO_MERGE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece. In every round each piece merges its pair of lowest rank, the leftmost of equal ones."""
        out: list[bytes] = [b""] * len(pieces)
        short = []
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(piece) > _LONG_PIECE:
                out[k] = np.array(self.merge_long(piece), "<i4").tobytes()
            else:
                short.append(k)
        if not short:
            return out
        owner = np.array(short)
        sizes = np.array([len(pieces[k]) for k in short])
        ids = self.single[np.frombuffer(b"".join([pieces[k] for k in short]), np.uint8)]
        ranks = np.full(len(ids), _NO_MERGE)
        ranks[:-1] = self.merged(ids[:-1], ids[1:])
        ranks[np.cumsum(sizes) - 1] = _NO_MERGE
        while len(owner):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(ranks, starts)
            done = best == _NO_MERGE
            if done.any():
                for k, i, n in zip(owner[done].tolist(), starts[done].tolist(), sizes[done].tolist()):
                    out[k] = ids[i : i + n].astype("<i4").tobytes()
                keep = np.repeat(~done, sizes)
                ids, ranks, owner, sizes, best = ids[keep], ranks[keep], owner[~done], sizes[~done], best[~done]
                if not len(owner):
                    break
                starts = np.cumsum(sizes) - sizes
            segment = np.repeat(np.arange(len(owner)), sizes)
            lowest = np.flatnonzero(ranks == best[segment])
            at = lowest[np.concatenate(([True], segment[lowest[1:]] != segment[lowest[:-1]]))]
            ids[at] = best
            ranks[at] = _NO_MERGE
            after = at + 2 < starts + sizes
            ranks[at[after]] = self.merged(ids[at[after]], ids[at[after] + 2])
            before = at > starts
            ranks[at[before] - 1] = self.merged(ids[at[before] - 1], ids[at[before]])
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, ranks, sizes = ids[keep], ranks[keep], sizes - 1
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """The ids of one piece, with a heap over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        ranks = self.merged(ids[:-1], ids[1:]).tolist()
        ids = ids.tolist()
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, k, ids[k], ids[k + 1]) for k, r in enumerate(ranks) if r < _NO_MERGE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            right = after[k] if alive[k] else n
            if right >= n or ids[k] != a or ids[right] != b:
                continue
            ids[k], alive[right] = rank, False
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
            for left, second in ((before[k], k), (k, after[k])):
                if left < 0 or second >= n:
                    continue
                pair = (ids[left], ids[second])
                if pair not in known:
                    known[pair] = int(self.merged(np.array([pair[0]]), np.array([pair[1]]))[0])
                if known[pair] < _NO_MERGE:
                    heapq.heappush(heap, (known[pair], left, *pair))
        return [i for i, keep in zip(ids, alive) if keep]

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of distinct pieces, merging only those not seen lately."""
        new = [p for p in pieces if p not in self.pieces]
        if len(self.pieces) + len(new) > self.cache_pieces:
            self.pieces.clear()
            new = pieces
        self.pieces.update(zip(new, self.merge(new)))
        return [self.pieces[p] for p in pieces]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.read(path)


def encode_texts(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts after one another, and where each text's ids end."""
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = np.flatnonzero(piece_starts(points, text_ends))
    widths = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.concatenate(([0], np.cumsum(widths, dtype=np.int64)))
    raw = "\0".join([*texts, ""]).encode("utf-8", "surrogatepass")
    cuts = at[starts].tolist()
    cuts.append(len(raw))
    pieces = [raw[i:j] for i, j in zip(cuts, cuts[1:])]
    filler = np.isin(starts, text_ends, assume_unique=True)
    codes = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
    which = np.fromiter(map(codes.__getitem__, pieces), np.int32, len(pieces))
    own = vocab.ids_of(list(codes))
    flat = np.frombuffer(b"".join(own), "<i4")
    sizes = np.fromiter(map(len, own), np.int32, len(own)) // 4
    counts = np.where(filler, 0, sizes[which])
    ends = np.cumsum(counts)
    at = np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - counts), counts)
    return flat[at + np.arange(len(at))], ends[np.flatnonzero(filler)]


def decode_ids(ids: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the tokens after one another, and where each token's bytes end."""
    lengths = vocab.lengths[ids]
    ends = np.cumsum(lengths)
    at = np.repeat(vocab.starts[ids] - (ends - lengths), lengths)
    return vocab.bytes[at + np.arange(len(at))], ends


def _blocks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to ``limit`` at most; a larger row is a run of its own."""
    first, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > first and total + size > limit:
            yield first, k
            first, total = k, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def _added(df: DataFrame, names: list[str], kinds: list[T.DataType]) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name not in names), *map(T.StructField, names, kinds)])


def _list(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values, kind))


def encode(df: DataFrame, path: str, text_col: str = "text", offsets: bool = True) -> DataFrame:
    """``df`` with ``ids`` and, with ``offsets``, ``ends`` (the byte of the text at which each token ends).

    ``path`` names the rank file, which every worker reads once. Columns of these names are replaced.
    """
    names = ["ids", "ends"] if offsets else ["ids"]
    schema = _added(df, names, [T.ArrayType(T.IntegerType()), T.ArrayType(T.IntegerType())][: len(names)])
    others = [n for n in df.columns if n not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_col)), 0).to_numpy()
            for first, last in _blocks(lengths, _BLOCK_CHARS):
                part = batch.slice(first, last - first)
                ids, ends = encode_texts([t or "" for t in part.column(text_col).to_pylist()], vocab)
                columns = [*(part.column(n) for n in others), _list(ids, ends, pa.int32())]
                if offsets:
                    bytes_before = np.concatenate(([0], np.cumsum(vocab.lengths[ids], dtype=np.int64)))
                    text_starts = np.repeat(bytes_before[np.concatenate(([0], ends[:-1]))], np.diff(ends, prepend=0))
                    columns.append(_list(bytes_before[1:] - text_starts, ends, pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, [*others, *names])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", output_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that its ids stand for; null ids give null."""
    schema = _added(df, [output_col], [T.BinaryType()])
    others = [n for n in df.columns if n != output_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            counts = pa.compute.fill_null(pa.compute.list_value_length(batch.column(ids_col)), 0).to_numpy()
            for first, last in _blocks(counts, _BLOCK_IDS):
                part = batch.slice(first, last - first)
                column = part.column(ids_col)
                raw, token_ends = decode_ids(column.flatten().to_numpy(zero_copy_only=False), vocab)
                ends = np.concatenate(([0], token_ends))[np.concatenate(([0], np.cumsum(counts[first:last])))]
                whole = raw.tobytes()
                known = column.is_valid().to_pylist()
                out = [whole[i:j] if k else None for i, j, k in zip(ends.tolist(), ends[1:].tolist(), known)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in others), pa.array(out, pa.binary())], [*others, output_col])

    return df.mapInArrow(run, schema)
