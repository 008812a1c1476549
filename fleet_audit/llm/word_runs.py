"""Buckets of runs of words, for whole Arrow columns of texts at once.

A-Z become lower case; a word is a run of digits, letters a-z and non-ASCII characters. The bucket of a run of words
joined by one space is its CRC-32 modulo the number of buckets. CRC-32 is linear, so the CRC of a run follows
from those of its words and their lengths, and no run is ever put together as a string.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer word is a block of its own.
BLOCK_BYTES = 1 << 21
#: Words of more bytes than this are hashed one by one.
_LONG_WORD = 32

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_IS_WORD = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
_STEP = np.array([zlib.crc32(bytes([c])) ^ zlib.crc32(b"\0") for c in range(256)], np.uint32)
_STEP = _STEP ^ _STEP[0]


def _after_zero_byte(state: np.ndarray) -> np.ndarray:
    """The registers behind one more zero byte; linear in ``state``."""
    return _STEP[state & 0xFF] ^ (state >> 8)


@lru_cache(maxsize=4096)
def _behind(length: int) -> np.ndarray:
    """``[byte, value]``: what each byte of a register becomes behind ``length`` zero bytes."""
    if length == 0:
        return (np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    half = _behind(length // 2)
    table = _apply(half[None], np.zeros(1024, np.intp), half.ravel()).reshape(4, 256)
    return _after_zero_byte(table) if length % 2 else table


def _apply(tables: np.ndarray, which: np.ndarray, state: np.ndarray) -> np.ndarray:
    out = tables[which, 0, state & 0xFF]
    for k in range(1, 4):
        out ^= tables[which, k, (state >> (8 * k)) & 0xFF]
    return out


def joined_crc(first: np.ndarray, second: np.ndarray, second_length: np.ndarray) -> np.ndarray:
    """The CRC-32 of strings put together, from those of their parts."""
    lengths, which = np.unique(second_length, return_inverse=True)
    if not len(lengths):
        return first
    return _apply(np.stack([_behind(int(n)) for n in lengths]), which, first) ^ second


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word of ``data``."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    begins, sizes = starts[order], lengths[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(min(_LONG_WORD, int(sizes[0]) if len(sizes) else 0)):
        active = int(np.searchsorted(-sizes, -k, side="left"))
        crc[:active] = _STEP[(crc[:active] ^ data[begins[:active] + k]) & 0xFF] ^ (crc[:active] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(int(np.searchsorted(-sizes, -_LONG_WORD, side="left"))):
        crc[k] = zlib.crc32(data[begins[k] : begins[k] + sizes[k]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column of strings, and where each value starts, with the end of the last. A null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _block_ends(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of ``data`` of about ``BLOCK_BYTES`` that end where no word goes on."""
    first = 0
    while first < len(data):
        last = min(first + BLOCK_BYTES, len(data))
        while last < len(data) and _IS_WORD[data[last]] and _IS_WORD[data[last - 1]]:
            window = data[last : last + BLOCK_BYTES]
            gap = np.flatnonzero(~_IS_WORD[window])
            last += int(gap[0]) if len(gap) else len(window)
        yield first, last
        first = last


def run_buckets(column: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``texts, words, found`` by blocks: the text of each run of 1 to ``longest`` words, how many words it has, and its bucket.

    Runs that reach over the end of a block are found with the words of the next one.
    """
    data, offsets = column_bytes(column)
    carried = (np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
    for first, last in _block_ends(data, offsets):
        part = np.frombuffer(data[first:last].tobytes().translate(_LOWER), np.uint8)
        inside = np.concatenate(([False], _IS_WORD[part], [False]))
        breaks = offsets[np.searchsorted(offsets, first) : np.searchsorted(offsets, last)] - first
        changes = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = changes[0::2], changes[1::2]
        # A text that ends in a word and one that starts with a word do not share it.
        split = np.unique(breaks[(breaks > 0)])
        split = split[inside[split] & inside[split + 1]]
        starts, ends = np.sort(np.concatenate((starts, split))), np.sort(np.concatenate((ends, split)))
        texts = np.searchsorted(offsets, starts + first, side="right") - 1
        old = len(carried[0])
        texts = np.concatenate((carried[0], texts))
        crcs = np.concatenate((carried[1], word_crcs(part, starts, ends)))
        lengths = np.concatenate((carried[2], ends - starts))
        found_texts, found_words, found = [], [], []
        spaced = joined_crc(np.full(len(crcs), zlib.crc32(b" "), np.uint32), crcs, lengths)
        run = crcs
        for words in range(1, longest + 1):
            if words > 1:
                run = joined_crc(run[:-1], spaced[words - 1 :], lengths[words - 1 :] + 1)
            tail = texts[words - 1 :]
            if len(tail) == 0:
                break
            # Runs of carried words alone were found before.
            whole = (tail == texts[: len(tail)]) & (np.arange(len(tail)) + words - 1 >= old)
            found_texts.append(tail[whole])
            found_words.append(np.full(int(whole.sum()), words))
            found.append((run[whole] % np.uint32(buckets)).astype(np.int64))
        keep = max(0, len(texts) - (longest - 1))
        carried = (texts[keep:], crcs[keep:], lengths[keep:])
        if found:
            yield np.concatenate(found_texts), np.concatenate(found_words), np.concatenate(found)
