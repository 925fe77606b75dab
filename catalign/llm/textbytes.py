"""Words of whole texts as numpy arrays over the UTF-8 bytes of an Arrow column.

Every byte of a character beyond ASCII is at least 0x80, so a word rule that
names ASCII characters only gives the same words on bytes as on characters.
A piece holds whole texts, about ``PIECE_BYTES`` together; a longer text is a
piece of its own, so no text is cut."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20

#: Bytes of words: digits, letters, and everything beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x41:0x5B] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True
#: Bytes of tokens: everything but ASCII white space.
TOKEN_BYTES = np.ones(256, bool)
TOKEN_BYTES[0x20] = TOKEN_BYTES[0x09:0x0E] = False
#: A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

# tables of the CRC of words up to this many bytes; longer ones take several steps
_STEP = 64


class Piece(NamedTuple):
    first: int            # row of the first text
    data: np.ndarray      # bytes of all texts
    bounds: np.ndarray    # where each text begins, and the end of the last


def pieces(column: pa.ChunkedArray | pa.Array, most: int = PIECE_BYTES) -> Iterator[Piece]:
    """The texts of a string column; a null is an empty text."""
    first = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        texts = pc.fill_null(chunk.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            continue
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
            yield Piece(first + at, data[bounds[at]:bounds[end]], bounds[at:end + 1] - bounds[at])
            at = end
        first += n


def words(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each longest run of bytes of ``kind`` begins and ends, and the
    first word of each text followed by the number of words.  A run ends with
    its text."""
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, bounds)


def _crc_bytes() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_bytes()


def _shift_tables(n: int) -> np.ndarray:
    """[k, j, b]: what byte j with value b of a CRC becomes after k more zero bytes."""
    out = np.empty((n + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(n):
        out[k + 1] = _CRC[out[k] & 255] ^ (out[k] >> 8)
    return out


_SHIFT = _shift_tables(_STEP).reshape(-1)


def crc_append(head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings joined, from their CRCs and the bytes of the second."""
    out, left = head.astype(np.uint32), np.asarray(size, np.int64).copy()
    rows = np.arange(out.size)
    while rows.size:
        step, x = np.minimum(left[rows], _STEP), out[rows]
        at = step * 1024
        out[rows] = _SHIFT[at + (x & 255)] ^ _SHIFT[at + 256 + (x >> 8 & 255)] ^ _SHIFT[at + 512 + (x >> 16 & 255)] ^ _SHIFT[at + 768 + (x >> 24)]
        left[rows] -= step
        rows = rows[left[rows] > 0]
    return out ^ tail


def crc_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each word's bytes."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    longest, at = size[order], start[order]
    state = np.full(start.size, 0xFFFFFFFF, np.uint32)
    active, j = start.size, 0
    while True:
        active = int(np.searchsorted(-longest[:active], -j, "left"))  # words of more than j bytes
        if not active:
            break
        s = state[:active]
        state[:active] = _CRC[(s ^ data[at[:active] + j]) & 255] ^ (s >> 8)
        j += 1
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def crc_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, heads: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, .. ``longest`` words in a row, joined by one space: the
    CRC-32 of every run, and the text of its first word."""
    text = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
    word = crc_words(data, start, end)
    size = end - start
    space = np.full(word.size, zlib.crc32(b" "), np.uint32)
    spaced = crc_append(space, word, size)
    run = word
    yield run, text
    for n in range(1, longest):
        last = len(word) - n
        if last <= 0:
            return
        run = crc_append(run[:last], spaced[n:], size[n:] + 1)
        same = text[:last] == text[n:]
        yield run[same], text[:last][same]
