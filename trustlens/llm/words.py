"""Vectorised words and word hashes of a batch of texts.

A word is ``[^\\x20\\x09-\\x0D]+``. Hashes are 64-bit tabulation hashes of the word's UTF-8
bytes with A-Z lower-cased, computed with numpy over whole Arrow buffers; two different
words share a hash with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes of text that one vectorised step looks at (one longer text is a step of its own)
SLICE_BYTES = 1 << 20
#: bytes of one word block inside a step
_HASH_BLOCK = 1 << 18
_POSITIONS = 64

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _tables() -> np.ndarray:
    rng = np.random.default_rng(20_240_611)
    t = rng.integers(0, 2**64, size=(_POSITIONS, 256), dtype=np.uint64)
    t[:, 65:91] = t[:, 97:123]  # A-Z count as a-z
    return t.ravel()


_TABLE = _tables()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    if len(col) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0]:offsets[-1]]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of about ``limit`` bytes together."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def spans(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the place of each row's first word (n + 1)."""
    n = len(raw)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    solid = ~_WS[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    first[cuts] = solid[cuts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cuts = cuts[cuts > 0]
    last[cuts - 1] = solid[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word [start, end) of ``raw``, block by block."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _HASH_BLOCK, "right")))
        lens = ends[a:b] - starts[a:b]
        at = np.zeros(b - a, np.int64)
        np.cumsum(lens[:-1], out=at[1:])
        pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(at, lens)
        byte = raw[pos + np.repeat(starts[a:b], lens)]
        h = _TABLE[((pos & (_POSITIONS - 1)) << 8) + byte]
        if int(lens.max()) > _POSITIONS:  # the same byte further on counts differently
            h *= (2 * (pos // _POSITIONS) + 1).astype(np.uint64)
        out[a:b] = np.add.reduceat(h, at) + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        a = b
    return out


def hashed_rows(col: pa.Array, limit: int = SLICE_BYTES):
    """For runs of rows: (first row, one past the last row, offsets, raw bytes, word starts,
    word ends, word bounds by row, word hashes)."""
    offsets, raw = text_buffer(col)
    for a, b in row_slices(offsets, limit):
        off = offsets[a:b + 1] - offsets[a]
        part = raw[offsets[a]:offsets[b]]
        starts, ends, bounds = spans(off, part)
        yield a, b, off, part, starts, ends, bounds, word_hashes(part, starts, ends)


_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                                0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` consecutive words of one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += mix(words[k:k + n] * _STEP[k % 8] + np.uint64(k + 1))
    return mix(out)


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; with fewer words the whole sequence is one."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(shingles(words, min(size, len(words))) + np.uint64(len(words) < size) * np.uint64(len(words)))
