"""Words and word shingles of Arrow text columns as 64-bit numbers, without Python strings.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; bytes of
UTF-8 text are enough for that.  No step of a word's hash is linear in its bytes, so words
of one pattern do not collide.  All work is done with numpy on the buffers of a column, in
slices of bounded size, so that a worker's memory does not follow the length of a batch or
of a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into numbers at once.
SLICE = 1 << 20
SHINGLE = 5

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
#: Bytes of the longest word that is hashed by blocks of eight; longer ones take BLAKE2.
_BY_BLOCKS = 64
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; works on its own copy."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32, len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def _slice_words(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of ``buf``; a word also ends at each of ``cuts``."""
    if not len(buf):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    solid = ~_SPACE[buf]
    prev = np.empty_like(solid)
    prev[0], prev[1:] = False, solid[:-1]
    prev[cuts[cuts < len(buf)]] = False
    start = np.flatnonzero(solid & ~prev)
    nxt = np.empty_like(solid)
    nxt[-1], nxt[:-1] = False, solid[1:]
    inner = cuts[(cuts > 0) & (cuts <= len(buf))]
    nxt[inner - 1] = False
    end = np.flatnonzero(solid & ~nxt) + 1
    low = np.zeros(len(buf) + 8, np.uint8)
    low[: len(buf)] = _LOWER[buf]
    return _hashes(low, start, end - start), start


def _hashes(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each word's length and then its blocks of eight bytes, mixed into one number in turn.
    ``low`` has eight bytes more than its words."""
    eight = np.ndarray((len(low) - 7,), "<u8", low, 0, (1,))
    h = mix(size.astype(_U))
    long = np.flatnonzero(size > _BY_BLOCKS)
    live = np.flatnonzero(size <= _BY_BLOCKS) if len(long) else np.arange(len(size))
    at, left = start[live], size[live]
    while len(live):
        h[live] = mix(h[live] ^ (eight[at] & _MASK[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in long.tolist():
        h[k] = int.from_bytes(hashlib.blake2b(low[start[k] : start[k] + size[k]], digest_size=8).digest(), "little")
    return h


def word_batches(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row after the last, word hashes, word offsets by row) until all
    rows of a column are done.  Rows are whole: a text longer than ``SLICE`` is hashed in
    slices that end at white space, and its words are put together again."""
    buf, offs = text_buffers(col)
    n, row = len(offs) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + SLICE, "right")) - 1)
        lo, hi = int(offs[row]), int(offs[end])
        if hi - lo <= SLICE:
            h, start = _slice_words(buf[lo:hi], offs[row:end] - lo)
            at = np.searchsorted(start, offs[row : end + 1] - lo)
        else:
            parts = []
            while lo < hi:
                stop = min(lo + SLICE, hi)
                if stop < hi:
                    space = np.flatnonzero(_SPACE[buf[lo:stop]])
                    if len(space):
                        stop = lo + int(space[-1]) + 1
                    else:  # one word longer than a slice
                        while stop < hi and not _SPACE[buf[stop]]:
                            step = np.flatnonzero(_SPACE[buf[stop : min(stop + SLICE, hi)]])
                            stop = stop + int(step[0]) if len(step) else min(stop + SLICE, hi)
                parts.append(_slice_words(buf[lo:stop], np.zeros(0, np.int64))[0])
                lo = stop
            h = np.concatenate(parts)
            at = np.array([0, len(h)])
        yield row, end, h, at
        row = end


def shingles(h: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the windows of ``width`` words, one for each place that has them."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = h[:n] * _PLACE[0]
    for k in range(1, width):
        out += h[k : k + n] * _PLACE[k]
    return mix(out + _U(width))


def short_shingle(h: np.ndarray) -> np.ndarray:
    """The one shingle of a text of fewer than ``SHINGLE`` words, none without words."""
    return shingles(h, len(h)) if len(h) else np.zeros(0, _U)


def shingle_sets(h: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each row of one batch of :func:`word_batches`."""
    every = shingles(h)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a < SHINGLE:
            yield short_shingle(h[a:b])
            continue
        s = np.sort(every[a : b - SHINGLE + 1])
        new = np.empty(len(s), bool)
        new[0] = True
        np.not_equal(s[1:], s[:-1], out=new[1:])
        yield s[new]
