"""Vectorised text primitives shared by the operators of this subpackage.

Arrow string columns are read as one flat UTF-8 buffer and tokenised with numpy, a bounded block at a time, so no
per-word Python object is created.  A word is a maximal run of bytes outside the ASCII white space 0x09-0x0D and 0x20;
A-Z is lower-cased before hashing.  Hashes are 64-bit.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one vectorised block covers at most, unless a single word is longer.
BLOCK_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BYTE_VALUES = np.random.RandomState(20240229).randint(0, 1 << 63, size=256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The partition function, handing freed memory back to the system when a partition is done: workers are reused, and
    what they keep adds up with the executor's own."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes as one buffer, and the offsets of its values in it (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def blocks(buf: np.ndarray, off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, start byte, end byte) of successive pieces; a piece holds whole values, or is part of
    one long value cut behind a white-space byte."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        if j > i:
            yield i, j, int(off[i]), int(off[j])
            i = j
            continue
        at, end = int(off[i]), int(off[i + 1])
        while at < end:
            cut = min(at + limit, end)
            while cut < end:
                stop = min(cut + limit, end)
                hit = np.flatnonzero(SPACE[buf[cut:stop]])
                if len(hit):
                    cut += int(hit[0]) + 1
                    break
                cut = stop
            yield i, i + 1, at, cut
            at = cut
        i += 1


def word_spans(piece: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of a piece; starts_at: where its values begin (words don't run across them)."""
    solid = ~SPACE[piece]
    first = np.empty(len(piece), dtype=bool)
    first[1:] = ~solid[:-1]
    if len(piece):
        first[0] = True
    first[starts_at[starts_at < len(piece)]] = True
    last = np.empty(len(piece), dtype=bool)
    last[:-1] = first[1:] | ~solid[1:]
    if len(piece):
        last[-1] = True
    return np.flatnonzero(solid & first), np.flatnonzero(solid & last) + 1


def span_sums(piece: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial over random values of each span's bytes, by prefix sums; BASE ** k times that of a span's rest behind its
    first k bytes adds up to that of the whole."""
    power, inverse = _powers(len(piece) + 1)
    sums = np.empty(len(piece) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUES[piece] * power[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


def power(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))


def span_hashes(piece: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes."""
    return mix64(span_sums(piece, starts, ends))


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all values in order, and each value's offsets in them."""
    words, _, at = shaped_words(buf, off, 0)
    return words, at


def shaped_words(buf: np.ndarray, off: np.ndarray, shapes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes, with each word's shape between them if `shapes` is not 0: a number below it that hashes the first
    three bytes and the last two of the lower-cased word (of a shorter word, its last or first byte again)."""
    counts = np.zeros(len(off) - 1, dtype=np.int64)
    out, shape = [], []
    for i, j, a, b in blocks(buf, off):
        if a == b:
            continue
        piece = buf[a:b]
        starts, ends = word_spans(piece, off[i:j] - a if j > i + 1 else np.zeros(1, np.int64))
        small = LOWER[piece]
        out.append(span_hashes(small, starts, ends))
        if shapes:
            key = np.zeros(len(starts), np.uint64)
            for k in (starts, np.minimum(starts + 1, ends - 1), np.minimum(starts + 2, ends - 1), ends - 1, np.maximum(ends - 2, starts)):
                key = key * np.uint64(257) + small[k]
            shape.append((mix64(key) % np.uint64(shapes)).astype(np.int32))
        if j == i + 1:
            counts[i] += len(starts)
        else:
            edges = np.searchsorted(starts, off[i : j + 1] - a)
            counts[i:j] += np.diff(edges)
    words = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return words, np.concatenate(shape) if shape else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def hash_word(word: str) -> int:
    """The hash that word_hashes gives one word; for tests and fixed tokens."""
    data = word.encode()
    total = sum(int(_BYTE_VALUES[LOWER[b]]) * pow(_BASE, i, 1 << 64) for i, b in enumerate(data)) & _MASK
    return int(mix64(np.array([total], dtype=np.uint64))[0])


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes, ascending, of the runs of `width` words; with fewer words, of the whole sequence as one."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    span = min(width, n)
    total = np.full(n - span + 1, np.uint64(span), dtype=np.uint64)
    for k in range(span):
        total = total * np.uint64(_BASE) + words[k : n - span + 1 + k]
    return np.unique(mix64(total))
