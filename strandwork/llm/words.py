"""Words and window hashes of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: a bijection of unsigned integers (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


@functools.lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; sizes are rounded up so that few tables are made."""
    return _powers(max(SLICE_BYTES + 1, 1 << (n - 1).bit_length()), base)[:n]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of texts of about ``limit`` bytes.

    A text over the limit is a run of its own; nulls are empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2] if n else None
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every text and the end); words are ``[^\\x20\\x09-\\x0D]+``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False  # a word never runs over from the text before
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(n, _MULTIPLIER), out=total[1:])
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    value = (total[ends] - total[starts]) * powers(n, inverse)[starts]
    hashes = mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, offsets)


def double_windows(values: np.ndarray, length: int, factor: int) -> np.ndarray:
    """Sums over windows of ``2 * length`` words from those of ``length`` words."""
    step = np.uint64(pow(factor, length, 1 << 64))
    return values[: len(values) - length] + values[length:] * step if len(values) > length else values[:0]


def window_sums(words: np.ndarray, length: int, factor: int) -> np.ndarray:
    """Ordered sum of every run of ``length`` words, by doubling; spread it with ``mix``."""
    if length == 1:
        return words
    half = window_sums(words, length // 2, factor)
    out = double_windows(half, length // 2, factor)
    if length % 2:
        step = np.uint64(pow(factor, length - 1, 1 << 64))
        n = max(0, len(words) - length + 1)
        out = out[:n] + words[length - 1 : length - 1 + n] * step
    return out


def window_starts(first: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` places start a window that stays in its text."""
    ok = np.zeros(n, bool)
    for a, b in zip(first[:-1], first[1:]):
        if b - length + 1 > a:
            ok[a : b - length + 1] = True
    return ok


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in every run of ``width`` values."""
    n = len(values)
    place = np.arange(n)
    span = 1
    while span < width:
        step = min(span, width - span)
        a, b = place[: n - span - step + 1], place[step : n - span + 1]
        place = np.where(values[b] < values[a], b, a)
        span += step
    return place


def as_long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
