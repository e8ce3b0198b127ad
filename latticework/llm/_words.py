"""Vectorised hashing of the words of whole texts.

A word is a maximal run of bytes other than space and 0x09-0x0D. Its 64-bit name is a function of its
bytes alone, so equal words have equal names in every task; unequal words share one with odds 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Texts are hashed in runs of about this many bytes; one longer text makes a run of its own.
RUN_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Powers:
    def __init__(self):
        self.p = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.p):
            self.p = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, _STEP, np.uint64))])
        return self.p


_POWERS = _Powers()


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copies; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def word_runs(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: (first text, last text + 1, word names, word starts a text, byte start and end of the words in their text).

    ``word starts`` has one entry more than there are texts: words w[k] to w[k + 1] are those of text k.
    """
    if not len(column):
        return
    table = _BYTE_LOWER if lower else _BYTE
    data, offsets = _raw(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, "right")) - 1)
        last = min(last, len(column))
        own = data[offsets[first] : offsets[last]]
        bounds = offsets[first : last + 1] - offsets[first]
        solid = ~_WHITE[own]
        opens, closes = solid.copy(), solid.copy()
        inner = bounds[(bounds > 0) & (bounds < len(own))]
        if len(own):
            before, after = solid[:-1].copy(), solid[1:].copy()
            before[inner - 1] = False
            after[inner - 1] = False
            opens[1:] &= ~before
            closes[:-1] &= ~after
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        size = ends - starts
        if len(starts):
            at = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(at, size)
            names = np.add.reduceat(table[own[solid]] * _POWERS.upto(int(size.max()))[place], at)
            names = mix(names + size.astype(np.uint64))
        else:
            names = np.zeros(0, np.uint64)
        split = np.searchsorted(starts, bounds)
        base = np.repeat(bounds[:-1], np.diff(split))
        yield first, last, names, split, starts - base, ends - base
        first = last


def windows(names: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Names of all runs of ``width`` words in a row."""
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = mix(np.array([seed * 2 + 1], np.uint64))[0] | np.uint64(1)
    out, power = names[width - 1 : width - 1 + n].copy(), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(width - 2, -1, -1):
            power = power * step
            out += names[k : k + n] * power
    return mix(out ^ step)
