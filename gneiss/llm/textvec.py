"""Vectorised words and shingle hashes of whole Arrow text columns, at numpy speed.

Word classes here have ASCII separators only, so words of UTF-8 bytes are words of code points.
Hashes are 64-bit: a polynomial with a random 64-bit value for each byte, then a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time (a longer single text is taken whole).
SLICE_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * _U(pow(base, done, 1 << 64))
        done += take
    return out


_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)
_cache: dict[str, np.ndarray] = {"up": _powers(_BASE, 1), "down": _powers(_BACK, 1)}
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LANE = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_class(separators: list[tuple[int, int]]) -> np.ndarray:
    """True for each byte that belongs to words."""
    table = np.ones(256, dtype=bool)
    for a, b in separators:
        table[a : b + 1] = False
    return table


#: Words are runs of anything but white space.
BLANK_SEPARATED = word_class([(0x20, 0x20), (0x09, 0x0D)])
#: Words are runs of digits, letters and everything outside ASCII.
LETTERS_DIGITS = word_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


@dataclass
class Slice:
    """Consecutive rows of a column: their bytes and each row's place in them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column's texts (null: empty) in slices of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1)
        stop = min(stop, n)
        yield Slice(start, raw[offs[start] : offs[stop]], offs[start : stop + 1] - offs[start])
        start = stop


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``member`` bytes that stay inside one row."""
    n = len(member)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = member[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    before[heads] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = member[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    after[tails] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span; equal bytes have equal hashes wherever they stand."""
    n = len(data)
    if len(_cache["up"]) < n + 1:
        _cache["up"], _cache["down"] = _powers(_BASE, n + 1), _powers(_BACK, n + 1)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[data] * _cache["up"][:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _cache["down"][starts]
    return mix(h + (ends - starts).astype(np.uint64) * _ODD)


def hash_windows(data: np.ndarray, width: int) -> np.ndarray:
    """The hashes that ``hash_spans`` gives to every run of ``width`` bytes."""
    n = len(data)
    if len(_cache["up"]) < n + 1:
        _cache["up"], _cache["down"] = _powers(_BASE, n + 1), _powers(_BACK, n + 1)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[data] * _cache["up"][:n], out=sums[1:])
    h = sums[width:] - sums[: n + 1 - width]
    h *= _cache["down"][: len(h)]
    h += _U(width) * _ODD
    return mix(h)


@dataclass
class Words:
    """Words of a slice: byte spans, hashes, and the row borders in the list of words."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    borders: np.ndarray


def words(part: Slice, members: np.ndarray, lower: bool = True) -> Words:
    data = LOWER[part.data] if lower else part.data
    starts, ends = runs(members[data], part.offsets)
    return Words(starts, ends, hash_spans(data, starts, ends), np.searchsorted(starts, part.offsets))


def shingles(hashes: np.ndarray, borders: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of each row, and the new borders.

    A row of fewer words, but not none, has one shingle: the whole row.
    """
    counts = np.diff(borders)
    n = len(hashes)
    long = np.maximum(counts - width + 1, 0)
    out = np.where((long == 0) & (counts > 0), 1, long)
    fresh = np.concatenate([[0], np.cumsum(out)])
    if not fresh[-1]:
        return np.empty(0, np.uint64), fresh
    full = np.zeros(max(n - width + 1, 0), dtype=np.uint64)
    for j in range(width):
        full += hashes[j : j + len(full)] * _LANE[j]
    result = np.empty(fresh[-1], dtype=np.uint64)
    row = np.repeat(np.arange(len(counts)), long)
    at = np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long)
    result[np.repeat(fresh[:-1], long) + at] = full[borders[row] + at]
    for r in np.flatnonzero((long == 0) & (counts > 0)):
        own = hashes[borders[r] : borders[r + 1]]
        result[fresh[r]] = np.bitwise_xor.reduce(mix(own * _LANE[: len(own)] + _U(len(own)))) + _U(len(own))
    return mix(result), fresh


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    out = np.sort(hashes)
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def sorted_sets(hashes: np.ndarray, borders: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct hashes of each row."""
    return [distinct(hashes[a:b]) for a, b in zip(borders[:-1], borders[1:], strict=True)]
