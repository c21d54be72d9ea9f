"""Vectorised scans over Arrow text columns: words, hashes of words and of windows without per-word Python.

Every function here works on whole texts. A batch is cut into chunks of whole rows of about `CHUNK` bytes so that the
working arrays stay small; one row longer than that forms its own chunk. Nulls read as empty texts.

Hashes of bytes are chained through `mix`, which is not linear, so that no arrangement of equal bytes cancels out (sums of
powers modulo 2^64 do on Thue-Morse sequences). Where a part of a sequence has to be taken out again, sums of powers are
used, modulo a prime and with several bases (`Powers`).
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = (1 << 20) - 1
PRIME = (1 << 31) - 1
_BASES = tuple(int(x) for x in np.random.default_rng(20240229).integers(1 << 20, PRIME, 4))
_LEFT, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x94D049BB133111EB)
_LONG = 4096
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Truth table over byte values, true inside the given closed ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of a word when words are split at space, tab, line feed, vertical tab, form feed and carriage return.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Bytes of a word when only digits, ASCII letters and everything beyond ASCII belong to words.
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Lower-cases A to Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def chained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One value from two, in their order."""
    return mix(a * _LEFT + b)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one value, as a view; zeros follow the last byte."""
    room = np.zeros(len(data) + 8, dtype=np.uint8)
    room[: len(data)] = data
    return np.ndarray((len(data) + 1,), np.uint64, room.data, 0, (1,))


def hash_ranges(eight: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the bytes of each range, given eights(). Ranges beyond _LONG bytes are hashed one by one."""
    size = end - start
    h = mix(size.astype(np.uint64) * _LENGTH + np.uint64(seed))
    for k in np.flatnonzero(size > _LONG).tolist():
        raw = eight[start[k] : end[k] : 8].tobytes()[: int(size[k])]
        h[k] ^= np.frombuffer(hashlib.blake2b(raw, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), np.uint64)[0]
    open_ = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left, own = start[open_], size[open_], h[open_]
    while len(open_):
        part = eight[at] & _KEEP[np.minimum(left, 8)]
        own = chained(own, part)
        more = left > 8
        h[open_[~more]] = own[~more]
        open_, at, left, own = open_[more], at[more] + 8, left[more] - 8, own[more]
    return h


def windows_of(values: np.ndarray, size: int, unit: int = 1) -> np.ndarray:
    """A hash of each stretch of `size` elements, of values of which each stands for the `unit` elements from its place on."""
    covers, h = unit, mix(values + np.uint64(size * int(_LENGTH) % (1 << 64)))
    while covers * 2 <= size:
        h = chained(h[: max(0, len(h) - covers)], h[covers:])
        covers *= 2
    if covers < size:
        h = chained(h[: max(0, len(h) - (size - covers))], h[size - covers :])
    return h


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, of values below 2^63."""
    prime = np.uint64(PRIME)
    x = (x & prime) + (x >> np.uint64(31))
    x = (x & prime) + (x >> np.uint64(31))
    return np.where(x >= prime, x - prime, x)


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(x: int) -> np.ndarray:
        out = np.ones(1, dtype=np.uint64)
        while len(out) < n:
            out = np.concatenate([out, _reduced(out * np.uint64(pow(x, len(out), PRIME)))])
        return out

    return run(base), run(pow(base, -1, PRIME))


class Powers:
    """Hashes of any stretch of a sequence of 64-bit values, also without one of them, from running sums of powers of two
    bases modulo PRIME (62 bits). `pair` chooses the bases."""

    def __init__(self, values: np.ndarray, pair: int = 0):
        n, size = len(values), 1 << 16
        while size < n + 1:
            size *= 2
        self.parts = []
        for base in _BASES[2 * pair : 2 * pair + 2]:
            power, inverse = _powers(base, size)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_reduced((values % np.uint64(PRIME)) * power[:n]), out=sums[1:])
            self.parts.append((sums, power, inverse))

    def _joined(self, parts: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        return mix((parts[0] << np.uint64(31) | parts[1]) + size.astype(np.uint64) * _LENGTH)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Depends on the stretch's values and length alone."""
        return self._joined([_reduced(_reduced(sums[end] - sums[start]) * inverse[start]) for sums, _, inverse in self.parts], end - start)

    def without(self, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """As `of` the stretch without the value at `at`."""
        out = []
        for sums, _, inverse in self.parts:
            before, after = _reduced(sums[at] - sums[start]), _reduced(sums[end] - sums[at + 1])
            out.append(_reduced(_reduced(before + _reduced(after * inverse[1])) * inverse[start]))
        return self._joined(out, end - start - 1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of stretches of whole rows."""
    data, offsets = buffers(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        stop = min(stop, n)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


class Words:
    """Words of the rows of a chunk: byte ranges, and the index of each row's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, members: np.ndarray):
        inside = members[data]
        n = len(data)
        before = np.zeros(n, dtype=bool)
        after = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges] = False
        after[edges - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, size: int) -> np.ndarray:
        """Indexes of words at which `size` words of the same row begin."""
        last = np.repeat(self.first[1:], self.count)
        return np.flatnonzero(np.arange(len(self.start)) + size <= last)


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    return hash_ranges(eights(data), words.start, words.end)


def ids_of(values: np.ndarray, table: np.ndarray, missing: int) -> np.ndarray:
    """Positions of values in a sorted table, or `missing`."""
    if not len(table):
        return np.full(len(values), missing, dtype=np.int64)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, missing)
