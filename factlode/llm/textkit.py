"""Vectorised reading of text inside tasks: whole batches of UTF-8 bytes as numpy arrays.

Every helper works on a *block*: the bytes of a few consecutive rows end to end, with the
rows' offsets. Blocks keep temporary arrays small (about 1 MB of text each); a longer text
is a block of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes that separate words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SOLID = ~SPACE
#: Bytes that begin a code point.
LEADS = (np.arange(256) & 0xC0) != 0x80
_STEP = 0xD1342543DE82EF95
#: Moduli of the span hash, primes below 2**31: products fit 64 bits, and so do sums of 2**32 terms.
PRIMES = (U64((1 << 31) - 1), U64((1 << 31) - 19))
_BASES = (1_104_515_243, 1_872_304_559)
#: Powers are kept for blocks of usual size; a longer text's are made for it alone.
_KEPT = (1 << 20) + 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input reaches each bit of the output."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE = mix(np.arange(1, 257, dtype=U64))
#: The same for lower-cased A-Z.
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]


def _rest(x: np.ndarray, p: np.uint64) -> np.ndarray:
    return x - (x // p) * p


def _power_table(base: int, p: np.uint64, n: int) -> np.ndarray:
    out, have = np.ones(n, U64), 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = _rest(out[:step] * U64(pow(base, have, int(p))), p)
        have += step
    return out.astype(np.uint32)


def powers(side: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of one side's base and of its inverse, at least n + 1 of each."""
    p, base = PRIMES[side], _BASES[side]
    make = lambda size: tuple(_power_table(b, p, size) for b in (base, pow(base, -1, int(p))))
    if n + 1 > _KEPT:
        return make(n + 1)
    if side not in _POWERS:
        _POWERS[side] = make(_KEPT)
    return _POWERS[side]


class Spans:
    """Hashes of any byte spans of a block, each in constant time.

    Two polynomials modulo different primes and with different bases. A power of two as modulus
    would make some different strings (those of Thue and Morse) alike for every base."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE):
        self.sides = []
        for side, p in enumerate(PRIMES):
            up, down = powers(side, len(data))
            sums = np.zeros(len(data) + 1, U64)
            np.cumsum(_rest((values % p)[data] * up[: len(data)], p), out=sums[1:])
            self.sides.append((sums, down, p))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = np.zeros(len(starts), U64)
        for sums, down, p in self.sides:
            h = (h << U64(32)) | _rest(_rest(sums[ends] - sums[starts], p) * down[starts], p)
        return mix(h + (ends - starts).astype(U64) * U64(_STEP))


class RoughSpans:
    """The same modulo 2**64: half the work, but some different long strings are alike.

    Only for anchors, where two strings that are taken for one cost work and no result."""

    _BASE = 0x9E3779B97F4A7C15
    _kept: list[np.ndarray] = []

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        tables = self._kept
        if not tables or len(tables[0]) < n:
            tables = [np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(max(n, _KEPT) - 1, b, U64)])) for b in (self._BASE, pow(self._BASE, -1, 1 << 64))]
            if n <= _KEPT:
                RoughSpans._kept = tables
        self.down = tables[1]
        self.sums = np.zeros(n, U64)
        np.cumsum(BYTE[data] * tables[0][: n - 1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(U64) * U64(_STEP))


def grams32(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each position at which so many are left."""
    n = len(data) - 31
    if n <= 0:
        return np.zeros(0, U64)
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,)).astype(U64)
    h = eight[:n] * U64(0x9E3779B97F4A7C15)
    for k in (8, 16, 24):
        h ^= h >> U64(29)
        h += eight[k : k + n]
        h *= U64(0xBF58476D1CE4E5B9)
    return mix(h)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


def blocks(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets within them) of consecutive rows of about ``size`` bytes."""
    data, offsets = utf8(column)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    solid = SOLID[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edge] = solid[edge]
    edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edge] = solid[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def windows(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k items from each position, and whether they lie in one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    h = np.zeros(n, U64)
    for j in range(k):
        h *= U64(_STEP)
        h += hashes[j : j + n]
    return mix(h), rows[:n] == rows[k - 1 :]


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of a block's positions are set in each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def covered(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in any span of ``length`` from ``starts``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:n]) > 0


def word_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)
