"""Vectorised words and n-gram hashes over Arrow string columns.

Texts stay in their Arrow buffers: words are found with byte tables and hashed
with prefix sums of a polynomial modulo 2^64, finished by a 64-bit mixer, so a
text never becomes a Python object. Equal words always get equal hashes; unequal
ones collide with a probability near 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that part words: the white space class [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Text handled at a time; longer texts are cut between words.
SLICE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_SALT = 0xC2B2AE3D27D4EB4F
_LEN = np.uint64(_SALT)
_powers: dict[str, np.ndarray] = {}


def _table(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base & (2**64 - 1), np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def powers(n: int) -> np.ndarray:
    return _table(_BASE, n, "up")


def inverses(n: int) -> np.ndarray:
    return _table(pow(_BASE, -1, 2**64), n, "down")


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets.astype(np.int64)


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text (one longer text alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


class Words:
    """Words of some rows: hash, byte start and end of each, and each row's range of words."""

    def __init__(self, hash: np.ndarray, start: np.ndarray, end: np.ndarray, rows: np.ndarray):
        self.hash, self.start, self.end, self.rows = hash, start, end, rows

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)


def find(data: np.ndarray, offsets: np.ndarray, lower: bool = False, sep: np.ndarray = SPACE) -> Words:
    """Words of the rows that ``offsets`` bound: runs of bytes outside ``sep``; rows part words too."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    table = _LOWER if lower else _BYTE
    starts, ends, hashes = [], [], []
    at = lo
    while at < hi:
        stop = min(hi, at + 2 * SLICE)
        if stop < hi:  # a long text: cut it after a separator
            back = np.flatnonzero(sep[data[at:stop]])
            if len(back):
                stop = at + int(back[-1]) + 1
            else:  # one word longer than the slice
                while stop < hi:
                    more = np.flatnonzero(sep[data[stop:stop + SLICE]])
                    if len(more):
                        stop += int(more[0]) + 1
                        break
                    stop = min(hi, stop + SLICE)
        part = data[at:stop]
        inside = ~sep[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = offsets[(offsets > at) & (offsets < stop)] - at
        first[edge] |= inside[edge]
        last[edge - 1] |= inside[edge - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        n = len(part)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[part] * powers(n), out=total[1:])
        hashes.append(mix((total[e] - total[s]) * inverses(n)[s] + (e - s).astype(np.uint64) * _LEN))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    if not starts:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64))
    start = np.concatenate(starts)
    return Words(np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offsets))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive values (rows are not looked at)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(h * powers(n), out=total[1:])
    return mix((total[k:] - total[:-k]) * inverses(n - k + 1) + np.uint64(k * _SALT % 2**64))


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's ``k``-word shingles and the row ranges; a row of fewer words has one of all its words."""
    h, rows = words.hash, words.rows
    n = words.counts
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_rows = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(int(out_rows[-1]), np.uint64)
    every = rolling(h, k)
    if len(every):
        row_of = words.row_of()[:len(every)]
        out_at = np.arange(len(every)) + (out_rows[:-1] - rows[:-1])[row_of]
        ok = np.arange(len(every)) + k <= rows[1:][row_of]
        out[out_at[ok]] = every[ok]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(len(h)), dtype=np.uint64)])
        s, e = rows[short], rows[short + 1]
        out[out_rows[short]] = mix((total[e] - total[s]) * inverses(len(h))[s] + (e - s).astype(np.uint64) * _LEN)
    return out, out_rows


def sorted_sets(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row in ascending order, with the new row ranges."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(rows) - 1))]).astype(np.int64)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 on as bytes of seven bits each, the lowest first, all but a number's last marked; and the end of each."""
    size = np.ones(len(values), np.int64)
    bits = 7
    while len(values) and bits < 63 and int(values.max()) >> bits:
        size += values >> bits > 0
        bits += 7
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(bits // 7):
        mine = np.flatnonzero(size > k)
        out[(ends - size)[mine] + k] = ((values[mine] >> (7 * k)) & 127) | ((size[mine] > k + 1) << 7)
    return out, ends


def unpack(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that ``pack`` wrote, and the end of each."""
    ends = np.flatnonzero(data < 128) + 1
    start = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    size = ends - start
    out = np.zeros(len(ends), np.int64)
    for k in range(int(size.max()) if len(size) else 0):
        mine = np.flatnonzero(size > k)
        out[mine] |= (data[start[mine] + k] & 127).astype(np.int64) << (7 * k)
    return out, ends
