"""Words of whole Arrow string columns as numpy arrays: byte ranges, row numbers and 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Odd, so that its powers have inverses modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte.
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i, modulo 2**64, for i below n."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that near values get far hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes of words: between blanks (space, \t to \r), and lower-cased runs of ASCII letters, digits and non-ASCII.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """Words of some rows. ``data`` holds all rows' bytes; row r has bytes ``row_start[r]`` to ``row_start[r + 1]``."""

    data: np.ndarray
    row_start: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    #: Number of words before each row; one more than rows.
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        up, down = powers(len(self.data))
        terms = np.append(np.uint64(0), _VALUES[self.data] * up)
        np.cumsum(terms, out=terms)
        return mix((terms[self.end] - terms[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; a null row is empty."""
    column = column.fill_null("") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array, members: np.ndarray, lower: bool = False) -> Words:
    """Maximal runs of member bytes in each row."""
    data, row_start = text_bytes(column)
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = members[data]
    start = inside[:-1].copy()
    start[1:] &= ~inside[: len(data) - 1] if len(data) > 1 else True
    cut = row_start[:-1][row_start[:-1] < len(data)]
    start[cut] = inside[cut]
    stop = inside[:-1] & ~inside[1:]
    last = row_start[1:][row_start[1:] > 0] - 1
    stop[last] = inside[last]
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    first = np.searchsorted(start, row_start)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    return Words(data, row_start, start, stop, row, first)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive values; the last n - 1 positions have none."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(hashes) + 1)
    sums = np.append(np.uint64(0), hashes * up[:-1])
    np.cumsum(sums, out=sums)
    return mix((sums[n:] - sums[:count]) * down[:count])


def spans_hash(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the values from each start to each end."""
    up, down = powers(len(hashes) + 1)
    sums = np.append(np.uint64(0), hashes * up[:-1])
    np.cumsum(sums, out=sums)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def joined(w: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The (kept) words of each row with one space between: bytes, each word's start and end there, row offsets."""
    start, end, row = (w.start, w.end, w.row) if keep is None else (w.start[keep], w.end[keep], w.row[keep])
    size = end - start
    space = np.zeros(len(row), dtype=np.int64)
    space[:-1] = row[1:] == row[:-1]
    at = np.zeros(len(row) + 1, dtype=np.int64)
    np.cumsum(size + space, out=at[1:])
    out = np.full(at[-1], 0x20, dtype=np.uint8)
    before = np.cumsum(size) - size
    step = np.arange(int(size.sum()))
    out[np.repeat(at[:-1] - before, size) + step] = w.data[np.repeat(start - before, size) + step]
    return out, at[:-1], at[:-1] + size, at[np.searchsorted(row, np.arange(len(w.row_start)))]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string array of the UTF-8 bytes between the offsets."""
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes()))


def cut_out(data: np.ndarray, row_start: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The rows' texts without the byte ranges from each start to each end (disjoint, within rows)."""
    gone = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(gone, start, 1)
    np.add.at(gone, end, -1)
    keep = np.cumsum(gone[:-1]) == 0
    left = np.append(0, np.cumsum(keep))
    return strings(data[keep], left[row_start])


def runs(flags: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of set flags within a row."""
    if not len(flags):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    same = row[1:] == row[:-1]
    first, last = flags.copy(), flags.copy()
    first[1:] &= ~(flags[:-1] & same)
    last[:-1] &= ~(flags[1:] & same)
    return np.flatnonzero(first), np.flatnonzero(last)


def lists(values: pa.Array, row: np.ndarray, rows: int) -> pa.Array:
    """A list array: each row's values, which are in the order of rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values)
