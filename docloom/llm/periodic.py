"""Periodic runs of words: LZ factors from a suffix automaton, runs that cross factors, runs copied with factors."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows, slices
from .words import NOT_BLANK, joined, lists, strings, words

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])
_NONE: dict[int, int] = {}


class _Automaton:
    """The suffix automaton of a sequence of letters (0 or more), with the end of each state's first occurrence.

    Most states have one transition: it lies in two flat arrays, and only further ones in a dict.
    """

    def __init__(self, s: list[int]):
        self.link, self.size, self.first = array("q", [-1]), array("q", [0]), array("q", [-1])
        self.letter, self.to, self.more = array("q", [-1]), array("q", [-1]), {}
        last = 0
        for i, c in enumerate(s):
            last = self._extend(last, i, c)

    def _state(self, size: int, first: int, letter: int, to: int, link: int) -> int:
        self.size.append(size)
        self.first.append(first)
        self.letter.append(letter)
        self.to.append(to)
        self.link.append(link)
        return len(self.size) - 1

    def step(self, state: int, c: int) -> int | None:
        return self.to[state] if self.letter[state] == c else self.more.get(state, _NONE).get(c)

    def _put(self, state: int, c: int, target: int) -> None:
        if self.letter[state] in (-1, c):
            self.letter[state], self.to[state] = c, target
        else:
            self.more.setdefault(state, {})[c] = target

    def _extend(self, last: int, i: int, c: int) -> int:
        own = self._state(i + 1, i, -1, -1, 0)
        p = last
        while p != -1 and (q := self.step(p, c)) is None:
            self._put(p, c, own)
            p = self.link[p]
        if p == -1:
            return own
        if self.size[p] + 1 == self.size[q]:
            self.link[own] = q
            return own
        clone = self._state(self.size[p] + 1, self.first[q], self.letter[q], self.to[q], self.link[q])
        if q in self.more:
            self.more[clone] = dict(self.more[q])
        while p != -1 and self.step(p, c) == q:
            self._put(p, c, clone)
            p = self.link[p]
        self.link[q] = self.link[own] = clone
        return own


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """The LZ factors (start, end, start of an earlier occurrence or -1): each is the longest that also starts earlier."""
    known, out, i, n = _Automaton(s), [], 0, len(s)
    step, first = known.step, known.first
    while i < n:
        state = size = 0
        while i + size < n and first[after := step(state, s[i + size])] - size < i:
            state, size = after, size + 1
        out.append((i, i + size, first[state] - size + 1) if size else (i, i + 1, -1))
        i += max(size, 1)
    return out


def _prefix_matches(s: list[int], until: int) -> list[int]:
    """For each place below ``until``, how many letters from there equal the beginning of s."""
    n = len(s)
    out = [0] * until
    low = high = 0
    for i in range(1, until):
        k = min(high - i, out[i - low]) if i < high else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > high:
            low, high = i, i + k
        out[i] = k
    return out


def find_runs(s: list[int], exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """All maximal runs (start, length, smallest period) of at least ``exponent`` periods and ``least`` letters.

    Kolpakov and Kucherov's way. A run that ends in the factor [b, e) and begins before or at b is found at b by
    Main's extensions: with a period of q, it has q letters right of b or q letters left of it. As the factor before,
    [a, b), could not go on to the run's end, the run begins after a - q, so with k periods q is at most
    (e - a) / (k - 1), and all windows together are linear. Any other run lies inside its factor: if it touches the
    factor's end it is found at the next boundary, else it is copied from the factor's earlier occurrence.
    """
    n = len(s)
    cuts = factors(s)
    found: dict[int, dict[int, int]] = {}

    def add(start: int, end: int, q: int) -> None:
        if end - start >= max(least, exponent * q):
            ends = found.setdefault(start, {})
            ends[end] = min(q, ends.get(end, q))

    a = 0
    for b, e, earlier in [*cuts, (n, n, -1)]:
        most = (e - a) // (exponent - 1)
        low = max(0, a - most)
        before, after = s[low:b], s[b:e]
        back = before[::-1]
        if most and b:
            # Periods with a whole block right of the boundary: forward from b + q, backward from b.
            right = min(most, len(after))
            forward = _prefix_matches(after, right + 1) if right else [0]
            backward = _prefix_matches([*back, -1, *s[low : b + right][::-1]], len(back) + 1 + right)
            for q in range(1, right + 1):
                ahead = forward[q] if q < len(after) else 0
                start, end = b - backward[len(back) + 1 + right - q], b + q + ahead
                if end - start >= exponent * q and not (end == e < n and s[e] == s[e - q]) and not (start and s[start - 1] == s[start - 1 + q]):
                    add(start, end, q)
            # Periods with a whole block left of it.
            left = min(most, len(before))
            backward = _prefix_matches(back, left + 1) if left else [0]
            forward = _prefix_matches([*after, -2, *s[b - left : e]], len(after) + 1 + left)
            for q in range(1, left + 1):
                behind = backward[q] if q < len(back) else 0
                start, end = b - q - behind, b + forward[len(after) + 1 + left - q]
                if end - start >= exponent * q and not (end == e < n and s[e] == s[e - q]) and not (start and s[start - 1] == s[start - 1 + q]):
                    add(start, end, q)
        elif most:
            forward = _prefix_matches(after, min(most, len(after)) + 1)
            for q in range(1, min(most, len(after))):
                end = b + q + forward[q]
                if not (end == e < n and s[e] == s[e - q]):
                    add(b, end, q)
        if earlier >= 0:
            shift = b - earlier
            for start in range(earlier + 1, e - shift - 1):
                for end, q in list(found.get(start, _NONE).items()):
                    if end < e - shift:
                        add(start + shift, end + shift, q)
        a = b
    return sorted((start, end - start, q) for start, ends in found.items() for end, q in ends.items())


def _stretches(code: np.ndarray, row: np.ndarray, exponent: int, least: int) -> list[tuple[int, int]]:
    """Where runs can be: stretches (first word, end) in which every word and pair of neighbours is frequent enough.

    In a run of k periods a word stands k times at least, and two neighbours k - 1 times. So no run crosses a word or
    a pair that its stretch has less often, nor does such a word go on with a run's period. Repeats until no cut is left.
    """
    at, group = np.arange(len(code)), row.astype(np.int64)
    size = int(code.max()) + 1 if len(code) else 1
    while len(at):
        own = code[at]
        _, where, count = np.unique(group * size + own, return_inverse=True, return_counts=True)
        keep = count[where] >= exponent
        joins = (group[1:] == group[:-1]) & (at[1:] == at[:-1] + 1) & keep[1:] & keep[:-1]
        linked = np.flatnonzero(joins)
        _, pair = np.unique(own[linked] * size + own[linked + 1], return_inverse=True)
        _, where, count = np.unique(group[linked] * (int(pair.max(initial=0)) + 1) + pair, return_inverse=True, return_counts=True)
        joins[linked] = count[where] >= exponent - 1
        new = np.ones(len(at), dtype=bool)
        new[1:] = ~joins
        number = np.cumsum(new) - 1
        kept = (np.bincount(number)[number] >= max(least, exponent)) & keep
        same = kept.all() and len(np.unique(group)) == number[-1] + 1
        at, group = at[kept], number[kept]
        if same:
            break
    if not len(at):
        return []
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(starts, np.append(starts[1:], len(at)))]


def _collapse(column: pa.Array, exponent: int, least: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Number of words, runs, and text without what runs repeat, of each row."""
    w = words(column, NOT_BLANK)
    size = w.end - w.start
    at = np.append(0, np.cumsum(size))
    flat = w.data[np.repeat(w.start - at[:-1], size) + np.arange(at[-1])]
    code = strings(flat, at).dictionary_encode().indices.to_numpy().astype(np.int64)
    keep, out = np.ones(len(code), dtype=bool), []
    for a, b in _stretches(code, w.row, exponent, least):
        for start, length, period in find_runs(code[a:b].tolist(), exponent, least):
            out.append((a + start, length, period))
            keep[a + start + period : a + start + length] = False
    where = np.array([r[0] for r in out], dtype=np.int64)
    row = w.row[where]
    fields = [pa.array(where - w.first[row]), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())]
    data, _, _, offsets = joined(w, keep)
    return np.diff(w.first), lists(pa.StructArray.from_arrays(fields, ["start", "length", "period"]), row, len(column)), strings(data, offsets)


def collapse_runs(docs: DataFrame, text: str = "text", exponent: int = 4, least: int = 6, runs: str = "runs", collapsed: str = "collapsed", n_words: str = "n_words") -> DataFrame:
    """Append n_words, runs and collapsed to every row, from its whole text.

    Words are what stands between blanks (space, \\t to \\r). A run is a stretch of words with a smallest period q
    (words q apart are equal) of at least ``exponent`` (2 or more) periods and ``least`` words that no neighbouring
    word extends: its start (word number from 0), length and period, ordered by start, then period. collapsed is the
    text's words, joined by one space, without those that some run holds after its first q. See ``find_runs`` for
    the method; the work of a text is linear in its words, and no row needs another.
    A null, empty or blank text has no words and no runs, and collapsed is empty. Repeated rows each stay a row;
    columns of the results' names are replaced (``collapsed`` may be the text's own name).
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            column = batch.column(batch.schema.get_field_index(text))
            parts = [_collapse(column.slice(a, b - a), exponent, least) for a, b in slices(batch, text)]
            joint = [np.concatenate([p[0] for p in parts]), *(pa.concat_arrays([p[k] for p in parts]) for k in (1, 2))]
            return dict(zip((n_words, runs, collapsed), (pa.array(joint[0].astype(np.int64)), *joint[1:])))

        return work

    fields = [T.StructField(n_words, T.LongType()), T.StructField(runs, T.ArrayType(RUN)), T.StructField(collapsed, T.StringType())]
    return map_rows(docs, fields, make)
