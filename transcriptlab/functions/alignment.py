"""Alignment of two sequences by their longest common blocks, for batches of pairs at once.

The longest block of items that both sequences hold is found, the earliest in the first and then in the second on ties; what lies before it on
both sides is aligned in the same way, and what lies behind it.  All open stretches of all pairs of a batch go
through one table together, a row of it at a time, so that a batch takes as many steps as its longest stretch is long.  Long texts, of which
few letters begin blocks, go without a table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import _coded

Sequences = tuple[np.ndarray, np.ndarray]
BLOCKS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("a", "b", "size")]))
#: In second sequences of that many items, those that make up over a hundredth begin no block if frequent items are left out.
LONG = 200
#: Cells of the table's rows that are held at once; one pair alone may have more.
CELLS = 1_000_000


def _stretches(codes: np.ndarray, first: np.ndarray, size: np.ndarray, fill: int) -> np.ndarray:
    at = np.arange(max(int(size.max(initial=0)), 1))
    inside = at < size[:, None]
    return np.where(inside, codes[np.minimum(first[:, None] + at, max(len(codes) - 1, 0))] if len(codes) else fill, fill)


def longest_blocks(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in x, place in y, size) of the longest common block of each row; padding differs between the two.  (0, 0, 0) where there is none."""
    n = len(x)
    run = np.zeros((n, y.shape[1]), np.int32)
    size, i_end, j_end = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    rows = np.arange(n)
    for i in range(x.shape[1]):
        before = np.zeros_like(run)
        before[:, 1:] = run[:, :-1]
        run = np.where(y == x[:, [i]], before + 1, 0)
        j = run.argmax(1)
        longer = run[rows, j] > size
        size[longer], i_end[longer], j_end[longer] = run[rows, j][longer], i, j[longer]
    return np.where(size, i_end - size + 1, 0), np.where(size, j_end - size + 1, 0), size


def grown(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of each row with the equal items on both sides of them."""
    rows = np.arange(len(x))
    while (more := (i > 0) & (j > 0) & (x[rows, i - 1] == y[rows, j - 1])).any():
        i, j, size = i - more, j - more, size + more
    while (more := (i + size < x.shape[1]) & (j + size < y.shape[1]) & (x[rows, np.minimum(i + size, x.shape[1] - 1)] == y[rows, np.minimum(j + size, y.shape[1] - 1)])).any():
        size = size + more
    return i, j, size


def without_frequent(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Codes of sequences, those left out that are frequent in a long one."""
    row = np.repeat(np.arange(len(n)), n)
    _, place, count = np.unique(np.stack([row, y]), axis=1, return_inverse=True, return_counts=True)
    return np.where((n[row] >= LONG) & (count[place.ravel()] > n[row] // 100 + 1), -3, y)


def matching_blocks(first: Sequences, second: Sequences, cells: int = CELLS, frequent: bool = True) -> tuple[np.ndarray, ...]:
    """(row, a, b, size) of all blocks, in order, neighbours joined; each side is (codes, sizes) of the sequences of all rows.

    frequent: whether frequent items of a long second sequence may begin blocks; else they only lengthen them.
    """
    (x, m), (y, n) = first, second
    seeds = y if frequent or not (n >= LONG).any() else without_frequent(y, n)
    a0, b0 = np.cumsum(m) - m, np.cumsum(n) - n
    open_ = np.stack([np.arange(len(m)), np.zeros_like(m), m, np.zeros_like(n), n], 1)
    found = [np.zeros((0, 4), np.int64)]
    while len(open_):
        open_ = open_[(open_[:, 1] < open_[:, 2]) & (open_[:, 3] < open_[:, 4])]
        open_ = open_[np.argsort(open_[:, 4] - open_[:, 3], kind="stable")]
        after, start = [], 0
        while start < len(open_):
            width = np.cumsum(open_[start:, 4] - open_[start:, 3])
            stop = start + max(1, int(np.searchsorted(width, cells, side="right")))
            row, alo, ahi, blo, bhi = open_[start:stop].T
            left, right = _stretches(x, a0[row] + alo, ahi - alo, -1), _stretches(seeds, b0[row] + blo, bhi - blo, -2)
            i, j, size = longest_blocks(left, right)
            if seeds is not y:
                i, j, size = grown(left, _stretches(y, b0[row] + blo, bhi - blo, -2), i, j, size)
            some = size > 0
            row, alo, ahi, blo, bhi, i, j, size = (v[some] for v in (row, alo, ahi, blo, bhi, alo + i, blo + j, size))
            found.append(np.stack([row, i, j, size], 1))
            after += [np.stack([row, alo, i, blo, j], 1), np.stack([row, i + size, ahi, j + size, bhi], 1)]
            start = stop
        open_ = np.concatenate(after) if after else open_[:0]
    row, a, b, size = np.concatenate(found)[np.lexsort(np.concatenate(found)[:, [1, 0]].T)].T
    new = np.append(True, (row[1:] != row[:-1]) | (a[1:] != a[:-1] + size[:-1]) | (b[1:] != b[:-1] + size[:-1])) if len(row) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return row[at], a[at], b[at], np.add.reduceat(size, at) if len(at) else size


class _Shared:
    """Letters of the blocks found so far and the most that there can be, for two texts that should share some least number of them."""

    def __init__(self, x: str, y: str, need: int | None):
        self.need, self.total, self.most = need, 0, min(len(x), len(y))

    def told(self) -> bool:
        """Whether it is known on which side of the least number the right one lies; never where there is none."""
        return self.need is not None and (self.total >= self.need or self.most < self.need)

    def add(self, alo: int, ahi: int, blo: int, bhi: int, i: int, j: int, size: int) -> None:
        """A block of a stretch, or none where its size is 0."""
        self.total += size
        left = min(ahi - alo, bhi - blo)
        self.most -= left - (size + min(i - alo, j - blo) + min(ahi - i - size, bhi - j - size) if size else 0)


def _places_of(letter: str, text: str) -> list[int]:
    out, i = [], text.find(letter)
    while i >= 0:
        out.append(i)
        i = text.find(letter, i + 1)
    return out


def shared_letters(x: str, y: str, need: int | None = None) -> int:
    """Letters of all matching blocks of two texts, the frequent ones of y left out as beginnings where y is long.  need: any number will do on the same side of it.

    What begins a block is a run of rare letters, and there are few: runs of each length are looked up by what they say, the longest first.
    A stretch without a run of one length has none in its parts, so each place is looked at about once for each length.
    """
    count = {c: y.count(c) for c in set(y)}
    if len(y) >= LONG:
        count = {c: n for c, n in count.items() if n <= len(y) // 100 + 1}
    places = [{c: _places_of(c, y) for c in count}]
    starts = [sorted(chain.from_iterable(_places_of(c, x) for c in count))]
    while starts[-1]:
        z = len(starts) + 1
        longer: dict[str, list[int]] = {}
        rest = {j for p in places[-1].values() for j in p}
        for p in places[-1].values():
            for j in p:
                if j + 1 in rest:
                    longer.setdefault(y[j : j + z], []).append(j)
        starts.append([i for i in starts[-1] if x[i : i + z] in longer and len(x) - i >= z])
        places.append(longer)
    known, open_ = _Shared(x, y, need), [(0, len(x), 0, len(y), len(starts) - 1)]
    while open_ and not known.told():
        alo, ahi, blo, bhi, z = open_.pop()
        found = None
        while z and found is None:
            ways, at, of = starts[z - 1], bisect_left(starts[z - 1], alo), places[z - 1]
            while at < len(ways) and (i := ways[at]) + z <= ahi:
                p = of.get(x[i : i + z], ())
                k = bisect_left(p, blo)
                if k < len(p) and p[k] + z <= bhi:
                    found = i, p[k]
                    break
                at += 1
            else:
                z -= 1
        i, j = found or (alo, blo)  # without one, what both begin with is a block
        i_end, j_end = i + z, j + z
        while i > alo and j > blo and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
        while i_end < ahi and j_end < bhi and x[i_end] == y[j_end]:
            i_end, j_end = i_end + 1, j_end + 1
        known.add(alo, ahi, blo, bhi, i, j, i_end - i)
        if i_end == i:
            continue
        if i > alo and j > blo:
            open_.append((alo, i, blo, j, z - 1))
        if i_end < ahi and j_end < bhi:
            open_.append((i_end, ahi, j_end, bhi, z))
    return known.total


def _longest_run(x: str, y: str, bits: dict[str, int], first: int) -> tuple[int, int, int]:
    """(place in x, place in y, size) of the longest block of two texts, the earliest in x and then in y; all 0 without one.

    bits: where each letter stands in a text that has y from ``first`` on.  The table of equal letters is one whole number, a row for each letter
    of x with a bit at least that ends it; runs are found by shifts along its diagonals.
    """
    if len(x) <= len(y):
        if (j := y.find(x)) >= 0 or len(x) == 1:
            return (0, j, len(x)) if j >= 0 else (0, 0, 0)
    elif (i := x.find(y)) >= 0 or len(y) == 1:
        return (i, 0, len(y)) if i >= 0 else (0, 0, 0)
    width, inside = len(y) // 8 + 1, (1 << len(y)) - 1
    rows = {c: (bits.get(c, 0) >> first & inside).to_bytes(width, "little") for c in set(x)}
    runs, z, step = [int.from_bytes(b"".join(map(rows.__getitem__, x)), "little")], 1, 8 * width + 1
    if not runs[0]:
        return 0, 0, 0
    while twice := runs[-1] & (runs[-1] >> z * step):
        runs.append(twice)
        z *= 2
    best = runs.pop()
    while runs:
        if longer := best & (runs[-1] >> z * step):
            best, z = longer, z + (1 << len(runs) - 1)
        runs.pop()
    i, j = divmod((best & -best).bit_length() - 1, 8 * width)
    return i, j, z


def shared_runs(x: str, y: str, need: int | None = None) -> int:
    """Letters of all matching blocks of two texts, where any letter may begin one.  need: any number will do on the same side of it."""
    bits: dict[str, int] = {}
    for j, c in enumerate(y):
        bits[c] = bits.get(c, 0) | 1 << j
    known, open_ = _Shared(x, y, need), [(0, len(x), 0, len(y))]
    while open_ and not known.told():
        alo, ahi, blo, bhi = open_.pop()
        i, j, size = _longest_run(x[alo:ahi], y[blo:bhi], bits, blo)
        i, j = alo + i, blo + j
        known.add(alo, ahi, blo, bhi, i, j, size)
        if size and i > alo and j > blo:
            open_.append((alo, i, blo, j))
        if size and i + size < ahi and j + size < bhi:
            open_.append((i + size, ahi, j + size, bhi))
    return known.total


def _letters(texts: list[str]) -> np.ndarray:
    """The code points of texts, from 1 on, one text a row and filled up with 0 at the end."""
    size = np.array([len(t) for t in texts], np.int64)
    return _stretches(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32) + 1, np.cumsum(size) - size, size, 0)


def _in_order(x: list[str], y: list[str]) -> np.ndarray:
    """The most letters that each two texts share in their order, which blocks never exceed.  A row of a table is some words of 64 bits, a bit for each letter of y."""
    a, b = _letters(x).T, _letters(y).T
    number = np.zeros(max(a.max(), b.max()) + 1, np.int32)
    number[b] = 1
    number[0] = 0
    n = int(number.sum()) + 1  # 0 is what texts are filled up with and what y hasn't
    number[number > 0] = np.arange(1, n)
    a, b = number[a], number[b]
    base, words = np.arange(len(x)) * n, -(-len(b) // 64)
    places = np.zeros((words, len(x) * n), np.uint64)
    for j, at in enumerate(b):
        places[j >> 6][base + at] |= np.uint64(1 << (j & 63))
    places[:, base] = 0
    left = [np.full(len(x), ~np.uint64(0)) for _ in range(words)]
    for at in a:
        at = base + at
        carry = np.uint64(0)
        for w in range(words):
            met = left[w] & places[w][at]
            sums = left[w] + met
            more = sums < met
            sums += carry
            carry = (more | (sums < carry)).astype(np.uint64)
            left[w] = sums | (left[w] & ~met)
    return np.sum([np.bitwise_count(~w) for w in left], 0, np.int64)


def in_orders(pairs: list[tuple[str, str]], cells: int = CELLS // 5) -> np.ndarray:
    """The most letters that the texts of each pair share in their order, whichever comes first."""
    out = np.zeros(len(pairs), np.int64)
    sides = [(x, y) if len(x) >= len(y) else (y, x) for x, y in pairs]
    order = sorted(range(len(pairs)), key=lambda k: (len(sides[k][1]) // 64, len(sides[k][0])))
    start = 0
    while start < len(order):
        stop, width = start + 1, len(sides[order[start]][0])
        while stop < len(order) and (stop - start + 1) * max(width, len(sides[order[stop]][0])) <= cells:
            width = max(width, len(sides[order[stop]][0]))
            stop += 1
        some = order[start:stop]
        out[some] = _in_order([sides[k][0] for k in some], [sides[k][1] for k in some])
        start = stop
    return out


def shared_at_least(x: str, y: str, least: float, most: int | None = None) -> int:
    """Letters in matching blocks of two texts; any number will do whose share of both lies on the same side of ``least``, the right one where this is 0.

    most: what they share in their order, if known.
    """
    both = len(x) + len(y)
    if not (x and y) or 2.0 * min(len(x), len(y)) / both < least:
        return 0
    need = None
    if least > 0:
        need = int(least * both / 2)
        need += (2.0 * need / both < least) - (2.0 * (need - 1) / both >= least)
        if most is not None and most < need:
            return 0
    return shared_letters(x, y, need) if len(y) >= LONG else shared_runs(x, y, need)


def shared(pairs: list[tuple[str, str, float]]) -> list[int]:
    """``shared_at_least`` for many pairs; 0 for equal texts."""
    near = lambda x, y, least: x != y and least > 0 and len(y) < LONG and 2.0 * min(len(x), len(y)) / max(len(x) + len(y), 1) >= least
    key = lambda x, y: (x, y) if x < y else (y, x)
    known = list(dict.fromkeys(key(x, y) for x, y, least in pairs if near(x, y, least)))
    most = dict(zip(known, in_orders(known).tolist(), strict=True))
    return [0 if x == y else shared_at_least(x, y, least, most.get(key(x, y))) for x, y, least in pairs]


@F.arrow_udf(BLOCKS)
def _blocks(a: pa.Array, b: pa.Array) -> pa.Array:
    row, i, j, size = matching_blocks(*_coded(a, b))
    items = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in (i, j, size)], ["a", "b", "size"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(a) + 1)).astype(np.int32)), items)


@F.arrow_udf(T.LongType())
def _matched(a: pa.Array, b: pa.Array, least: pa.Array) -> pa.Array:
    """Letters in matching blocks; 0 is good enough for equal texts, and any number on the right side of the share that is asked for."""
    return pa.array(shared(list(zip(a.to_pylist(), b.to_pylist(), least.to_pylist(), strict=True))), pa.int64())


@F.arrow_udf(T.ArrayType(T.LongType()))
def _supports(texts: pa.Array, least: pa.Array, weights: pa.Array) -> pa.Array:
    rows = list(zip(texts.to_pylist(), least.to_pylist(), weights.to_pylist(), strict=True))
    letters = iter(shared([(x, y, need) for row, needs, _ in rows for x, need in zip(row, needs, strict=True) for y in row]))
    like = lambda x, y, need: (2.0 * next(letters) / max(len(x) + len(y), 1) >= need) | (x == y)
    return pa.array([[sum(v for y, v in zip(row, voices, strict=True) if like(x, y, need)) for x, need in zip(row, needs, strict=True)] for row, needs, voices in rows], pa.list_(pa.int64()))


def supports(texts: Column, least: Column, weights: Column) -> Column:
    """For each text of an array the weights of those that are as like it as it asks for, itself included.  No nulls; least: 1 at most."""
    return _supports(texts, least, weights)


def common_blocks(a: Column, b: Column) -> Column:
    """The blocks that two arrays of strings share: array of struct(a, b, size), places from 0; null counts as empty."""
    empty = F.array().cast("array<string>")
    return _blocks(F.coalesce(a, empty), F.coalesce(b, empty))


def _share(a: Column, b: Column, least: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(2.0 * _matched(a, b, least) / F.greatest(F.length(a) + F.length(b), F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    """Twice the letters that two texts share in blocks, as a share of the letters of both; 1 for equal texts; null counts as empty.

    In a second text of LONG letters or more the frequent ones begin no block.
    """
    return _share(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")), F.lit(0.0))


def alike(a: Column, b: Column, least: Column) -> Column:
    """Whether the likeness is so much; pairs without enough letters for it aren't aligned."""
    return _share(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")), least.cast("double")) >= least
