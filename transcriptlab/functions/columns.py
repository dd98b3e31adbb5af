"""Column builders over transcripts.  All are JVM expressions but edit distances and repeated runs, which go by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = T.ArrayType(T.StringType())
#: Words as Unicode letters, digits and underscore (combining marks end a word).
TOKEN = r"[\p{L}\p{N}_]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once for each row however often it is used, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column, pattern: str = TOKEN, lower: bool = True) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(pattern), F.lit(0))


def _coded(*lists: pa.Array, lower: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each column of lists a number for every item, the same for equal items, and the lists' sizes; lower: whatever their case."""
    flat = [x.flatten() for x in lists]
    coded = pa.concat_arrays([f.cast(pa.string()) for f in flat]).dictionary_encode()
    codes = pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    if lower:
        # each different word once
        low: dict[str | None, int] = {}
        codes = np.array([low.setdefault(w.lower(), len(low)) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()] + [-3], np.int64)[codes]
    parts = np.split(codes, np.cumsum([len(f) for f in flat])[:-1])
    return [(c, pc.fill_null(x.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)) for c, x in zip(parts, lists, strict=True)]


def item_lists(lists: pa.Array) -> Iterator[list | None]:
    """The lists of a column of strings as Python's, equal items as one object."""
    coded = lists.flatten().dictionary_encode()
    words = np.append(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), None)
    flat = words[pc.fill_null(coded.indices, len(words) - 1).to_numpy(zero_copy_only=False)].tolist()
    ends = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)).tolist()
    start = 0
    for stop, known in zip(ends, lists.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=True):
        yield flat[start:stop] if known else None
        start = stop


def _padded(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, fill: int) -> np.ndarray:
    """The items of some lists, one list a row, filled up at the end."""
    at = np.arange(max(1, int(sizes.max(initial=0))))
    return np.where(at < sizes[:, None], codes[np.minimum(starts[:, None] + at, max(len(codes) - 1, 0))] if len(codes) else fill, fill)


def _distances(ref: pa.Array, hyp: pa.Array, lower: bool = False, cells: int = 4_000_000) -> np.ndarray:
    """Edit distances of lists.  A row of the table is a word of bits, which tell where its neighbours differ: 64 items or more at a time."""
    return coded_distances(*_coded(ref, hyp, lower=lower), cells)


def coded_distances(ref: tuple[np.ndarray, np.ndarray], hyp: tuple[np.ndarray, np.ndarray], cells: int = 4_000_000) -> np.ndarray:
    (a, m), (b, n) = ref, hyp
    a0, b0 = np.cumsum(m) - m, np.cumsum(n) - n
    out = np.where(m == 0, n, m)
    both = (m > 0) & (n > 0)
    long = [(i, *_without_ends(a[a0[i] : a0[i] + m[i]], b[b0[i] : b0[i] + n[i]])) for i in np.flatnonzero(both & (np.maximum(m, n) > 64)).tolist()]
    for i, x, y in long:
        out[i] = len(x) + len(y)
    long = [(i, x, y) for i, x, y in long if len(x) and len(y)]
    if long:
        sides = [(np.concatenate(lists), np.array([len(z) for z in lists])) for lists in ([x for _, x, _ in long], [y for _, _, y in long])]
        for (i, x, y), least, most in zip(long, *map(np.ndarray.tolist, _long_bounds(*sides)), strict=True):
            out[i] = least if least == most else _long_distance(x.tolist(), y.tolist())
    short = np.flatnonzero(both & (np.maximum(m, n) <= 64))
    short = short[np.argsort(n[short], kind="stable")]
    for width in (1, 2, 4, 8, 16, 32, 64):
        near = short[(n[short] <= width) & (n[short] > width // 2)]
        for some in stretches(np.full(len(near), 64 * width), cells):
            rows = near[some]
            out[rows] = _short_distances(_padded(a, a0[rows], m[rows], -1), m[rows], _padded(b, b0[rows], n[rows], -2), n[rows])
    return out


def _long_bounds(ref: tuple[np.ndarray, np.ndarray], hyp: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What the edit distances of lists are at least and at most.

    At least what the longer one has more of than both have, place not counting.  At most what their pieces differ by, cut at the items that both
    have once and in the same order; a transcript that lost and changed some words of its reference reaches the first by these.
    """
    (a, m), (b, n) = ref, hyp
    low = min(a.min(initial=0), b.min(initial=0))
    k = int(max(a.max(initial=0), b.max(initial=0)) - low) + 1
    row = np.repeat(np.arange(len(m)), m)
    x, x_at, x_many = np.unique(row * k + (a - low), return_index=True, return_counts=True)
    y, y_at, y_many = np.unique(np.repeat(np.arange(len(n)), n) * k + (b - low), return_index=True, return_counts=True)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = np.maximum(m, n) - np.bincount(both // k, np.minimum(x_many[i], y_many[j]), len(m)).astype(np.int64)
    once = (x_many[i] == 1) & (y_many[j] == 1)
    x_at, y_at = x_at[i[once]], y_at[j[once]]
    order = np.argsort(x_at)
    x_at, y_at = x_at[order], y_at[order]
    # no earlier one lies behind it in the other list, and no later one before it
    kept = (np.maximum.accumulate(y_at) == y_at) & (np.minimum.accumulate(y_at[::-1])[::-1] == y_at) if len(y_at) else np.zeros(0, bool)
    x_at, y_at = x_at[kept], y_at[kept]
    of, rows = row[x_at], np.arange(len(m))
    # each piece ends at a cut, which is in none, or with its list
    last = np.searchsorted(of, rows, side="right")
    owner = np.insert(of, last, rows)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    pieces = []
    for at, sizes in ((x_at, m), (y_at, n)):
        ends = np.cumsum(sizes)
        stop = np.insert(at, last, ends)
        begin = np.append(0, stop[:-1] + 1)
        begin[first] = ends - sizes
        pieces.append((begin, stop - begin))
    (x0, p), (y0, q) = pieces
    inside = lambda codes, begin, size: codes[np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)]
    cut = np.bincount(owner, minlength=len(m)) > 1
    differ = np.maximum(p, q)
    some = (p > 0) & (q > 0) & cut[owner]
    differ[some] = coded_distances((inside(a, x0[some], p[some]), p[some]), (inside(b, y0[some], q[some]), q[some]))
    # a list without a cut is one piece, which tells nothing
    return least, np.bincount(owner, differ, len(m)).astype(np.int64)


def _short_distances(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Edit distances of rows of up to 64 items, each of m items of x and n of y, ordered by n."""
    wide = np.full((len(x), 64), -1, x.dtype)
    wide[:, : x.shape[1]] = x
    equal = np.packbits(wide[:, None, :] == y[:, :, None], axis=2, bitorder="little").view("<u8")[:, :, 0].T.copy()
    one = np.uint64(1)
    up, down = np.full(len(x), ~np.uint64(0)), np.zeros(len(x), np.uint64)
    at, score, out = (m - 1).astype(np.uint64), m.copy(), np.zeros(len(x), np.int64)
    begin = 0  # rows from here on have items left
    for j, eq in enumerate(equal):
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | ~(h | up), up & h
        score += ((more >> at) & one).astype(np.int64) - ((less >> at) & one).astype(np.int64)
        more, less = (more << one) | one, less << one
        up, down = less | ~(v | more), more & v
        stop = int(np.searchsorted(n, j + 1, side="right"))
        out[begin:stop] = score[begin:stop]
        begin = stop
    return out


def _alike(x: np.ndarray, y: np.ndarray) -> int:
    """How many items two lists begin with that are equal."""
    k = min(len(x), len(y))
    other = x[:k] != y[:k]
    return int(other.argmax()) if other.any() else k


def _without_ends(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two lists without what both begin and end with, which has no part in their distance."""
    start = _alike(x, y)
    x, y = x[start:], y[start:]
    end = _alike(x[::-1], y[::-1])
    return x[: len(x) - end], y[: len(y) - end]


def sided_distances(ref: tuple[np.ndarray, np.ndarray], hyp: tuple[np.ndarray, np.ndarray], marks: tuple[float, ...], leeway: float = 1e-5) -> np.ndarray:
    """Edit distances whose shares of the reference lie on the same side of each mark as the right ones do; right where bounds don't tell the side.

    Long lists are cut into as many pieces of 64 items at most: what the pieces differ by is never less than what the lists do, nor is that
    less than what their lengths differ by.
    """
    (a, m), (b, n) = ref, hyp
    out, long = np.zeros(len(m), np.int64), np.maximum(m, n) > 64
    for rows in (~long, long):
        x, y = (a[np.repeat(rows, m)], m[rows]), (b[np.repeat(rows, n)], n[rows])
        if rows is not long or not rows.any():
            out[rows] = coded_distances(x, y)
            continue
        k = -(-np.maximum(x[1], y[1]) // 64)
        row, place = np.repeat(np.arange(len(k)), k), np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        pieces = [(c, (place + 1) * s[row] // k[row] - place * s[row] // k[row]) for c, s in (x, y)]
        most = np.bincount(row, coded_distances(*pieces), len(k)).astype(np.int64)
        # lists of one length that differ have pieces that do
        least = np.maximum(np.abs(x[1] - y[1]), most > 0)
        share = np.maximum(x[1], 1)
        open_ = most > least
        open_ &= np.any([(most / share >= mark - leeway) & (least / share <= mark + leeway) for mark in marks], axis=0)
        if open_.any():
            most[open_] = coded_distances((x[0][np.repeat(open_, x[1])], x[1][open_]), (y[0][np.repeat(open_, y[1])], y[1][open_]))
        out[rows] = most
    return out


def _long_distance(x: list[int], y: list[int]) -> int:
    """The same for two lists of any length, by whole numbers of as many bits as there are items in the first."""
    if not x or not y:
        return len(x) + len(y)
    places: dict[int, list[int]] = {}
    for i, c in enumerate(x):
        places.setdefault(c, []).append(i)
    bits = {}
    for c in places.keys() & set(y):
        buffer = bytearray(len(x) // 8 + 1)
        for i in places[c]:
            buffer[i >> 3] |= 1 << (i & 7)
        bits[c] = int.from_bytes(buffer, "little")
    full, last, score = (1 << len(x)) - 1, len(x) - 1, len(x)
    up, down = full, 0
    for c in y:
        eq = bits.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = (down | ~(h | up)) & full, up & h
        score += (more >> last) - (less >> last & 1)
        more = (more << 1) | 1
        up, down = ((less << 1) | ~(v | more)) & full, more & v & full
    return score


def word_errors(ref: Column, hyp: Column, lower: bool = False, marks: tuple[float, ...] = ()) -> Column:
    """Edit distance between token arrays of any length; null counts as empty.  lower: whatever their case.

    With marks any number will do whose share of the reference lies on the same side of each of them.
    """

    @F.arrow_udf("int")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        out = sided_distances(*_coded(a, b, lower=lower), marks) if marks else _distances(a, b, lower)
        return pa.array(out.astype(np.int32))

    empty = F.array().cast("array<string>")
    return distance(F.coalesce(ref, empty), F.coalesce(hyp, empty))


def longest_copies(codes: np.ndarray, sizes: np.ndarray, widths: Iterable[int]) -> np.ndarray:
    """For each list the most items in three or more copies of a run of so many items that follow each other.

    Copies are found as they stand from the left, as many as there are, and what they take isn't looked at again.
    """
    out = np.zeros(len(sizes), np.int64)
    if not len(codes):
        return out
    # a gap ends each list: no long run of equals goes across one, as an item is never equal to it
    gaps = np.cumsum(sizes + 1) - 1
    wide = np.zeros(len(codes) + len(sizes), np.int16 if codes.dtype == np.uint8 else codes.dtype)
    inside = np.ones(len(wide), bool)
    inside[gaps] = False
    wide[inside], wide[gaps] = codes, -9
    for z in widths:
        if len(codes) <= z:
            break
        same = (wide[:-z] == wide[z:]) & inside[:-z]
        # whether any run is of 2 z or more, by runs twice as long each time
        run, k = same, 1
        while 2 * k <= 2 * z and len(run) > k:
            run, k = run[:-k] & run[k:], 2 * k
        if not run.any():
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= 2 * z
        taken = 0
        for s, e in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            s = max(s, taken)
            if e - s >= 2 * z:
                n = z * ((e - s) // z + 1)
                taken = s + n
                i = int(np.searchsorted(gaps, s))
                out[i] = max(out[i], n)
    return out


def error_rate(errors: Column, ref: Column, hyp: Column) -> Column:
    """Errors for each reference token to 3 digits; an empty reference scores 0 against nothing, else 1."""
    return F.when(F.size(ref) == 0, F.when(F.size(hyp) == 0, 0.0).otherwise(1.0)).otherwise(F.round(errors / F.size(ref), 3))


def word_error_rate(ref: Column, hyp: Column, lower: bool = False) -> Column:
    return error_rate(word_errors(ref, hyp, lower), ref, hyp)


def stretches(sizes: np.ndarray, most: int = 1_000_000) -> Iterator[slice]:
    """Rows in order, cut where the items before them fill another table of so many, so that tables over a batch's items stay bounded."""
    block = (np.cumsum(sizes) - sizes) // most
    edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(sizes)).tolist()
    for start, stop in zip(edges, edges[1:]):
        yield slice(start, stop)


def coverage(expected: Column, actual: Column) -> Column:
    """Share of the expected set that the actual one has, to 3 digits; 1 where nothing is expected."""
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.round(F.size(F.array_intersect(expected, actual)) / F.size(expected), 3))


def adjacent_repeat_ratio(words: Column) -> Column:
    """Tokens that equal the one before them, as a share of all."""
    n = F.size(words)
    same = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: (a == b).cast("int"))
    return F.when(n < 2, 0.0).otherwise(F.round(F.aggregate(same, F.lit(0), lambda acc, x: acc + x) / n, 3))


def repeated_ngram_score(words: Column, widths: range = range(2, 9), lower: bool = False) -> Column:
    """Largest share of tokens in three or more consecutive copies of a run of 2 to 8 tokens, to 3 digits; 0 for under 8 tokens."""

    @F.arrow_udf("int")
    def copied(lists: pa.Array) -> pa.Array:
        ((codes, sizes),) = _coded(lists, lower=lower)
        return pa.array(longest_copies(codes, sizes, widths).astype(np.int32))

    return repeat_share(copied(F.coalesce(words, F.array().cast("array<string>"))), words)


def repeat_share(copied: Column, words: Column) -> Column:
    n = F.size(words)
    return F.when(n < 8, 0.0).otherwise(F.round(copied / n, 3))


def latency_score(seconds: Column) -> Column:
    return F.when(seconds <= 1, 1.0).when(seconds <= 2, 0.85).when(seconds <= 4, 0.65).when(seconds <= 8, 0.35).otherwise(0.0)


def _around(p: float, n: Column) -> Column:
    """The place behind which the quantile of an open range lies, from 1 on."""
    return F.least(F.greatest(F.floor(F.lit(p) * (n + 1) + 1e-9), F.lit(1)), F.greatest(n - 1, F.lit(1)))


#: Places of quantiles among n sorted values, by definition; before and behind: those that the quantile of an open range lies between.
PLACES = {
    "before": lambda p, n: _around(p, n) - 1,
    "behind": lambda p, n: F.least(_around(p, n), n - 1),
    "half_even": lambda p, n: F.bround(F.lit(p) * (n - 1), 0),
    "floor": lambda p, n: F.floor(F.lit(p) * (n - 1)),
    "half_up": lambda p, n: F.floor(F.lit(p) * (n - 1) + 0.5),
}


def percentiles(rows: DataFrame, by: str, value: str, p: float, methods: tuple[str, ...], ranges: int = 64) -> DataFrame:
    """(by, a column for each method): the value of each group at the p-quantile's place among its sorted values; nulls don't count.

    Values are counted, counts summed by ranges that end at the group's approximate quantiles, and only the ranges that hold a
    wanted place are ranked, so that no task holds or sorts a group, however its values lie.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    cuts = F.percentile_approx("v", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10 * ranges)
    ends = counted.groupBy("g").agg(F.array_distinct(cuts).alias("cuts"), F.sum("c").alias("n"))
    below = F.size(F.filter("cuts", lambda c: c < F.col("v")))
    placed = counted.join(ends.withColumnRenamed("g", "g2"), F.col("g").eqNullSafe(F.col("g2"))).withColumn("r", below).select("g", "v", "c", "n", "r")
    sums = placed.groupBy("g", "n", "r").agg(F.sum("c").alias("s"))
    upto = Window.partitionBy("g").orderBy("r")  # at most a row for each range
    sums = sums.withColumn("before", F.sum("s").over(upto) - F.col("s"))
    wanted = F.array(*[PLACES[m](p, F.col("n")).cast("long") for m in methods])
    holding = sums.withColumn("wanted", wanted).filter(F.exists("wanted", lambda w: (w >= F.col("before")) & (w < F.col("before") + F.col("s"))))
    holding = holding.select(F.col("g").alias("g2"), F.col("r").alias("r2"), "before", "wanted")
    inner = placed.join(holding, F.col("g").eqNullSafe(F.col("g2")) & (F.col("r") == F.col("r2")))
    inner = inner.withColumn("first", F.col("before") + F.sum("c").over(Window.partitionBy("g", "r").orderBy("v")) - F.col("c"))
    at = lambda i: F.max(F.when((F.col("wanted")[i] >= F.col("first")) & (F.col("wanted")[i] < F.col("first") + F.col("c")), F.col("v")))
    return inner.groupBy(F.col("g").alias(by)).agg(*[at(i).alias(m) for i, m in enumerate(methods)])


def common_prefix(a: Column, b: Column) -> Column:
    """Leading words of b that equal those of a, whatever their case."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.lower(x) == F.lower(y))
    first_other = F.array_position(same, False)
    return F.slice(b, F.lit(1), F.when(first_other == 0, n).otherwise(first_other - 1).cast("int"))
