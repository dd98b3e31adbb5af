import time

import numpy as np

from transcriptlab.functions import columns as C
from transcriptlab.operators import selection


def lists(rng, n, most):
    sizes = rng.integers(0, most, n)
    return rng.integers(0, 4, sizes.sum()), sizes


def test_sides_are_those_of_the_right_distances():
    rng = np.random.default_rng(3)
    for most in (10, 100, 400):
        (a, m), (b, n) = lists(rng, 60, most), lists(rng, 60, most)
        right = C.coded_distances((a, m), (b, n))
        for marks in ((0.0005, 0.5005), (0.6,), (0.3, 0.7)):
            got = C.sided_distances((a, m), (b, n), marks)
            for mark in marks:
                assert ((got / np.maximum(m, 1) >= mark) == (right / np.maximum(m, 1) >= mark)).all()
            assert ((got == 0) == (right == 0)).all()


def test_long_texts_by_bounds(monkeypatch):
    """Long texts that are neither nearly equal nor half wrong don't go through the whole table."""
    n = np.array([20_000])
    x = np.arange(20_000)
    y = np.where(x % 11 == 0, -5, x)[x % 7 > 0]
    monkeypatch.setattr(C, "_long_distance", lambda *_: 1 / 0)
    got = C.sided_distances((x, n), (y, np.array([len(y)])), (0.0005, 0.5005))[0] / 20_000
    assert 0.0005 < got < 0.5005


def test_what_both_begin_and_end_with_goes_quickly():
    x = np.arange(300_000)
    y = np.append(x[:-1], -5)
    began = time.time()
    assert C.coded_distances((x, np.array([len(x)])), (y, np.array([len(y)])))[0] == 1
    assert C.coded_distances((x, np.array([len(x)])), (x, np.array([len(x)])))[0] == 0
    assert C.coded_distances((x, np.array([len(x)])), (x[:200_000], np.array([200_000])))[0] == 100_000
    assert time.time() - began < 0.5


def test_drafts_are_not_sorted_for_their_references(spark):
    drafts = spark.createDataFrame([(1, 1500, ["a", "b"]), (1, 3000, ["A", "x", "c"]), (2, 1500, [])], "doc_id long, t_ms long, words array<string>")
    clips = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, ["z"])], "doc_id long, toks array<string>")
    got = selection.prefix_quality(drafts.repartition("doc_id"), clips)
    assert "ShuffledHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1500, 2, 0.0), (3000, 1, 0.333)]


def test_fields_count_each_row_once(spark):
    rows = [("a b c d", "A b c d", None, "a a x y"), ("", "", "q", " ")]
    got = {r.field: r[1:] for r in selection.field_scorecard(spark.createDataFrame(rows, "gold string, f string, g string, h string"), ["f", "g", "h"]).collect()}
    assert got == {"f": (2, 1, 2, 0, 0), "g": (2, 1, 0, 2, 0), "h": (2, 1, 1, 1, 1)}
