import time
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from transcriptlab.functions import alignment


def pairs(seed, n=150, letters="ab cdé"):
    rng = np.random.default_rng(seed)
    out = [("", ""), ("", "a"), ("abc", "abc"), ("abab" * 9, "baba" * 9), ("a" * 60, "a" * 7)]
    for _ in range(n):
        a = "".join(rng.choice(list(letters), rng.integers(0, 40)))
        b = list(a)
        for _ in range(rng.integers(0, 12)):
            b.insert(int(rng.integers(0, len(b) + 1)), str(rng.choice(list(letters))))
        out.append((a, "".join(b)[int(rng.integers(0, 4)) :] if rng.random() < 0.7 else "".join(rng.choice(list(letters), 30))))
    return out


@pytest.mark.parametrize(("seed", "cells"), [(1, alignment.CELLS), (2, 50), (3, 1)])
def test_blocks_same_as_an_aligner_one_by_one(seed, cells):
    rows = pairs(seed)
    coded = [(np.array([ord(c) for t in side for c in t], np.int64), np.array([len(t) for t in side], np.int64)) for side in zip(*rows, strict=True)]
    got = [[] for _ in rows]
    for row, *block in zip(*(v.tolist() for v in alignment.matching_blocks(*coded, cells)), strict=True):
        got[row].append(tuple(block))
    assert got == [[tuple(b) for b in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if b.size] for a, b in rows]


@pytest.mark.parametrize(("seed", "cells"), [(5, alignment.CELLS), (6, 300)])
def test_frequent_items_of_long_sequences_begin_no_block(seed, cells):
    rng = np.random.default_rng(seed)
    rows = [(a * 8, b * 7 + "qxz") for a, b in pairs(seed, 40)] + pairs(seed, 20)
    rows += [("".join(rng.choice([chr(200 + i) for i in range(150)], 260)), "".join(rng.choice([chr(200 + i) for i in range(150)], 260))) for _ in range(20)]
    coded = [(np.array([ord(c) for t in side for c in t], np.int64), np.array([len(t) for t in side], np.int64)) for side in zip(*rows, strict=True)]
    got = [[] for _ in rows]
    for row, *block in zip(*(v.tolist() for v in alignment.matching_blocks(*coded, cells, frequent=False)), strict=True):
        got[row].append(tuple(block))
    assert got == [[tuple(b) for b in SequenceMatcher(None, a, b).get_matching_blocks() if b.size] for a, b in rows]


def test_likeness_and_blocks_of_columns(spark):
    rows = [*pairs(4), (None, "ab"), (None, None), ("x" * 3000 + "y", "x" * 2999 + "zy")]
    df = spark.createDataFrame(rows, "a string, b string").repartition(3)
    got = df.select("*", alignment.likeness(F.col("a"), F.col("b")).alias("s"), alignment.common_blocks(F.split("a", " "), F.split("b", " ")).alias("blocks")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.s == pytest.approx(SequenceMatcher(None, r.a or "", r.b or "").ratio())
        x, y = ([] if t is None else t.split(" ") for t in (r.a, r.b))
        assert [tuple(b) for b in r.blocks] == [tuple(b) for b in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() if b.size]


@pytest.mark.parametrize("seed", range(6))
def test_letters_of_long_texts_without_a_table(spark, seed):
    """Long texts go by their rare letters, short ones by the table; both as one by one, and a bound leaves out no pair."""
    rng = np.random.default_rng(seed)
    said = [str(w) for w in rng.choice(["the", "plan", "zebra", "we need", "quiz", "10", "and so", "jump"], 4000 if seed == 5 else 60)]
    rows = []
    for lost in (0.0, 0.05, 0.2, 0.9):
        heard = [w for w in said if rng.random() >= lost]
        rows += [(" ".join(said), " ".join(heard)), (" ".join(heard), " ".join(said)), (" ".join(heard[:20]), " ".join(said[:20])), ("", " ".join(heard))]
    began = time.perf_counter()
    got = spark.createDataFrame(rows, "a string, b string").coalesce(1).select("a", "b", alignment.likeness(F.col("a"), F.col("b")).alias("s"), alignment.alike(F.col("a"), F.col("b"), F.lit(0.9)).alias("is")).collect()
    assert time.perf_counter() - began < 20
    want = [SequenceMatcher(None, r.a, r.b).ratio() for r in got] if seed < 5 else [r.s for r in got]
    assert [r.s for r in got] == pytest.approx(want) and [r["is"] for r in got] == [s >= 0.9 for s in want]
