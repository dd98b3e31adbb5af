import numpy as np
from pyspark.sql import functions as F

from transcriptlab.functions import columns as C
from transcriptlab.functions import texts as X


def slow(items, widths):
    best = 0
    for z in widths:
        i = 0
        while i + 3 * z <= len(items):
            n = 1
            while items[i + n * z : i + (n + 1) * z] == items[i : i + z] and len(items) >= i + (n + 1) * z:
                n += 1
            if n >= 3:
                best = max(best, n * z)
                i += n * z
            else:
                i += 1
    return best


def test_copies_are_those_found_one_by_one():
    """Also across neighbours that would go on in one another, and in lists without items."""
    rng = np.random.default_rng(5)
    for kind in (np.uint8, np.int64):
        sizes = rng.integers(0, 30, 400)
        codes = rng.integers(0, 2, sizes.sum()).astype(kind)
        ends = np.cumsum(sizes)
        for widths in (range(2, 9), range(3, 16), (1, 2, 3, 4)):
            got = C.longest_copies(codes, sizes, widths)
            assert got.tolist() == [slow(codes[e - n : e].tolist(), widths) for e, n in zip(ends, sizes)]


def test_a_text_goes_through_expressions_once(spark):
    """Tokens and letters of a text are made once for its score, not again for each share."""
    rows = spark.createDataFrame([("İKa ba ba ba ba ba ba ba",), (None,), (" \n",), ("abc" * 9,), ("x y",)], "t string").repartition(2)
    got = rows.select("t", X.repeated_substring_score(F.col("t")).alias("s"), X.degenerate(F.col("t")).alias("d"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    found = {r.t: (r.s, r.d) for r in got.collect()}
    assert found[None] == (0.0, True) and found[" \n"] == (0.0, True) and found["abc" * 9] == (1.0, True) and found["x y"] == (0.0, False)
    assert found["İKa ba ba ba ba ba ba ba"][1]
