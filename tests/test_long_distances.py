import numpy as np

from transcriptlab.functions import columns as C
from transcriptlab.operators import selection


def heard(rng, a, v):
    """What a transcript has of its reference: some items lost, some replaced."""
    b = a[rng.random(len(a)) > 0.15].copy()
    b[rng.random(len(b)) < 0.1] = v
    return b


def joined(lists):
    return np.concatenate(lists), np.array([len(x) for x in lists])


def test_same_as_whole_tables():
    rng = np.random.default_rng(1)
    for _ in range(60):
        some = []
        for _ in range(6):
            v = rng.choice([4, 60, 1000, 5000])
            a = rng.integers(-3, v, rng.integers(0, 400))
            other = (heard(rng, a, v), rng.integers(-3, v, rng.integers(0, 400)), np.roll(a, len(a) // 2), a[::-1].copy())
            some.append((a, other[rng.integers(4)]))
        want = [C._long_distance(x.tolist(), y.tolist()) for x, y in some]
        assert C.coded_distances(joined([x for x, _ in some]), joined([y for _, y in some])).tolist() == want


def test_long_transcripts_need_no_whole_table(monkeypatch):
    rng = np.random.default_rng(2)
    a = [rng.integers(0, 20_000, 20_000), rng.integers(0, 3_000, 3_000)]
    b = [heard(rng, x, 30_000) for x in a]
    want = [C._long_distance(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]
    most, whole = [0], C._long_distance

    def seen(x, y):
        most[0] = max(most[0], len(x))
        return whole(x, y)

    monkeypatch.setattr(C, "_long_distance", seen)
    assert C.coded_distances(joined(a), joined(b)).tolist() == want
    assert most[0] < 300


def test_quick_policy_scores_no_slow_candidates(spark):
    schema = "id string, backend string, useful_score double, seconds double, actual string, error string"
    rows = [("a", "fast", 0.5, 1.0, "x", None), ("a", "slow", 0.9, 2.6, "x", None), ("a", "ok", 0.6, 2.5, "x", None), ("b", "fast", 0.5, 1.0, "x", None), ("b", "slow", 0.9, 9.0, "x", None), ("b", "odd", 0.9, None, "x", None)]
    df = spark.createDataFrame(rows, schema)
    first, others = df.filter("backend = 'fast'"), df.filter("backend <> 'fast'")
    got = selection.two_phase(first, others, "oracle-under-limit")
    assert sorted(map(tuple, got.collect())) == [("a", 0.5, 0.6, 2.5, "ok"), ("b", 0.5, 0.5, 1.0, "none")]
    assert "<= 2.5" in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
