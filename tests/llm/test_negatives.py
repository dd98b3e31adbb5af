import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from transcriptlab.llm import negatives

ROWS = "vec_id long, embedding array<double>, label long, rid long, q int, bucket string, size double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "b", 0.5) for i, v, label in rows], ROWS)


def same_as_sql(spark, rows, **sizes):
    df = table(spark, rows).repartition(3)
    con = duckdb.connect()
    con.register("given", df.select("vec_id", "embedding", "label").toArrow())
    con.execute("CREATE VIEW embeddings AS SELECT * FROM given")
    con.execute(negatives.OP13_SQL)
    want = sorted(con.fetchall())
    got = sorted(tuple(r) for r in negatives.hard_negatives(negatives.labelled(df), F.col("vec_id") % 100 == 0, **sizes).collect())
    assert got == want
    return got


@pytest.mark.parametrize("kind", ["even", "clusters", "lengths", "ties"])
def test_negatives_same_as_sql(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 12))
    if kind == "clusters":
        x = rng.normal(size=(20, 12))[rng.integers(0, 20, 700)] + 0.05 * x
    if kind == "lengths":
        x *= rng.lognormal(0, 1.5, (700, 1))
    if kind == "ties":
        x = np.round(x)
    ids = rng.permutation(700) * 4
    label = np.where(rng.random(700) < 0.4, 3, rng.integers(0, 10, 700))  # one label holds a large part
    rows = [(int(i), v.tolist(), int(y)) for i, v, y in zip(ids, x, label, strict=True)]
    assert len(same_as_sql(spark, rows, shard_rows=64, block_rows=3)) > 100


def test_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=6).tolist(), int(i % 3)) for i in range(150)]
    rows += [(None, [1.0] * 6, 1), (151, None, 1), (152, [], 1), (153, [1.0, None, 2.0, 3.0, 1.0, 1.0], 1), (154, [float("nan")] * 6, 1), (155, [float("inf")] + [0.0] * 5, 1), (156, [1.0] * 6, None)]
    rows += [(200, [0.0] * 6, 1), (300, [1.0, 2.0], 2), (301, [1.0, 1.0], 2), (302, [0.5, 0.9], 1), (400, [3.0], 1)]
    same_as_sql(spark, rows, shard_rows=40, block_rows=2)
    assert negatives.hard_negatives(negatives.labelled(table(spark, rows).limit(0)), F.col("vec_id") % 100 == 0).count() == 0


def test_negatives_of_repeated_ids(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i) // 2, rng.normal(size=5).tolist(), int(rng.integers(0, 2))) for i in range(240)]
    got = sorted(tuple(r) for r in negatives.hard_negatives(negatives.labelled(table(spark, rows)), F.col("vec_id") % 100 == 0, shard_rows=50).collect())
    kept = [(i, (y + 1) % 10 if i % 7 == 0 else y, np.floor(256 * np.array(v))) for i, v, y in rows]
    want = []
    for r, (i, y, v) in enumerate(kept):
        if i % 100:
            continue
        scored = [(int(v @ w), j, z) for s, (j, z, w) in enumerate(kept) if s != r]
        for p, j, _ in sorted((t for t in scored if t[2] == y), key=lambda t: (-t[0], t[1]))[:5]:
            fit = sorted((t for t in scored if t[2] != y and 30 * p <= 100 * t[0] <= 90 * p), key=lambda t: (-t[0], t[1]))[:10]
            want += [(i, j, n + 1, k, p, s) for n, (s, k, _) in enumerate(fit)]
    assert got == sorted(want)


def test_feasible_ranges_lose_nothing_and_prune():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(15, 8))[rng.integers(0, 15, 3000)] + 0.05 * rng.normal(size=(3000, 8))
    x = np.floor(256 * x / np.sqrt((x * x).sum(1, keepdims=True)))  # of like length, as in a bucket
    lists = negatives.coordinate_lists(np.arange(3000), np.arange(3000), np.zeros(3000, int), x)
    shares = []
    for q in x[:60]:
        scores = lists.x @ q
        for least in (np.quantile(scores, 0.5), np.quantile(scores, 0.99), scores.max(), scores.max() + 1, -5.0, 0.0):
            some = negatives.candidates(lists, q, float(least))
            assert set(np.flatnonzero(scores >= least)) <= set(some)
        shares.append(len(negatives.candidates(lists, q, float(np.quantile(scores, 0.99)))) / 3000)
    assert np.mean(shares) < 0.3
