import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from transcriptlab.operators import corpus


@pytest.mark.parametrize("ranges", [256, 3])
def test_places_of_hot_and_odd_groups(spark, ranges):
    """Places are those of a sort, in a group with half of all rows, of null keys, and with one number far from all others."""
    rng = np.random.default_rng(1)
    ids = [*map(int, rng.permutation(4000)), 10**15, -(10**12)]
    rows = [("hot" if rng.random() < 0.5 else None if rng.random() < 0.1 else f"k{rng.integers(0, 300)}", i) for i in ids]
    df = spark.createDataFrame(rows, "k string, i long").repartition(5)
    got = {(r.k, r.i): (r.place, r.n) for r in corpus.placed(df, "k", "i", ranges).collect()}
    groups = defaultdict(list)
    for k, i in rows:
        groups[k].append(i)
    assert got == {(k, i): (p, len(own)) for k, own in groups.items() for p, i in enumerate(sorted(own))}


def test_no_window_sorts_a_whole_text_or_source(spark):
    clips = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("same").alias("gold"), F.lit("one").alias("source"))
    for df in (corpus.number_repeats(clips), corpus.even_sample(clips, 3)):
        windows = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*)", df._jdf.queryExecution().optimizedPlan().toString())
        assert windows and all("_range" in w for w in windows)
    assert sorted(r.doc_id for r in corpus.even_sample(clips, 3).collect()) == [0, 50, 99]


@pytest.mark.parametrize("held", [2_000_000, 1])
def test_best_match_of_few_and_many_prompts(spark, monkeypatch, held):
    """Scored in the row or by a join: the same prompts; ties, empty texts and prompts, texts that share nothing."""
    monkeypatch.setattr(corpus, "HELD", held)
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(40)]
    text = lambda most: " ".join(rng.choice(words, rng.integers(0, most)))
    texts = spark.createDataFrame([(i, text(50)) for i in range(200)] + [(900, None), (901, "none here"), (902, "abc de")], "doc_id long, text string").repartition(3)
    prompts = spark.createDataFrame([(i * 3, text(36)) for i in range(60)] + [(7, "word1 word2"), (8, "word1 word2"), (500, ""), (501, None)], "item_id long, text string")
    for least in (0.0, 0.6):
        few = sorted(tuple(r) for r in corpus.best_match(texts, prompts, least).collect())
        assert few == sorted(tuple(r) for r in corpus.best_match(texts, prompts, least, most_prompts=3).collect())
        assert 100 < len(few) <= 200
