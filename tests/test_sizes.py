"""Steps whose work grows with the input alone, on texts that are long enough to tell."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from transcriptlab.functions import columns as C
from transcriptlab.functions import meaning as M
from transcriptlab.functions import texts as X
from transcriptlab.operators import review


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_distances_around_a_word_of_bits():
    r = random.Random(5)
    sizes = [0, 1, 2, 7, 40, 63, 64, 65, 66, 130]
    a = [[r.choice("abcD") for _ in range(r.choice(sizes))] for _ in range(150)]
    b = [[r.choice("abcd") for _ in range(r.choice(sizes))] for _ in range(150)]
    assert C._distances(pa.array(a), pa.array(b)).tolist() == [brute(x, y) for x, y in zip(a, b)]
    low = [[w.lower() for w in x] for x in a]
    assert C._distances(pa.array(a), pa.array(b), lower=True).tolist() == [brute(x, y) for x, y in zip(low, b)]


def test_terms_of_a_long_text_are_looked_up_not_searched_for(spark):
    words = [f"word{i}" for i in range(20_000)]
    text = " ".join(w for i, w in enumerate(words) if i % 4)
    rows = spark.createDataFrame([(text, [*words, "word1 word2", "word2 word1", "word5 word6 word7"])], "actual string, terms array<string>")
    began = time.time()
    got = review.term_coverage(rows).first()
    assert len(got.term_hits) == 15_002 and got.term_misses[-1] == "word2 word1" and time.time() - began < 30


def test_concepts_of_several_arrays(spark):
    rows = spark.createDataFrame([(1, [["Zero", "to", "ONE"], ["understand", "Samajhna", "lengthy"], [], ["other"]], ["zero", "to", "one", "SAMAJH", "x"]), (2, [["a"]], None), (3, None, ["a"])], "i int, facts array<array<string>>, said array<string>")
    got = {r.i: r.x for r in rows.select("i", M.concept_coverage("facts", "said").alias("x")).collect()}
    assert got == {1: [1.0, 0.5, 1.0, 0.0], 2: None, 3: None}


def test_runaway_of_many_long_texts(spark):
    """Each block is compared with the next by numbers, once for each width, however long the text is."""
    ask = lambda t: [w for w in t.split(" ") if w]
    texts = {"": False, "a a": False, "a a a": True, "x a b a b a b": True, "a b a b a c": False, "a b c a b c a b c": True, "a b c d e " * 3: False, "a b c d " * 3: True, "a a b b a a b b": False}
    rows = spark.createDataFrame([(t, ask(t)) for t in texts] + [(None, None)], "t string, w array<string>")
    assert {r.t: r.x for r in rows.select("t", X.looped(F.col("w")).alias("x")).collect()} == texts | {None: False}
    long = spark.range(200).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("w"), i % 5003)).alias("w"))
    long.cache().count()
    began = time.time()
    assert long.filter(X.looped(F.col("w"))).count() == 0 and time.time() - began < 15
