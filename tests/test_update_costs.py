from pyspark.sql import functions as F

from transcriptlab.functions import texts as X


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_only_made_where_first_words_are_equal(spark):
    rows = spark.createDataFrame([("a b c a b c a b c".split(),), ("a b c a b c a b x".split(),), ([None, None, None],), ([],)], "w array<string>")
    got = rows.select(X.runaway(F.col("w")).alias("x"))
    assert " <=> " in plan(got)
    assert [r.x for r in got.collect()] == [True, False, True, False]


def test_terms_begin_with_capitals(spark):
    rows = spark.createDataFrame([("ABC aBC x9 G4s's GPUs 'API iPhone DataFrame Zürich Data Ab_C A 9A",)], "t string").repartition(1)
    got = rows.select(X.protected_terms(F.col("t")))
    assert ">= A)" in plan(got)
    assert got.first()[0] == ["abc", "dataframe", "g4", "gpu"]
