from transcriptlab.operators import reports


def test_variants_are_counted_by_one_function(spark):
    """Each Arrow function of a plan has Python workers of its own, each with its own vocabulary."""
    pairs = [("a", [("primary", "Foo bars to baz"), ("half", "foo bar")]), ("b", [("primary", ""), ("half", " ")]), ("c", [("primary", None), ("half", "चैटजीपीटी API")])]
    variants = spark.createDataFrame(pairs, "id string, gold_variants array<struct<source: string, text: string>>")
    runs = spark.createDataFrame([("a", "x", "foo bar"), ("a", "y", None), ("b", "x", "zz"), ("c", "x", "api chatgpt")], "id string, backend string, actual string")
    got = reports.variant_scores(runs, variants)
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    rows = {r[:2]: r[2:] for r in map(tuple, got.collect())}
    assert rows[("a", "x")] == ("half", 1.0, 1.0, 0.0)
    assert rows[("b", "x")] == ("primary", 0.0, 0.0, 1.0)
    assert set(rows) == {("a", "x"), ("a", "y"), ("b", "x"), ("c", "x")}
