from pyspark.sql import functions as F

from transcriptlab.operators import mining

# Worked examples: a line, and the pair that it teaches.
LINES = {
    "Skill not skid please": ("skid", "skill"),
    "I said score, not school, please.": ("school", "score"),
    "Codex not codecs": ("codecs", "Codex"),
    "It's STT bro, not STD": ("STD", "STT"),
    "Search for exotic sites where I can find, not exotic sites platforms": None,
    "we should not go": None,
    "the not a": None,
    "same not SAME": None,
    "": None,
    None: None,
}


def test_worked_corrections(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "n int, line string")
    got = {r["n"]: (r["wrong"], r["right"]) for r in mining.correction_pairs(rows, {"codex": "Codex"}).collect()}
    assert got == {i: p for i, p in enumerate(LINES.values()) if p}


def test_learnt_with_context(spark):
    turns = [(1, 0, "please open the new school page for me now"), (1, 1, "score not school"), (1, 2, "table not school"), (2, 0, "table not chair"), (3, 0, None), (3, 1, "API not a pie")]
    got = {tuple(r) for r in mining.learn_pairs(spark.createDataFrame(turns, "conv_id long, turn long, line string")).collect()}
    context = ("the new school page for me", "the new {} page for me")
    assert got == {(1, 1, context[0], context[1].format("score")), (1, 2, context[0], context[1].format("table")), (3, 1, "a pie", "API")}
    assert mining.learn_pairs(spark.createDataFrame([], "conv_id long, turn long, line string")).count() == 0


def test_positions(spark):
    a = spark.createDataFrame([(1, 5), (1, 2), (2, 1)], "g int, o int")
    assert {tuple(r) for r in mining.positional_join(a, a.filter("g = 1").limit(1), "g", "o").collect()} in ({(1, 1, 2, 5), (1, 2, 5, -1), (2, 1, 1, -1)}, {(1, 1, 2, 2), (1, 2, 5, -1), (2, 1, 1, -1)})


def brute_anchor(d, t):
    best = None
    for i in range(len(t)):
        for e in range(i + 4, min(len(t), i + 9) + 1):
            for j in range(max(0, len(d) - 30), len(d) - (e - i) + 1):
                if d[j : j + e - i] == t[i:e]:
                    best = max(best or (0, 0, 0), (e - i, j + 1, e))
    return best


def test_anchor_against_brute_force(spark):
    cases = [("a b c d e f g", "c d e f g h i j k"), ("a b a b a b a b", "a b a b x"), ("a b c", "a b c"), ("", "a b c d"), ("x " * 40 + "a b c d", "a b c d " * 3), ("a b c d " + "x " * 31, "a b c d e")]
    words = [(n, d.split(), t.split()) for n, (d, t) in enumerate(cases)]
    rows = spark.createDataFrame(words, "n int, d array<string>, t array<string>").select("n", mining.tail_anchor(F.col("d"), F.col("t")).alias("a"))
    assert {r["n"]: tuple(r["a"]) if r["a"] else None for r in rows.collect()} == {n: brute_anchor(d, t) for n, d, t in words}
