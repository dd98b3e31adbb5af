import re

import numpy as np
from pyspark.sql import functions as F

from transcriptlab.functions import columns as C
from transcriptlab.functions import meaning as M
from transcriptlab.operators import review, scoring
from transcriptlab.sources import io


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_word_error_rate(spark):
    words = lambda s: F.array(*map(F.lit, s.split())) if s else F.array().cast("array<string>")
    assert value(spark, C.word_error_rate(words("a b c d"), words("a x c"))) == 0.5
    assert value(spark, C.word_error_rate(words(""), words("a"))) == 1.0
    assert value(spark, C.word_error_rate(words(""), words(""))) == 0.0
    assert value(spark, C.word_error_rate(words("a"), words("b c d"))) == 3.0


def test_repeats(spark):
    words = F.array(*map(F.lit, "x a b a b a b y z w".split()))
    assert value(spark, C.repeated_ngram_score(words)) == 0.6
    assert value(spark, C.repeated_ngram_score(F.array(F.lit("a"), F.lit("a")))) == 0.0
    assert value(spark, C.adjacent_repeat_ratio(F.array(*map(F.lit, "a a b b".split())))) == 0.5


def test_percentiles(spark):
    rng = np.random.default_rng(0)
    groups = {"a": list(range(1, 7)), "b": rng.normal(0, 5, 999).round(2).tolist(), "c": [3.0] * 50, None: [1.0, 9.0], "d": [*rng.integers(0, 3, 400).tolist(), 1e9]}
    rows = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("e", None)], "g string, v double")
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r.g: (r.half_even, r.floor, r.half_up) for r in C.percentiles(rows, "g", "v", p, ("half_even", "floor", "half_up"), ranges=16).collect()}
        at = lambda v: (round(p * (len(v) - 1)), int(p * (len(v) - 1)), int(p * (len(v) - 1) + 0.5))  # noqa: E731, B023
        assert got == {g: tuple(sorted(v)[i] for i in at(v)) for g, v in groups.items()}


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_word_errors_of_texts_of_any_length(spark):
    rng = np.random.default_rng(1)
    pairs = []
    for n in [0, 0, 1, 1, 5, 5, 40, 40, 300, 2000]:
        a = [f"w{x}" for x in rng.integers(0, 9, n)]
        b = [w for w in a if rng.random() > 0.2] + [f"w{x}" for x in rng.integers(0, 9, int(rng.integers(0, 5)))]
        pairs += [(a, b), (b, a), (a, a)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)] + [(99, None, ["x"])], "i int, a array<string>, b array<string>")
    got = {r.i: r.d for r in rows.select("i", C.word_errors(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {**{i: brute_distance(a, b) for i, (a, b) in enumerate(pairs)}, 99: 1}
    # more different words than any code page has
    many = [f"m{i}" for i in range(70_000)]
    far = spark.createDataFrame([(many[:300], many[69_000:69_200])], "a array<string>, b array<string>")
    assert far.select(C.word_errors(F.col("a"), F.col("b")).alias("d")).first().d == 300


def test_longest_copies_as_by_regular_expressions():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab"), n)) + "abc" * int(c) + "x" for n, c in zip(rng.integers(0, 40, 200), rng.integers(0, 6, 200), strict=True)]
    sizes, codes = np.array([len(t) for t in texts]), np.frombuffer("".join(texts).encode(), np.uint8)
    want = [max((len(m[0]) for z in range(3, 16) for m in re.finditer(rf"([a-z]{{{z}}})\1{{2,}}", t)), default=0) for t in texts]
    assert C.longest_copies(codes, sizes, range(3, 16)).tolist() == want


def test_concepts_terms_and_critical_errors(spark):
    words = lambda s: F.array(*map(F.lit, s.split())) if s else F.array().cast("array<string>")
    assert set(value(spark, M.concepts(words("samajhiye zero to one because jaldi solved something aage")))) == {"understand", "zero_to_one", "fast", "solve", "move_forward", "samajhiye", "solved", "something"}
    assert value(spark, M.concepts(words(""))) == []
    assert value(spark, M.expected_terms(F.lit("We built the API with Claude-3 and C++ about my PRD api"))) == ["built", "api", "claude 3", "c++", "prd"]
    assert value(spark, M.expected_terms(F.lit("ignored text"), F.lit("Foo Bar; foo bar,\n Baz!"))) == ["foo bar", "baz"]
    rows = spark.createDataFrame([(["chatgpt", "task", "mat", "policies", "हिंदी", "gone"], "Chat GPT has tasks; don't say policy हिंदी")], "terms array<string>, actual string")
    got = review.term_coverage(rows).first()
    assert got.term_misses == ["gone"] and got.term_coverage == round(5 / 6, 3)
    assert value(spark, M.language_preservation(F.lit("नमस्ते 中"), F.lit("ok 中"))) == 0.5 and value(spark, M.language_preservation(F.lit("a"), F.lit("b"))) == 1.0
    critical = lambda *a, **k: value(spark, M.critical_error(*a, **k))
    assert critical(F.lit(" [BLANK_AUDIO] ")) and critical(F.lit("ASR failure detected: x")) and critical(F.lit("ok"), F.lit("minor; number_error")) and not critical(F.lit("ok"), F.lit("minor"))
    assert critical(F.lit("ok"), marks=(F.lit("Yes"),)) and critical(F.lit("ok"), marks=(F.lit(2),)) and not critical(F.lit("ok"), marks=(F.lit("no"), F.lit(None).cast("string"), F.lit(False)))
    assert critical(F.lit("ok"), errors=(F.array(F.lit(" "), F.lit("x")),)) and not critical(F.lit("ok"), errors=(F.array(F.lit(" ")), F.lit(None).cast("array<string>")))


def test_score_runs(spark):
    """The cap, the verbatim penalty and the term part, by hand."""
    rows = spark.createDataFrame([(1, "build the नमस्ते report quickly", "build the report quickly", 0.5, None, "hinglish", None), (2, "build the report", "build the report", 0.5, None, "en", "wrong_action")], "i int, gold string, actual string, seconds double, error string, category string, quality_flags string")
    by = {m: {r.i: r for r in scoring.score_runs(rows, m).collect()} for m in ("meaning", "verbatim")}
    assert by["meaning"][2].useful_score == 0.5 and not by["meaning"][2].usable and by["meaning"][2].critical
    full = by["meaning"][1]
    assert full.usable and full.language_score == 0.0 and full.term_coverage == 1.0
    assert abs(by["verbatim"][1].useful_score - 0.65 * full.useful_score) < 2e-3 and by["verbatim"][2].useful_score == 0.5


def test_readers(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"run_id": "1", "status": "failed"}\nnot json\n{"run_id": "2"}\n')
    assert sorted(r.run_id for r in io.read_attempts(spark, str(path)).collect()) == ["1", "2"]


def test_upsert(spark):
    schema = "id string, gold string, benchmarks map<string,string>"
    base = spark.createDataFrame([("a", "old", {"x": "1", "y": "2"}), ("b", "kept", None)], schema)
    delta = spark.createDataFrame([("a", None, {"y": "3"}), ("c", "new", None)], schema)
    got = {r.id: (r.gold, r.benchmarks) for r in io.upsert_clips(base, delta).collect()}
    assert got == {"a": ("old", {"x": "1", "y": "3"}), "b": ("kept", {}), "c": ("new", {})}


def test_dictionary(spark):
    words = spark.createDataFrame([("MCP", ["mcp", "em see pee"])], "canonical string, aliases array<string>")
    memory = spark.createDataFrame([("Mcp", ["mcp"], True, "approved"), ("Z", ["z"], False, "auto")], "canonical string, aliases array<string>, enabled boolean, status string")
    assert {r.alias: r.canonical for r in io.load_dictionary(words, memory).collect()} == {"mcp": "Mcp", "em see pee": "MCP"}
