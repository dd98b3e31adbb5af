import re
from collections import defaultdict
from difflib import SequenceMatcher

import duckdb
from pyspark.sql import functions as F

from transcriptlab.operators import consensus, review
from transcriptlab.plans.review import QUERIES, SQL, WEIGHTS
from transcriptlab.sources import views

DATA = "/root/testdata/sf0.001"


def alike(a, b):
    a, b = (re.sub("[^a-z0-9]+", " ", x.lower()).strip(" ") for x in (a, b))
    return SequenceMatcher(None, a, b).ratio()


def is_usable(text):
    words = re.findall("[a-z0-9']+", text.lower())
    looped = len(set(words)) <= 2 and len(words) >= 8
    return len(words) >= 2 and not looped and not set(re.findall("[a-z']+", text.lower())) & set(consensus.FOREIGN)


def heard(spark):
    by_clip = defaultdict(dict)
    for r in views.runs(spark, DATA).select("id", "backend", "actual", "error", "gold").collect():
        by_clip[r["id"]][r["backend"]] = r
    return by_clip


def test_draft_gold_against_brute_force(spark):
    got = {r["id"]: (r["name"], round(r["support"], 2)) for r in QUERIES["draft_gold"](spark, DATA).collect()}
    want = {}
    for clip, runs in heard(spark).items():
        spoken = [(n, runs[n]["actual"]) for n in WEIGHTS if runs[n]["error"] is None and runs[n]["actual"]]
        good = [(n, t) for n, t in spoken if is_usable(t)]
        best = (spoken[0][0], 0.0) if spoken else ("none", 0.0)
        scores = []
        for place, (n, t) in enumerate(good):
            limit = 0.94 if len(re.findall("[A-Za-z0-9']+", t)) <= 18 else 0.82
            support = round(sum(WEIGHTS[m] for m, u in good if alike(t, u) >= limit), 2)
            scores.append((support - (n == "accurate" and support <= WEIGHTS[n]), -place, n))
        if scores:
            support, _, n = max(scores)
            best = (n, round(support, 2))
        want[clip] = best
    assert got == want


def test_crosscheck_against_brute_force(spark):
    got = {r["id"]: r["status"] for r in QUERIES["crosscheck"](spark, DATA).collect()}
    want = {}
    for clip, runs in heard(spark).items():
        texts = [runs[n]["actual"] for n in ("accurate", "tiny") if runs[n]["error"] is None and runs[n]["actual"]]
        together = all(min(alike(a, b), alike(b, a)) >= 0.9 for a, b in zip(texts, texts[1:]))
        near = any(alike(t, runs["fast"]["gold"]) >= 0.9 for t in texts)
        want[clip] = "failed" if not texts else "confirmed" if together and near else "replaces" if together and len(texts) > 1 else "needs_human_review"
    assert got == want


def test_consensus_cases(spark):
    schema = "id string, name string, text string, error string"
    rows = [("a", "accurate", "we need the plan today", None), ("a", "tiny", "something else was said", None), ("a", "fast", "Something else was said!", None), ("b", "tiny", None, None), ("b", "fast", "", "timeout"), ("c", "new", "hm", None)]
    got = {r["id"]: (r["name"], r["text"]) for r in consensus.draft_gold(spark.createDataFrame(rows, schema), WEIGHTS, ("accurate",)).collect()}
    assert got == {"a": ("tiny", "something else was said"), "b": ("none", ""), "c": ("new", "hm")}
    assert consensus.draft_gold(spark.createDataFrame([], schema), WEIGHTS).count() == 0
    gold = spark.createDataFrame([("a", "x"), ("d", None)], "id string, gold string")
    got = {r["id"]: r["status"] for r in consensus.crosscheck(gold, spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": "needs_human_review", "d": "failed"}


def test_term_variants(spark):
    rows = [("The goals were met", ["goal", "mcp"]), ("call and coil", ["goal"]), (None, ["asr"]), ("asr is here", []), ("two stories", ["story", "stories", ""])]
    got = review.term_coverage(spark.createDataFrame(rows, "actual string, terms array<string>")).select("term_hits", "term_coverage").collect()
    assert [(list(r[0]), r[1]) for r in got] == [(["goal"], 0.5), ([], 0.0), ([], 0.0), ([], None), (["stories"], 0.333)]


def test_ordered_checks_without_words(spark, tmp_path):
    """A document without words has no first term, so its checks are unknown, as in SQL."""
    texts = ["", None, "...", "one", "a b c", "b before a"]
    spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(SQL["ordered_checks"]).fetchall()
    assert sorted(map(tuple, QUERIES["ordered_checks"](spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)
    assert sum(x[2] is None and x[3] is None for x in want) == 9
    rows = spark.createDataFrame([("b only", None, "a"), ("b only", None, "b"), (None, "a", None)], "actual string, first string, second string")
    got = rows.select(review.out_of_order(F.col("actual"), F.col("first"), F.col("second")), review.wrong_change(F.col("actual"), F.col("first"), F.col("second"))).collect()
    assert list(map(tuple, got)) == [(True, None), (None, None), (True, True)]


def test_quota_sample_cases(spark):
    rows = spark.range(100).withColumnRenamed("id", "doc_id")
    got = review.quota_sample(rows, [("low", F.col("doc_id") < 10, 3), ("even", F.col("doc_id") % 2 == 0, 2)], 6).collect()
    assert {(r["doc_id"], r["review_bucket"]) for r in got} >= {(0, "low"), (4, "low"), (9, "low"), (2, "even"), (98, "even")} and len(got) == 6
    assert review.quota_sample(rows.limit(0), [("low", F.lit(True), 3)], 6).count() == 0


def test_action_items_and_chunks(spark):
    docs = spark.createDataFrame([(1, "Well, you know, we need the share point. It rained."), (2, None), (3, "")], "doc_id long, text string")
    assert [r["prompt"] for r in review.action_items(docs).orderBy("doc_id").collect()] == ["Well, we need the SharePoint.", "", ""]
    levels = spark.createDataFrame([(1, [1.0] * 25), (2, []), (3, None), (4, [1.0] * 8 + [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["first"], r["length"]) for r in review.close_chunks(levels).orderBy("vec_id", "chunk").collect()]
    assert got == [(1, 0, 20), (1, 20, 5), (4, 0, 9), (4, 9, 1)]
