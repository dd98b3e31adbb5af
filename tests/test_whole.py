import re

from pyspark.sql import functions as F

from transcriptlab.plans import whole
from transcriptlab.plans.queries import QUERIES, SQL
from transcriptlab.sources import views


def fixture(spark, folder):
    """Texts that differ after token 40 only, and an edit, a repetition and a term beyond it."""
    head = " ".join(f"Word{i}" for i in range(60))
    texts = [f"{head} left", f"{head} right", f"{head} left", "", "short text " * 3, head + " tail" * 100, " ".join(f"t{i % 37}x{i}" for i in range(300))]
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return [re.findall(r"\w+", t) for t in texts]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def heard(words, doc, b):
    out = [None if (doc * 7 + i * 5 + b * 3) % (9 - 2 * b) == 0 else "zz" if (doc + i * 3 + b) % 11 == 0 else w for i, w in enumerate(words, 1)]
    return [w for w in out if w is not None]


def test_whole_texts(spark, tmp_path):
    folder = str(tmp_path)
    words = fixture(spark, folder)
    assert {r.doc_id for r in QUERIES["first_wins_text_whole"](spark, folder).collect()} == {0, 1, 3, 4, 5, 6}
    assert {r.id: r.copies for r in QUERIES["dedupe_by_trust_whole"](spark, folder).collect()} == {"clip_0": 2, "clip_1": 1, "clip_3": 1, "clip_4": 1, "clip_5": 1, "clip_6": 1}
    assert {r.doc_id for r in QUERIES["dup_suffix_whole"](spark, folder).collect() if "__dup" in r.text_id} == {2}
    rates = {}
    for doc, ref in enumerate(words):
        for b, name in views.BACKENDS:
            hyp = [w.lower() for w in heard(ref, doc, b)]
            rates.setdefault(name, []).append(round(distance([w.lower() for w in ref], hyp) / len(ref), 3) if ref else float(bool(hyp)))
    got = {r.backend: r.avg_wer for r in QUERIES["leaderboard_whole"](spark, folder).collect()}
    assert got.keys() == rates.keys() and all(abs(got[n] - sum(x) / len(x)) < 1e-3 for n, x in rates.items())
    with views.whole():
        last = {r.doc_id: r.n for r in views.drafts(spark, folder).groupBy("doc_id").agg(F.max(F.size("words")).alias("n")).collect()}
    assert last == {i: len(w) for i, w in enumerate(words)}


def test_whole_queries_are_all_of_those_over_texts(spark):
    assert all(f"{n}_whole" in whole.QUERIES for n in whole.OVER_TEXTS) and not set(whole.QUERIES) & set(SQL)
    assert views.MOST.get() == 40
