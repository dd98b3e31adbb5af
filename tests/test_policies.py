import re

import pytest
from pyspark.sql import functions as F

from transcriptlab.functions import newwords as N
from transcriptlab.functions import policies as P
from transcriptlab.sources import views

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("chunk", "language", "probability", "reason"),
    [
        (0, "hi", 0.95, "language:hi"), (3, "ur", None, "language:ur"), (1, "en", 0.49, "english_low_confidence"), (0, "en", 0.79, "english_early_low_confidence"), (1, "en", 0.79, None),
        (2, "fr", 0.2, "non_english_low_confidence:fr"), (0, "fr", 0.7, None), (0, "en", None, None), (0, None, 0.1, None), (0, "", 0.1, None), (None, "en", 0.6, None),
    ],
)
def test_detector(spark, chunk, language, probability, reason):
    df = spark.createDataFrame([(chunk, language, probability)], "c int, l string, p double")
    assert df.select(P.detector_reason(F.col("c"), F.col("l"), F.col("p"), 0.50, 0.80)).first()[0] == reason
    if reason == "english_early_low_confidence":
        assert df.select(P.detector_reason(F.col("c"), F.col("l"), F.col("p"), 0.50)).first()[0] is None


def plain(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def thrice(w):
    return any(w[i : i + z] == w[i + z : i + 2 * z] == w[i + 2 * z : i + 3 * z] for z in range(1, 5) for i in range(len(w) - 3 * z + 1))


def one_policy(a, b):
    a, b = (a or "").strip(), (b or "").strip()
    d, f = plain(a), plain(b)
    fits = not (len(d) >= 6 and (len(f) < max(3, len(d) // 3) or len(f) > max(len(d) + 45, int(len(d) * 2.4)))) and not (len(a) >= 40 and len(b) < len(a) // 3)
    there = bool(a and b and a != b and "�" not in b and not thrice(f) and fits)
    indic = bool(re.search("[ऀ-ॿ]", b))
    bare = [w for w in f if w not in P.STYLE]
    style = len(d) >= 4 and len(bare) >= 4 and bare == d
    english = lambda w: [x for x in w if re.fullmatch("[a-z]{4,}", x)]
    flags = [(x, x not in english(d) and x not in (*P.COMMON, *P.ROMAN)) for x in english(f)]
    phrase = any(x[1] and y[1] for x, y in zip(flags, flags[1:], strict=False)) or len({x for x, n in flags if n}) >= 2
    hits = len({w for w in f if w in P.SUBSTANCE})
    long = {w for w in d if len(w) >= 3}
    kept = len(long & {w for w in f if len(w) >= 3}) / len(long) if long else 1.0
    signal = indic or any(re.search(rf"\b{s}\b", b.lower()) for s in P.SIGNALS)
    return there and signal and not style and not phrase, there, there and (indic or hits >= 2) and not style and kept >= (0.35 if hits >= 4 else 0.55)


def one_audit(r, safe, route):
    text = r.candidate if safe else r.draft
    content = lambda t: {w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) >= 4 and w not in P.CONTENT_STOP}

    def named(t):
        raw = [m.split("'")[0] for m in re.findall(r"\b[A-Za-z][A-Za-z0-9]*(?:'[A-Za-z]+)?\b", t)]
        return {w.lower() for w in raw if (w.isupper() and len(w) >= 2) or (len(w) >= 4 and w[0].isupper() and any(c.isupper() for c in w[1:]))}

    d, f = content(r.draft), content(text)
    kept, new = len(d & f) / len(d) if d else 1.0, f - d
    out = ("needs_review", "low")
    if not safe:
        out = ("keep_fast", "high" if route in P.SURE_ROUTES else "medium")
    elif not named(r.draft) <= named(text):
        out = ("reject_drop", "high")
    elif kept < 0.78:
        out = ("replace_candidate", "medium") if kept >= 0.65 and len(r.value) >= 5 else ("reject_drop", "medium")
    elif not new and kept >= 0.95:
        out = ("save_alternate", "high")
    elif len(new) <= 2 and kept >= 0.90 and all(w in P.CONTENT_STOP or len(w) <= 4 for w in new):
        out = ("save_alternate", "medium")
    elif kept >= 0.82:
        out = ("replace_candidate", "medium")
    return (*out, round(kept, 3), len(new), len(d - f))


def test_policies_and_audit_same_as_one_by_one(spark):
    rows = views.second_decodings(spark, DATA)
    more = [(-1, "one two three four five six seven", "one", "", 0.1), (-2, None, "x", "", 0.1), (-3, "x" * 50, "y", "", 0.1), (-4, "we go on now", "we go on now yaar", "", 0.1), (-5, "a b", "aap ka kaam", "", 0.1), (-6, "one two three four five six", "ab " * 60, "", 0.1), (-7, "API and DataFrame's x", "api dataframe x", "", 0.1), (-8, "good day", "good day", "", 0.1)]
    rows = rows.unionByName(spark.createDataFrame(more, rows.schema)).withColumn("safe", F.col("id") % 5 != 0).withColumn("route", F.when(F.col("id") % 2 == 0, P.SURE_ROUTES[0]))
    d, c = F.col("draft"), F.col("candidate")
    got = rows.select("*", P.update_policies(d, c).alias("p"), P.replacement_audit(d, c, F.col("safe"), F.col("route")).alias("a"), N.new_roman(d, c).alias("value")).collect()
    decisions, allowed = set(), set()
    for r in got:
        assert tuple(r.p) == one_policy(r.draft, r.candidate), r
        allowed |= {(i, x) for i, x in enumerate(r.p)}
        if r.draft is not None:
            want = one_audit(r, r.safe, r.route)
            assert tuple(r.a) == (*want[:2], pytest.approx(want[2], abs=1e-3), *want[3:]), r
            decisions.add(want[:2])
    assert len(allowed) == 6 and len(decisions) >= 7
