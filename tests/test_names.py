import re

import numpy as np
from pyspark.sql import functions as F

from transcriptlab.functions import spelled
from transcriptlab.operators import stems


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def one_term(letters, terms):
    fits = [t for t in terms if t.isupper() and 2 <= len(t) <= 8]
    if letters in fits:
        return letters
    at, used = 0, []
    while at < len(letters):
        tried = [(edits(t, letters[at : at + len(t)]), -len(t), i) for i, t in enumerate(fits) if i not in used and len(letters) - at >= len(t)]
        best = min((x for x in tried if x[0] <= 1), default=None)
        if best is None:
            return None
        used.append(best[2])
        at += len(fits[best[2]])
    return ", ".join(fits[i] for i in used) if len(used) >= 2 else None


def one_text(text, other, glossary):
    text, other = text or "", other or ""
    terms = [t for t in re.findall(spelled.TERMS, other) if t.upper() != "OK"]
    key = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    terms += [t for t in sorted(set(glossary), key=str.lower) if f" {key(t)} " in f" {key(other)} "]
    rules = []
    for m in reversed(list(re.finditer(spelled.LETTERS, text))):
        letters = re.sub("[^A-Z]", "", m[0].upper())
        to = one_term(letters, list(dict.fromkeys(terms)))
        if to:
            text = text[: m.start()] + to + text[m.end() :]
            rules.append(f"spelled:{letters}->{to}")
    return text, rules


def test_spelled_terms_same_as_a_loop(spark):
    rng = np.random.default_rng(1)
    names = ["API", "GPU", "AP", "IG", "ASR", "TTS", "ASRT", "X9", "OK", "DataFrame", "STT"]
    rows = [(None, "API"), ("a p i", None), ("A, P, I and a b", "OK API"), ("xA P Iy A P I2", "API"), ("A P I G P U", "GPU then API"), ("A P I A P I", "API only"), ("A P X", "API"), ("A A P I", "AA API"), ("l l m s", "we use large models")]
    for _ in range(400):
        own = list(rng.choice(names, rng.integers(1, 3)))
        said = "".join(own)
        letters = [str(rng.choice(list("AGTX"))) if rng.random() < 0.1 else c for c in said if c.isalpha()][:9]
        rows.append((f"we use {str(rng.choice([' ', ', ', ' , '])).join(c.lower() if rng.random() < 0.3 else c for c in letters)} daily", " ".join([*(own if rng.random() < 0.6 else ()), *rng.choice(names, rng.integers(0, 5))])))
    df = spark.createDataFrame(rows, "text string, other string").repartition(3).withColumn("x", spelled.spelled_terms(F.col("text"), F.col("other"), ("LLMS", "large models")))
    got = df.collect()
    for r in got:
        assert (r.x.text, r.x.rules) == one_text(r.text, r.other, ("LLMS", "large models")), r
    assert sum(bool(r.x.rules) for r in got) > 60 and any(", " in rule for r in got for rule in r.x.rules)


def test_files_same_as_a_search_of_all(spark):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("ab1_é"), n))
    files = [(word(rng.integers(1, 9)), f"/p/{i}.wav", i) for i in range(150)] + [(None, "/p/none", 900), ("", "/p/empty", 901), ("shared", "/p/x", 902), ("shared", "/p/y", 903)]
    ids = [word(rng.integers(1, 14)) for _ in range(400)] + [files[3][0], "shared", "my-shared-one", "", None, "zzz", "share"]
    known = {}
    for stem, path, _ in files:
        if stem:
            known[stem] = path
    want = [(i, (known[i] if i in known else next((p for s, p in known.items() if s in i or i in s), None)) if i else None) for i in ids]
    got = stems.files_of(spark.createDataFrame([(i, 7) for i in ids], "id string, n int"), spark.createDataFrame(files, "stem string, path string, place int"))
    assert sorted(((r.id, r.path) for r in got.collect()), key=repr) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
