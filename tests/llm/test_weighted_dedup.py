from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from transcriptlab.llm import neardup

DOCS = "doc_id long, text string, size long, repeats int"


def counted(text):
    words = (text or "").split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))


def plain(x, y):
    return len(x.keys() & y.keys()) / max(len(x.keys() | y.keys()), 1) if x or y else 1.0


def chance(x, y):
    """Probability Jaccard similarity as it is defined."""
    if not x and not y:
        return 1.0
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in every) for d in x.keys() & y.keys())


def test_exact_similarity_is_the_one_defined():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 12):
        for _ in range(60):
            x, y = (Counter({int(i): int(rng.integers(1, 9)) for i in rng.choice(15, n, replace=False)}) for _ in range(2))
            sides = [(np.array(sorted(c), np.uint64), np.array([c[i] for i in sorted(c)], np.int32)) for c in (x, y)]
            assert neardup.probability_jaccard(sides[0][0], sides[1][0], sides[0][1], sides[1][1]) == pytest.approx(chance(x, y))
    none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    assert neardup.similarity_of(none, none) == 1.0


def test_registers_agree_with_the_chance_of_weighted_shingles():
    rng = np.random.default_rng(2)
    for most in (1, 3, 40):
        blocks = [" ".join(f"{g}-{i}" for i in range(8)) for g in range(30)]
        texts = [" ".join(b for g, b in enumerate(blocks) for _ in range(int(rng.integers(0 if most > 1 else 1, most + 1)))) for _ in range(2)]
        for weighted, exact in ((True, chance), (False, plain)):
            sig = neardup.signatures(pa.array([*texts, "", "one"]), 4000, weighted=weighted)
            assert (sig[0] == sig[1]).mean() == pytest.approx(exact(*map(counted, texts)), abs=0.035)
            alone = neardup.signatures(pa.array([texts[1]]), 4000, weighted=weighted)
            assert (alone[0] == sig[1]).all() and (sig[2] == 0).all()
        if most == 1:
            assert (neardup.signatures(pa.array(texts), 500) == neardup.signatures(pa.array(texts), 500, weighted=False)).all()


def test_classes_by_either_similarity(spark):
    """Copies that differ in repeats stay linked, and texts alike by weight alone are linked too."""
    rng = np.random.default_rng(3)
    texts = [None, "", "a b", "a b a b a b a b a b a b"]
    for g in range(25):
        heavy, light = ([" ".join(f"{k}{g}-{b}-{i}" for i in range(9)) for b in range(12)] for k in "hl")
        heavy, light = heavy[: int(rng.integers(1, 12))], light[: int(rng.integers(1, 12))]
        times = int(rng.integers(1, 30))
        base = (" ".join(heavy) + " ") * times
        texts += [base + " ".join(light), base + " ".join(light[: len(light) // 2]), base * int(rng.integers(1, 4)) + " ".join(light), base, " ".join(light)]
        texts.append(base.replace("-0 ", "-zero ", int(rng.integers(1, 3))) + " ".join(light))
    of = [counted(t) for t in texts]
    label = list(range(len(texts)))
    by_weight = 0
    for i in range(len(texts)):
        for j in range(i):
            near = plain(of[i], of[j]) >= 0.8
            if near or chance(of[i], of[j]) >= 0.8:
                by_weight += not near
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    assert got == dict(enumerate(label)) and by_weight > 10
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
