import re
from collections import Counter
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pytest

from transcriptlab.operators import agreement
from transcriptlab.operators.agreement import NUMBERS

VOTES = "id int, place int, model string, ok boolean, transcript string, language_class string, confidence double"


def like(a, b):
    x, y = ([NUMBERS.get(w, w) for w in re.sub(r"[^a-z0-9ऀ-ॿ]+", " ", t.lower()).split()] for t in (a, b))
    return 1.0 if not x and not y else 0.0 if not x or not y else SequenceMatcher(None, x, y, autojunk=False).ratio()


def one(clip, votes, k):
    _, gold, bucket = clip
    good = [v for v in votes if v[3] and v[4]]
    if not good:
        return "cloud_failed", bucket or "uncertain", gold or "", "no successful result"
    best, top = (), -1.0
    sure = [v for v in good if v[5] in agreement.CLASSES and re.sub(r"[^a-z0-9ऀ-ॿ]+", "", v[4].lower())]
    for some in combinations(sure, k) if k > 1 else ():
        if len({v[5] for v in some}) == 1:
            least = min(like(a[4], b[4]) for a, b in combinations(some, 2))
            if least >= agreement.ALIKE and least > top:
                best, top = some, least
    text = max(best or good, key=lambda v: (v[6] or 0.0, len(v[4])))[4]
    named = Counter(v[5] for v in good if v[5] in (*agreement.CLASSES, agreement.UNSURE))
    most = max(named.values(), default=0)
    major = next((c for c in (*agreement.CLASSES, agreement.UNSURE) if named[c] == most), "uncertain") if most >= 2 or sum(named.values()) == 1 else "uncertain"
    if len(good) < k:
        return "needs_human_review", major, text, f"only {len(good)} successful transcript(s); need {k}"
    if best:
        return "cloud_confirmed", best[0][5], text, f"{k} models agree on transcript and language class: " + ", ".join(v[2] for v in best)
    return "needs_human_review", major, text, "language class resolved but no confirming transcript subset" if major != "uncertain" else "classification uncertain"


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_confirmed_same_as_all_subsets(spark, k):
    rng = np.random.default_rng(k)
    words = ["One", "two", "2", "three", "मतलब", "go", "on", "we", "ship", "it"]
    clips, votes = [(900, "kept", None), (901, None, "english_only")], [(900, 0, "m0", False, "x", "english_only", 0.5), (901, 0, "m0", True, "", "english_only", None)]
    for c in range(120):
        clips.append((c, "gold", "hindi_english"))
        base = list(rng.choice(words, 12))
        for p in range(int(rng.integers(1, 7))):
            text = [str(rng.choice(words)) if rng.random() < 0.06 else w for w in base]
            kind = str(rng.choice(["english_only", "english_only", "hindi_english", "uncertain", "other"]))
            votes.append((c, p, f"m{p}", bool(rng.random() < 0.9), " ".join(text) if rng.random() < 0.95 else "...", kind, None if rng.random() < 0.2 else float(rng.integers(0, 3)) / 2))
    got = {r.id: tuple(r)[1:] for r in agreement.confirmed(spark.createDataFrame(clips, "id int, gold string, bucket string"), spark.createDataFrame(votes, VOTES).repartition(3), k).collect()}
    want = {c[0]: one(c, [v for v in votes if v[0] == c[0]], k) for c in clips}
    assert got == want
    assert {s for s, *_ in want.values()} >= ({"cloud_failed", "needs_human_review", "cloud_confirmed"} if k in (2, 3) else {"cloud_failed"})
