import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from transcriptlab.functions import roman
from transcriptlab.functions.columns import percentiles
from transcriptlab.operators import cutting, merging


def plain(word):
    word = word.lower().strip("'")
    word = word[:-2] if word.endswith("'s") else word
    return word[:-1] if len(word) > 3 and word.endswith("s") else word


def placed(text):
    return [(plain(m[0]), m.end()) for m in re.finditer(r"[A-Za-z0-9']+", text) if plain(m[0])]


def one_merge(draft, text, pending):
    """The rules of merge_tails, row by row, over the blocks of a plain aligner."""
    draft, text = (draft or "").strip(), (text or "").strip()
    a, b = [w for w, _ in placed(text)], [w for w, _ in placed(draft)]
    blocks = [x for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x.size]
    matched, last = sum(x.size for x in blocks), max((x.b + x.size for x in blocks), default=0)
    covers = len(a) >= 4 and len(b) >= 4 and matched / len(b) >= 0.55 and last >= len(b)
    complete = re.sub(r"\s+", " ", text.lower().rstrip(" .,!?:;")).endswith(merging.COMPLETE)
    if not text or not draft or (not pending and (covers or complete)) or len(a) < 2 or len(b) < 4:
        return text
    at = max((x.b + x.size for x in blocks if x.size >= 2 or x.a + x.size >= len(a) - 2), default=0)
    at_end = any(x.size >= 2 and x.a + x.size >= len(a) - 1 for x in blocks)
    if (matched < 3 and not at_end) or not 0 < at < len(b):
        return text
    tail = draft[placed(draft)[at - 1][1] :].strip().lstrip(" ,.;:-")
    return text if len(tail.split()) < 2 else text.rstrip(" ,") + " " + tail.lstrip(" ,")


def test_tails_same_as_a_merge_one_by_one(spark):
    rng = np.random.default_rng(1)
    words = ["the", "cats'", "cat", "Agents", "agent's", "is", "it's", "über", "so", "''", "go", "12", "no,", "-", "end."]
    rows = [(None, "a b", 0), ("a b c d e f", None, 1), ("", "", None), ("one two three four five", "one two three", 1), ("please tell me more of it now", "tell me SANKSHIPT mein  uttar de.", 0)]
    for _ in range(400):
        draft = list(rng.choice(words, rng.integers(0, 25)))
        text = [w for w in draft[int(rng.integers(0, 4)) : int(rng.integers(2, 25))] if rng.random() < 0.85]
        rows.append((" ".join(draft), " ".join(text) + str(rng.choice(["", ",", " ."])), int(rng.integers(0, 2))))
    df = spark.createDataFrame(rows, "draft string, text string, pending int")
    got = {(r.draft, r.text, r.pending): r.merged for r in merging.merge_tails(df).collect()}
    want = {row: one_merge(*row) for row in rows}
    assert got == want and sum(want[r] != (r[1] or "").strip() for r in want) > 40


def test_letters_of_devanagari(spark):
    pairs = {
        "करना": "karna", "देखा": "dekh", "भाई": "bhai", "शक्ति": "shakti".replace("sh", "s"), "छोटा": "chota", "चाय": "caya", "ज़रूर": "zarura", "पढ़ना": "parhana",
        "मैं": "maim", "कौन": "kauna", "ऐसा": "aisa", "औरत": "aurata", "नहीं": "nahi", "हाँ": "haan", "में": "mein", "और": "aur", "अगर": "agar", "कृपया": "krpaya",
        "दुःख": "duhkha", "१२३": "123", "ठीक है।": "thika hai.", "फ़ोन और phone": "fona aur phone", "यह API है": "yeh API hai", "अलगअलग": "alag alag", "विज्ञान": "vijnana",
    }
    texts = [*pairs, "no change  here", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", roman.romanized(F.col("t")).alias("r"))
    got = {r.t: r.r for r in df.collect()}
    assert got == pairs | {"no change  here": "no change  here", None: ""}


def test_every_consonant_with_every_sign(spark):
    """Each consonant alone, dead, with each sign, and doubled, against a loop over code points."""
    letter = roman.CONSONANTS | roman.DOTTED_LETTERS
    signs = roman.SIGNS | {"ै": "ai", "ौ": "au"}

    def loop(text):
        out = ""
        for i, c in enumerate(text):
            if c in letter:
                out += letter[c] + ("h" if c in roman.ASPIRATED else "") + ("" if text[i + 1 : i + 2] in (*signs, "्") else "a")
            else:
                out += signs.get(c, "") if c != "्" else ""
        return out

    texts = [c + s for c in letter for s in ("", "्", *signs)] + [c + "्" + d for c in letter for d in letter]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", roman.transliterated(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == {t: loop(t) for t in texts}


def test_spoken_and_one_spelling(spark):
    rows = [(w, None) for w in roman.SPOKEN]
    df = spark.createDataFrame(rows, "w string, x string").select("w", roman.respelled(F.initcap("w")).alias("r"), roman.respelled(F.concat("w", F.lit("é"))).alias("no"))
    for r in df.collect():
        assert r.r == roman.SPOKEN[r.w].replace("_", " ") and r.no == r.w + "é"
    text = "Thik kuchh, VICHAAR paega thika ethik"
    assert spark.range(1).select(roman.one_spelling(F.lit(text))).first()[0] == "Theek kuch, Vichar payega thika ethik"


def one_cut(energy, total, rate, target, least, most, around):
    frame, hop = max(1, int(0.020 * rate)), max(1, int(0.010 * rate))
    middle = float(np.median(energy)) if len(energy) else 1.0
    low, high, wish, look = max(1, int(least * rate)), max(max(1, int(least * rate)), int(most * rate)), max(max(1, int(least * rate)), int(target * rate)), max(0, int(around * rate))
    start, out = 0, []
    while total - start > high:
        ideal = start + wish
        lower, upper = max(start + low, ideal - look), min(start + high, ideal + look, total - low)
        end = min(start + wish, total)
        if upper > lower:
            end, best = ideal, None
            for i in range(max(0, lower // hop), min(len(energy) - 1, max(lower // hop, upper // hop)) + 1):
                at = i * hop + frame // 2
                if lower < at < upper:
                    score = energy[i] / (middle + 1e-9) + 0.10 * (abs(at - ideal) / rate)
                    if best is None or score < best:
                        end, best = at, score
        out.append((start, end))
        start = end
    return [*out, (start, total)] if start < total else out


@pytest.mark.parametrize("batch", [10_000, 7])
def test_cuts_same_as_a_loop(spark, batch):
    rng = np.random.default_rng(2)
    seconds = (2.0, 1.2, 2.6, 0.5)
    clips = {}
    for c in range(40):
        n = int(rng.integers(0, 1500))
        energy = np.round(rng.random(n) * (rng.random() < 0.8), 1 if c % 3 else 6)  # many ties, and silent clips
        clips[f"c{c}"] = (energy, n * 10 + int(rng.integers(0, 30)))
    frames = [(c, i, float(e)) for c, (energy, _) in clips.items() for i, e in enumerate(energy)]
    df = spark.createDataFrame(frames, "clip string, frame long, energy double").repartition(5)
    totals = spark.createDataFrame([(c, t) for c, (_, t) in clips.items()], "clip string, total long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {}
        for r in cutting.quiet_chunks(df, totals, 1000, *seconds).orderBy("clip", "chunk").collect():
            got.setdefault(r.clip, []).append((r.start, r.stop))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {c: want for c, (e, t) in clips.items() if (want := one_cut(e, t, 1000, *seconds))}


def test_cuts_of_odd_clips(spark):
    """A clip of a million frames; one without frames, one without a length, null energies; target shorter than the least length."""
    rng = np.random.default_rng(3)
    energy = np.round(rng.random(1_000_000), 3)
    import pandas as pd

    long = spark.createDataFrame(pd.DataFrame({"clip": "long", "frame": np.arange(1_000_000), "energy": energy}))
    odd = spark.createDataFrame([("lost", 0, 0.5), ("null", 0, None), ("null", 1, None)], "clip string, frame long, energy double")
    totals = spark.createDataFrame([("long", 10_000_000), ("none", 70_000), ("null", 20), ("zero", 0)], "clip string, total long")
    got = cutting.quiet_chunks(long.unionByName(odd), totals, 1000, 8.0, 5.0, 9.0, 1.5).orderBy("clip", "chunk").collect()
    of = lambda c: [(r.start, r.stop) for r in got if r.clip == c]
    assert of("long") == one_cut(energy, 10_000_000, 1000, 8.0, 5.0, 9.0, 1.5)
    assert of("none") == one_cut([], 70_000, 1000, 8.0, 5.0, 9.0, 1.5) and of("null") == [(0, 20)] and not of("lost") and not of("zero")
    assert cutting.quiet_chunks(odd.limit(0), totals.limit(0), 1000, 8.0, 5.0, 9.0, 1.5).count() == 0


def test_quantiles_of_values_far_apart(spark):
    """One value far from all others doesn't put these in one range."""
    rng = np.random.default_rng(4)
    values = np.append(rng.random(20_000), [1e12, -1e12])
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0)] * 5 + [(None, 2.0), ("c", None)], "g string, v double")
    got = {r.g: (r["floor"], r.half_up) for r in percentiles(df, "g", "v", 0.5, ("floor", "half_up")).collect()}
    values.sort()
    assert got == {"a": (values[10_000], values[10_001]), "b": (1.0, 1.0), None: (2.0, 2.0)}
