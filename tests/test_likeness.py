import random
import re
import time
from difflib import SequenceMatcher

import pyarrow as pa

from transcriptlab.functions import alignment as A
from transcriptlab.operators import consensus


def texts(rng):
    letters = rng.choice(["ab", "ab c", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz 0123é"])
    one = lambda: "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 60, 199, 260, 700])))
    x = one()
    y = "".join(c for c in x if rng.random() > 0.2) if rng.random() < 0.5 else one()
    return x, y


def test_sides_of_a_least_likeness_against_difflib():
    rng = random.Random(5)
    pairs = [texts(rng) for _ in range(400)]
    right = [SequenceMatcher(None, x, y).ratio() if x or y else 1.0 for x, y in pairs]
    share = lambda n, x, y: 1.0 if x == y else 2.0 * n / (len(x) + len(y))
    assert [share(n, *p) for n, p in zip(A.shared([(x, y, 0.0) for x, y in pairs]), pairs, strict=True)] == right
    for least in (0.3, 0.82, 0.94, None):
        asked = [(x, y, r if least is None else least) for (x, y), r in zip(pairs, right, strict=True)]
        assert [share(n, x, y) >= m for n, (x, y, m) in zip(A.shared(asked), asked, strict=True)] == [r >= m for r, (_, _, m) in zip(right, asked, strict=True)]


def test_letters_in_order_of_many_pairs():
    def plain(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            before = 0
            for j, d in enumerate(y, 1):
                before, row[j] = row[j], before + 1 if c == d else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(2)
    pairs = [tuple("".join(rng.choice("abc é😀"[: rng.choice([1, 3, 6])]) for _ in range(rng.choice([1, 5, 63, 64, 65, 130, 256]))) for _ in "xy") for _ in range(120)]
    assert A.in_orders(pairs, 2000).tolist() == A.in_orders(pairs).tolist() == [plain(*p) for p in pairs]


def test_equal_and_unlike_texts_take_no_alignment(monkeypatch):
    rng = random.Random(4)
    x = "".join(rng.choice("etaoinshr dlu") for _ in range(150))
    other = "".join(rng.choice("bcfgjkmpqvw") for _ in range(150))
    monkeypatch.setattr(A, "shared_runs", lambda *_: 1 / 0)
    monkeypatch.setattr(A, "shared_letters", lambda *_: 1 / 0)
    column = lambda v, t: pa.array([v], pa.list_(t))
    assert A._supports.func(column([x, other, x], pa.string()), column([0.82] * 3, pa.float64()), column([140, 110, 70], pa.int64())).to_pylist() == [[210, 110, 210]]
    assert A._supports.func(column([], pa.string()), column([], pa.float64()), column([], pa.int64())).to_pylist() == [[]]


def test_long_texts_stop_once_their_side_is_known():
    rng = random.Random(3)
    x, y = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") + rng.choice("eta ") * 3 for _ in range(30_000)) for _ in "xy")
    took = []
    for need in (None, len(x) * 9 // 10):
        began = time.perf_counter()
        A.shared_letters(x, y, need)
        took.append(time.perf_counter() - began)
    assert took[1] < took[0]


def test_draft_gold_moves_texts_once(spark):
    schema = "id string, name string, text string, error string"
    rows = [("a", "accurate", "x " * 9, None), ("a", "tiny", "we said the plan", None), ("a", "fast", "we said the plan!", None), (None, "tiny", "no clip for this", None), ("b", "fast", "gut gemacht", None), ("b", "new", "one", "timeout")]
    got = consensus.draft_gold(spark.createDataFrame(rows, schema), {"accurate": 1.4, "tiny": 1.1, "fast": 0.7}, ("accurate",))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", "we said the plan", "tiny", 1.8), (None, "no clip for this", "tiny", 0.0), ("b", "gut gemacht", "fast", 0.0)], key=repr)


def test_usable_without_making_words(spark):
    rng = random.Random(1)
    words = ["a", "ab", "a'b", "gut", "gutes", "x-gut", "9", "danke!", "'", "हिं", "é"]
    rows = [" ".join(rng.choice(words[: rng.choice([2, 3, 11])]) for _ in range(rng.choice([0, 1, 2, 7, 8, 12, 18, 19, 20]))) for _ in range(600)] + ["a ab " * 5, "ab a " * 5, "a a" * 9, "ab" * 20]

    def plain(text):
        low = text.lower()
        found = re.findall("[a-z0-9']+", low)
        looped = len(set(found)) <= 2 and len(found) >= 8
        return len(found) >= 2 and not looped and not set(re.findall("[a-z']+", low)) & set(consensus.FOREIGN) and not re.search("[ऀ-ॿ]", text)

    df = spark.createDataFrame([(t,) for t in [*rows, None]], "text string")
    got = df.select("text", consensus.usable(df.text), consensus.words_at_least(df.text, 19, "A-Za-z0-9'")).collect()
    assert [x[1] for x in got] == [*map(plain, rows), False]
    assert [x[2] for x in got] == [*(len(re.findall("[A-Za-z0-9']+", t)) >= 19 for t in rows), None]
