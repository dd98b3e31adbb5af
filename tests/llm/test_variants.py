import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from transcriptlab.llm import variants

DOCS = "doc_id long, text string, word string, n int, cell int, tree int"
LETTERS = list("abcdeéñ×÷Éÿ")


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def brute(words):
    """(form, root, n, n_near, form_n) of each word, from the edit distances of all pairs."""
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def made(seed, n=220):
    rng = np.random.default_rng(seed)
    words = {}
    while len(words) < n:
        stem = "".join(rng.choice(LETTERS, rng.integers(5, 9)))
        words[stem] = int(rng.integers(3, 60))
        for _ in range(rng.integers(0, 6)):  # variants of variants, so that forms make chains
            at, kind = rng.integers(0, len(stem)), rng.integers(0, 4)
            letter = str(rng.choice(LETTERS))
            stem = [stem[:at] + letter + stem[at + 1 :], stem[:at] + letter + stem[at:], stem[:at] + stem[at + 1 :] if len(stem) > 5 else stem, stem[::-1]][kind]
            words[stem] = int(rng.integers(3, 60))
    return words | {"q" * 5 + "r" * n: 3 << n for n in range(9)}  # a chain through lengths


@pytest.mark.parametrize(("seed", "shard", "block"), [(1, variants.SHARD, variants.BLOCK), (2, 8, 5), (3, 3, 1000)])
def test_variants_same_as_brute_force(spark, seed, shard, block):
    """Also with cells and shards of a few words."""
    words = made(seed)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_forms(df, shard_rows=shard, block_rows=block).collect()}
    assert got == brute(words)
    assert any(root not in (w, form) for w, (form, root, *_) in got.items())


def test_variants_of_odd_rows_same_as_sql(spark, tmp_path):
    words = list(made(4, 60))
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(words, 200))) for i in range(40)]
    rows += [(1, rows[1][1]), (50, None), (51, ""), (52, "Ab cDéf ABCDE abcdE 12abcde3 abcd"), (53, "É" * 500), (53, "É" * 500), (54, "É" * 500), (-7, " ".join(words).upper())]
    docs = spark.createDataFrame([(i, t, "w", 1, 2, 3) for i, t in rows], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    con.execute(variants.OP11_SQL)
    got = [tuple(r) for r in variants.op11_variants(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert sorted(got, key=repr) == sorted(con.fetchall(), key=repr) and len(got) > 50
    assert variants.spelling_forms(variants.occurrences(docs.limit(0))).count() == 0


def test_runs_lose_the_letter_that_their_hash_names(spark):
    rows = [(i, "Straßen straßen wörter ÀÉÎ-ÀÉÎ abcdefgh" + " sechs" * (i % 3)) for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, "straßen " * 3)], "doc_id long, text string")
    want = {}
    for i, text in rows:
        for run in text.replace("-", " ").translate(str.maketrans(variants.UPPER, variants.LOWER)).split():
            h = zlib.crc32(f"{i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            want[word] = want.get(word, 0) + 1
    want["straßen"] += 3
    got = {r.word: r.n for r in variants.occurrences(docs).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}


def test_words_of_any_length(spark):
    words = {"a" * 30_000: 3, "a" * 30_001: 9, "a" * 29_999 + "b": 40, "b" + "a" * 29_999: 4, "ab" * 400: 5, "ba" * 400: 5, "ab" * 400 + "c": 10}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.form, r.n_near) for r in variants.spelling_forms(df).collect()}
    a, b, c, d, e, f, g = words
    assert got == {a: (c, 3), b: (None, 1), c: (None, 1), d: (None, 1), e: (g, 1), f: (None, 0), g: (None, 1)}


def test_boxes_prune_and_lose_nothing():
    rng = np.random.default_rng(5)
    x = pa.array(sorted({"".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(4000)}))
    raw, counts = variants.letters(x)
    tree, _ = variants.kd_tree(counts)
    seen = []
    i, j = variants.near_words(tree, raw, counts, raw[:200], counts[:200], seen)
    want = {(a, b) for a in range(200) for b in np.flatnonzero((raw != raw[a]).sum(1) == 1)}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)
    assert sum(seen) < 0.6 * 200 * len(raw)
