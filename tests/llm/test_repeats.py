import hashlib
from collections import Counter

import numpy as np
import pytest

from transcriptlab.llm import repeats

DOCS = "doc_id long, text string, key string, spans int, start int, data string"


def brute(texts):
    """Of each text the bytes, and which of them a string of SPAN bytes covers that starts anywhere else too."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + repeats.SPAN] for b in raw for i in range(len(b) - repeats.SPAN + 1))
    out = []
    for b in raw:
        covered = bytearray(len(b))
        for i in range(len(b) - repeats.SPAN + 1):
            if seen[b[i : i + repeats.SPAN]] > 1:
                covered[i : i + repeats.SPAN] = b"\1" * repeats.SPAN
        spans, at = [], 0
        while at < len(b):
            if covered[at]:
                end = at
                while end < len(b) and covered[end]:
                    end += 1
                spans.append((at, end))
                at = end
            at += 1
        out.append((len(b), spans, bytes(x for x, c in zip(b, covered, strict=True) if not c)))
    return out


def made(seed):
    """Passages around the length of a string, in texts of their own, at their ends, next to each other, over and over; other languages."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé中\0"), rng.integers(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n)[:m] for n, m in ((60, 199), (60, 200), (90, 201), (120, 300), (200, 700))]
    texts = [None, "", "short", "a" * 199, "a" * 200, "a" * 450, "xy" * 300]
    for p in passages:
        for _ in range(3):
            texts.append(prose(rng.integers(0, 30)) + p + prose(rng.integers(0, 30)))
        texts += [p, p + passages[0]]
    texts.append(passages[3] + "|" + passages[3])
    long = prose(2000)
    edited = list(long)
    for i in rng.integers(0, len(edited), 12):
        edited[i] = "#"
    return [*texts, long, "".join(edited), long[:1500], long]


@pytest.mark.parametrize(("seed", "limit", "grams"), [(1, repeats.LIMIT, repeats.BROADCAST_GRAMS), (2, 2, repeats.BROADCAST_GRAMS), (3, repeats.LIMIT, 0), (4, 2, 0)])
def test_repeats_same_as_brute_force(spark, seed, limit, grams):
    """Also where every run of bytes is dealt by offsets and strings, and where shared runs are joined, not broadcast."""
    texts = made(seed)
    docs = spark.createDataFrame([(i, t, "k", 1, 2, "d") for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in repeats.without_repeats(docs, limit, grams).collect()}
    for i, want in enumerate(brute(texts)):
        assert got[i] == want, i


def test_repeats_of_odd_rows(spark):
    """Repeated rows, null and repeated doc_ids; empty tables."""
    text = "".join(np.random.default_rng(5).choice(list("abcdefgh "), 400))
    rows = [(1, text), (1, text), (None, text[:250]), (None, None), (2, text[:199]), (3, "other " * 60), (3, text[150:] + "!")]
    docs = spark.createDataFrame([(i, t, "k", 1, 2, "d") for i, t in rows], DOCS)
    for limit, grams in ((repeats.LIMIT, repeats.BROADCAST_GRAMS), (1, 0)):
        got = sorted(((r.doc_id or 0, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in repeats.without_repeats(docs, limit, grams).collect()), key=repr)
        assert got == sorted(((i or 0, *b) for (i, _), b in zip(rows, brute([t for _, t in rows]), strict=True)), key=repr)
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_repeats_query(spark, tmp_path):
    texts = made(6)
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in repeats.op12_repeats(spark, str(tmp_path)).collect()}
    for i, (n, spans, kept) in enumerate(brute(texts)):
        assert got[i] == (n, sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest())


def test_multikey_sorts_ties_by_the_next_key():
    rng = np.random.default_rng(7)
    keys, group = rng.integers(0, 3, (500, 6)).astype(np.uint64), rng.integers(0, 4, 500)
    order = repeats.multikey(keys, group)
    rows = [(group[i], *keys[i]) for i in order]
    assert rows == sorted(rows) and sorted(order) == list(range(500))


def test_splitters_part_by_leading_bytes(spark):
    rng = np.random.default_rng(8)
    rows = [(int(g), int(n), int(lead)) for g, n, lead in zip(rng.permutation(3000), rng.integers(2, 40, 3000), rng.integers(-5, 5, 3000), strict=True)]
    shared = spark.createDataFrame(rows, "gram long, n long, lead long")
    total = sum(n for _, n, _ in rows)
    cuts = repeats.splitters(shared, total, len(rows))
    assert cuts == sorted(set(cuts)) and len(cuts) == -(-total // repeats.BUCKET) - 1
    sizes = Counter(sum(c <= (lead, g) for c in cuts) for g, _, lead in rows)
    assert max(sizes.values()) < 2 * min(sizes.values())
