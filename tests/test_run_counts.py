import random

import pyarrow as pa

from transcriptlab.functions import columns as C
from transcriptlab.functions import meaning as M

WORDS = "für f r api API एपीआई chat gpt ChatGPT do not mat foo move forward zero to one समझा problems story stories İstanbul K ΣΑΣ teams tool bar a b 0 1 data डेटा".split()


def test_counts_of_a_run_in_one_pass_same_as_one_by_one(monkeypatch):
    """Null lists, words and texts, phrases, other scripts; a vocabulary that is begun anew between stretches; each word asked once."""
    rng = random.Random(1)
    some = lambda: None if rng.random() < 0.05 else [rng.choice([*WORDS, None]) for _ in range(rng.randrange(20))]
    ref, hyp = [some() for _ in range(400)], [some() for _ in range(400)]
    text = lambda x: None if x is None else " ".join(w for w in x if w)
    lists = lambda x: pa.array(x, pa.list_(pa.string()))
    gold, actual, given = (pa.array(x, pa.string()) for x in (map(text, ref), map(text, hyp), [rng.choice([None, ";", "Foo Bar, für; data"]) for _ in ref]))
    terms = M._expected.func(gold, given)
    parts = M._counts.func(pa.array([None if x is None else [x] for x in ref], pa.list_(pa.list_(pa.string()))), lists(hyp)).to_pylist()
    said = M._heard_terms.func(terms, actual).to_pylist()
    errors, copied = C._distances(lists(ref), lists(hyp), True), C.longest_copies(*C._coded(lists(hyp), lower=True)[0], range(2, 9))
    want = [(e, c, *((p[0]["wanted"], p[0]["met"]) if p else (None, None)), h["n"], len(h["hits"])) for e, c, p, h in zip(errors, copied, parts, said, strict=True)]
    asked, whole = [], M._anchor.__wrapped__
    monkeypatch.setattr(M, "_anchor", lambda w: asked.append(w) or whole(w))
    monkeypatch.setattr(M, "_VOCABULARY", [M._Vocabulary()])
    got = [tuple(x.values()) for x in M._run_counts.func(lists(ref), lists(hyp), gold, actual, given).to_pylist()]
    assert got == want
    before = len(asked)
    M._run_counts.func(lists(ref), lists(hyp), gold, actual, given)
    assert 0 < before == len(asked)  # the next batch asks for none of its words again
    cut, anew = M.stretches, M.vocabulary
    monkeypatch.setattr(M, "stretches", lambda sizes, most=0: cut(sizes, 60))
    monkeypatch.setattr(M, "vocabulary", lambda: anew(5))
    assert [tuple(x.values()) for x in M._run_counts.func(lists(ref), lists(hyp), gold, actual, given).to_pylist()] == want
