import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from transcriptlab.llm import toxicity
from transcriptlab.llm.common import table

DATA = "/root/testdata/sf0.001"


def test_forward_pass_same_as_a_loop():
    """Every filter over every window of every text, one by one; texts without words have one window of padding."""
    rng = np.random.default_rng(1)
    c = toxicity.Config(buckets=64, dim=3, filters=4)
    total = c.filters * len(c.widths)
    emb = rng.normal(size=(c.buckets + 1, c.dim))
    emb[-1] = 0
    model = toxicity.Model(c, emb, [rng.normal(size=(w, c.dim, c.filters)) for w in c.widths], rng.normal(size=total), rng.normal(size=total), 0.3)
    texts = pa.array(["", "one", "One two, THREE four", "a b c d e f g a b", " ", "été über x"])
    got = toxicity.logits(model, model.tables(), texts)
    ids, counts = toxicity.buckets(texts, c.buckets)
    at = 0
    for n, z in zip(counts, got, strict=True):
        words = [emb[a] + emb[b] for a, b in ids[at : at + n]] or [2 * emb[-1]]
        at += n
        best = []
        for kernel, w in zip(model.kernels, c.widths, strict=True):
            padded = words + [2 * emb[-1]] * (w - 1)
            best.append(np.max([sum(padded[i + o] @ kernel[o] for o in range(w)) for i in range(len(words))], axis=0))
        assert z == pytest.approx(np.maximum(np.concatenate(best) + model.bias, 0) @ model.out + model.out_bias, abs=1e-4)


def test_stage_keeps_columns_of_any_name(spark):
    docs = table(spark, DATA, "documents")
    more = docs.select("*", F.lit(7).alias("score"), F.lit(8).alias("row"), F.lit(9).alias("own_row"))
    plain, wide = toxicity.stage_toxicity(spark, docs, DATA), toxicity.stage_toxicity(spark, more, DATA)
    assert wide.columns == more.columns and plain.columns == docs.columns
    kept = {r.doc_id for r in plain.collect()}
    rows = wide.collect()
    assert {r.doc_id for r in rows} == kept and 0 < len(kept) <= docs.count() and all((r.score, r["row"], r.own_row) == (7, 8, 9) for r in rows)
