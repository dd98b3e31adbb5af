"""Toxicity: a convolutional text classifier over hashed word embeddings.

Words are hashed into buckets, each bucket has an embedding, filters of several widths slide over the
words of the whole text, max pooling keeps each filter's best window, and a logistic layer makes the
score.  A word has two buckets, its own and that of its first letters.  The network is begun in numpy on a
bounded part of the labelled rows (``sample_toxic``, ``sample_clean`` and ``sample_words``), each different text of a doc_id once; the first embedding channel
starts from how far the labels agree on a bucket.  Where there are more rows, this is a start only: the buckets' counts are then summed over all labelled rows,
the network goes on over all of them in tasks, a shard each, whose networks are averaged, and cuts come from all rows that are kept from training.  Scores depend on the text alone.  Thresholds are calibrated for each language on rows kept from training
and are a decision beside the score.

Cases: a null or empty text is one padding word and gets that score; very long texts are read whole;
repeated rows get the same score each and train once; a null doc_id is scored and never labelled; conflicting labels of
a doc_id count as toxic; with no labelled rows of both kinds the model is the prior alone; an empty table gives an
empty result; extra columns pass through, and ``score`` replaces a column of its name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, mix, slices, stash, table, word_hashes

SEPARATORS = r"[^\p{L}\p{N}\p{M}]+"


@dataclass
class Config:
    #: At most 2**15, so that a word's buckets are short integers.
    buckets: int = 1 << 15
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    #: Bounds of the labelled rows that the network is begun on, or trained on if there are no more: doc_ids of either kind, and words of all their texts, 4 bytes
    #: each in the driver.  A doc_id whose words don't fit in what those drawn before it left is not in the sample.
    sample_toxic: int = 3000
    sample_clean: int = 6000
    sample_words: int = 10_000_000
    #: Of the sampled rows, the share that is kept for calibration.
    calibration: float = 0.2
    #: Passes over the sample: as many as make ``steps`` updates, within these bounds.
    steps: int = 350
    epochs: tuple[int, int] = (3, 12)
    batch: int = 64
    rate: float = 0.005
    #: Beyond the bounds: passes over all rows, rows of a shard, and steps of a score that cuts are found by.
    rounds: int = 1
    shard_rows: int = 4000
    grain: float = 0.001
    seed: int = 7
    min_language_rows: int = 20


@dataclass
class Model:
    config: Config
    embedding: np.ndarray
    kernels: list[np.ndarray]  # each widths x dim x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and offset, every bucket's part in every filter; a window's value is their sum."""
        return [[(self.embedding @ k).astype(np.float32) for k in kernel] for kernel in self.kernels]


def buckets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two buckets of every word, lower-cased and without punctuation (its own, its first letters'), and words for each text."""
    import pyarrow.compute as pc

    hashes, counts = word_hashes(pc.utf8_lower(texts.cast(pa.large_string())), SEPARATORS, prefix=4)
    return (mix(hashes + GOLDEN) % np.uint64(size)).astype(np.int32), counts


def padded(ids: np.ndarray, counts: np.ndarray, pad: int, widest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end with padding words behind each; where each text starts and ends (at least one word)."""
    sizes = np.maximum(counts, 1)
    starts = np.concatenate([[0], np.cumsum(sizes + widest - 1)])[:-1].astype(np.int64)
    flat = np.full((int((sizes + widest - 1).sum()), 2), pad, dtype=np.int64)
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)])[:-1], counts)
    flat[first + np.arange(len(ids))] = ids
    return flat, starts, starts + sizes


def pooled(model: Model, tables: list[list[np.ndarray]], flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each text's best value of each filter, and the window it stands in if asked for."""
    n, f = len(starts), model.config.filters
    best = np.empty((n, f * len(tables)), np.float32)
    at = np.zeros((n, f * len(tables)), np.int64)
    inner = np.stack([starts, np.minimum(ends, len(flat) - 1)], 1).ravel()
    for j, parts in enumerate(tables):
        value = parts[0][flat[:, 0]] + parts[0][flat[:, 1]]
        for o in range(1, len(parts)):
            value[:-o] += parts[o][flat[o:, 0]]
            value[:-o] += parts[o][flat[o:, 1]]
        top = np.maximum.reduceat(value, inner, axis=0)[::2]
        single = ends - starts == 1
        top[single] = value[starts[single]]
        best[:, j * f : (j + 1) * f] = top
        if where:
            for i in range(n):
                at[i, j * f : (j + 1) * f] = starts[i] + value[starts[i] : ends[i]].argmax(0)
    return best, at


def logits(model: Model, tables: list[list[np.ndarray]], texts: pa.Array) -> np.ndarray:
    c = model.config
    ids, counts = buckets(texts, c.buckets)
    best, _ = pooled(model, tables, *padded(ids, counts, c.buckets, max(c.widths)))
    return np.maximum(best + model.bias, 0) @ model.out + model.out_bias


def fit(config: Config, docs: list[np.ndarray], toxic: np.ndarray, prior: np.ndarray, base: float) -> Model:
    """Train on word-bucket lists.  prior: starting value of each bucket's first channel; base: log odds of toxic rows."""
    rng, c = np.random.default_rng(config.seed), config
    emb = rng.normal(0, 0.05, (c.buckets + 1, c.dim))
    emb[:-1, 0] = prior
    emb[-1] = 0
    kernels = [rng.normal(0, 0.3 / np.sqrt(w * c.dim), (w, c.dim, c.filters)) for w in c.widths]
    for k in kernels:
        k[:, 0, : c.filters // 2] = np.abs(k[:, 0, : c.filters // 2]) + 1.0 / len(k)
    total = c.filters * len(c.widths)
    model = Model(c, emb, kernels, np.zeros(total), np.full(total, 1.0 / total), base)
    if not docs or toxic.min() == toxic.max():
        return model
    epochs = int(np.clip(-(-c.steps * c.batch // len(docs)), *c.epochs))
    return descend(model, docs, toxic, toxic.mean(), epochs, c.rate, rng)


def descend(model: Model, docs: list[np.ndarray], toxic: np.ndarray, share: float, epochs: int, rate: float, rng: np.random.Generator) -> Model:
    """The model after so many passes over word-bucket lists; share: of toxic ones among all rows, by which both kinds weigh the same."""
    c = model.config
    params = [model.embedding, *model.kernels, model.bias, model.out, np.array([model.out_bias])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    weight = np.where(toxic == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    sizes = np.array([len(d) for d in docs])
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), c.batch):
            rows = order[lo : lo + c.batch]
            flat, starts, ends = padded(np.concatenate([docs[i] for i in rows]) if sizes[rows].sum() else np.zeros((0, 2), np.int16), sizes[rows], c.buckets, max(c.widths))
            model.out_bias = float(params[-1][0])
            best, at = pooled(model, model.tables(), flat, starts, ends, where=True)
            hidden = np.maximum(best + model.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.out_bias, -30, 30)))
            err = (p - toxic[rows]) * weight[rows] / len(rows)
            back = np.outer(err, model.out) * (hidden > 0)
            grads = [np.zeros_like(q) for q in params]
            grads[-2][:] = hidden.T @ err + 1e-4 * model.out
            grads[-1][0] = err.sum()
            grads[-3][:] = back.sum(0)
            for j, kernel in enumerate(model.kernels):
                cols = slice(j * c.filters, (j + 1) * c.filters)
                g, pos = back[:, cols], at[:, cols]
                for o in range(len(kernel)):
                    words = flat[np.minimum(pos + o, len(flat) - 1)]  # texts x filters x 2
                    seen = model.embedding[words].sum(2)
                    grads[1 + j][o] = np.einsum("nf,nfd->df", g, seen)
                    for part in (0, 1):
                        np.add.at(grads[0], words[:, :, part], g[:, :, None] * kernel[o].T[None])
            grads[0][-1] = 0
            step += 1
            for q, g, (m, v) in zip(params, grads, moments, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            model.embedding[-1] = 0
    model.out_bias = float(params[-1][0])
    return model


def agreement(docs: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """For each bucket the signed root of its likelihood ratio: large only where many rows agree."""
    pos, neg = np.zeros(size), np.zeros(size)
    for ids, label in zip(docs, toxic, strict=True):
        (pos if label else neg)[np.unique(ids)] += 1
    return signed_roots(pos, neg, toxic.sum(), len(toxic) - toxic.sum())


def signed_roots(pos: np.ndarray, neg: np.ndarray, n1: int, n0: int) -> np.ndarray:
    n = pos + neg
    e1, e0 = n * n1 / max(n1 + n0, 1), n * n0 / max(n1 + n0, 1)
    ratio = 2 * (pos * np.log(np.maximum(pos, 1e-9) / np.maximum(e1, 1e-9)) + neg * np.log(np.maximum(neg, 1e-9) / np.maximum(e0, 1e-9)))
    root = np.sign(pos - e1) * np.sqrt(np.maximum(ratio, 0))
    return np.clip(4 * root / max(root.max(), 1e-9), -1, 4)


def calibrate(model: Model, z: np.ndarray, toxic: np.ndarray, langs: list[str | None], n: np.ndarray | None = None) -> None:
    """Move the score so that 0.5 is the best cut over the calibration rows, then find each language's best cut.  n: how many rows each stands for."""
    n = np.ones(len(z), np.int64) if n is None else n
    if len(z) == 0 or toxic.min() == toxic.max():
        return
    mean = np.average(z, weights=n)
    model.scale = 1.0 / max(np.sqrt(np.average((z - mean) ** 2, weights=n)), 1e-6) * 2
    model.shift = -cut(z, toxic, n) * model.scale
    s = 1 / (1 + np.exp(-(model.scale * z + model.shift)))
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        rows = n[own].sum()
        if rows >= model.config.min_language_rows and 0 < toxic[own].sum() < own.sum():
            # a language with few rows keeps near to the common cut
            model.thresholds[lang] = float((rows * cut(s[own], toxic[own], n[own]) + 50 * 0.5) / (rows + 50))


def cut(score: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> float:
    """The middle of the best cuts by F1."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum((toxic * n)[order])
    f1 = 2 * hits / (np.cumsum(n[order]) + (toxic * n).sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(f1.argmax())
    return float((s[i] + s[min(i + 1, len(s) - 1)]) / 2)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Bits of the map by which rows are sorted out before a join, and those of each of its pages, 4 KB.
MAP_BITS, PAGE_BITS = 1 << 25, 1 << 15


def perhaps_among(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is among ids', and a few others, at most one of so many as ids fill of the map: a join of these moves few texts in vain.

    The map is broadcast, 4 MB however many ids there are.
    """
    if rows.schema[key].dataType != ids.schema[key].dataType:
        return rows
    h = F.pmod(F.xxhash64(key), F.lit(MAP_BITS))
    maps = ids.select(h.alias("_h")).groupBy(F.floor(F.col("_h") / PAGE_BITS).alias("_page")).agg(F.bitmap_construct_agg(F.col("_h") % PAGE_BITS).alias("_map"))
    page, place = F.floor(h / PAGE_BITS), (h % PAGE_BITS).cast("int")
    met = rows.withColumn("_page", page).join(F.broadcast(maps), "_page")
    byte = F.conv(F.hex(F.substring(F.col("_map"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.filter(F.getbit(byte, place % 8) == 1).select(*rows.columns)


def sampled_texts(docs: DataFrame, sample: DataFrame, to_buckets) -> DataFrame:
    """(doc_id, lang, toxic, draw, ids): each different text of a sampled doc_id once, however many rows repeat it; of their languages the first."""
    once = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").join(sample, "doc_id").groupBy("doc_id", "toxic", "draw", "text").agg(F.min("lang").alias("lang"))
    return stash(once.select("doc_id", "lang", "toxic", "draw", to_buckets("text").alias("ids")))


def gathered(rows: DataFrame, words: int) -> DataFrame:
    """The rows of the doc_ids that fit, in the order of their draw, into so many words."""
    left, out = words, []
    # one row for each sampled doc_id
    for r in sorted(rows.groupBy("draw", "doc_id").agg(F.sum(F.size("ids") / 2).cast("long").alias("n")).collect()):
        if r.n <= left:
            left -= r.n
        else:
            out.append((r.doc_id,))
    if not out:
        return rows
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(out, rows.select("doc_id").schema)), "doc_id", "left_anti")


def lists_of(ids: pa.Array) -> list[np.ndarray]:
    ends = np.cumsum(ids.value_lengths().to_numpy() // 2)
    return np.split(ids.flatten().to_numpy().reshape(-1, 2), ends[:-1]) if len(ids) else []


def train_on_all(start: Model, begun_on: list[np.ndarray], labels: np.ndarray, rows: DataFrame) -> Model:
    """A model that was begun on some rows (their bucket lists and labels) after counts, passes and cuts over all of them.  rows: doc_id, lang, toxic, draw, ids.

    Shards and the orders within them go by the rows' own numbers, not by how Spark cuts the table.
    """
    c, sc = start.config, rows.sparkSession.sparkContext
    kept = F.floor(F.col("draw") / 7) % 1000 >= 1000 * c.calibration
    learnt, others = rows.filter(kept), rows.filter(~kept)

    def held(parts):
        # a bucket counts once for each row
        counts = np.zeros((2, c.buckets), np.int64)
        for part in parts:
            for x, label in zip(lists_of(part.column("ids")), part.column("toxic").to_pylist(), strict=True):
                counts[label][np.unique(x)] += 1
        label, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(label.astype(np.int32)), pa.array(counts[label, bucket])], ["bucket", "toxic", "n"])

    sums = learnt.select("ids", "toxic").mapInArrow(held, "bucket int, toxic int, n long").groupBy("bucket", "toxic").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros((2, c.buckets), np.int64)
    found[sums["toxic"].to_numpy(), sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    sizes = {r.toxic: r.n for r in learnt.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    start.embedding[:-1, 0] += signed_roots(found[1], found[0], n1, n0) - agreement(begun_on, labels, c.buckets)
    shards = max(1, -(-(n1 + n0) // c.shard_rows))
    shapes = [p.shape for p in (start.embedding, *start.kernels, start.bias, start.out, np.zeros(1))]
    ends = np.cumsum([int(np.prod(x)) for x in shapes])
    for turn in range(c.rounds):
        shared = sc.broadcast(start)

        def go_on(shard: pa.Table) -> pa.Table:
            own = [x for chunk in shard["ids"].chunks for x in lists_of(chunk)]
            draws = shard["draw"].to_pylist()
            order = np.array(sorted(range(len(own)), key=lambda i: (draws[i], own[i].tobytes())), int)
            m = shared.value
            mine = Model(m.config, m.embedding.copy(), [k.copy() for k in m.kernels], m.bias.copy(), m.out.copy(), m.out_bias)
            descend(mine, [own[i] for i in order], shard["toxic"].to_numpy()[order].astype(int), n1 / (n1 + n0), 1, c.rate / 2, np.random.default_rng(c.seed + turn))
            flat = np.concatenate([p.ravel() for p in (mine.embedding, *mine.kernels, mine.bias, mine.out, np.array([mine.out_bias]))])
            cut_up = np.array_split(flat, 32)
            return pa.table({"piece": pa.array(range(32), pa.int32()), "n": pa.array([len(own)] * 32, pa.int64()), "x": pa.array(cut_up, pa.list_(pa.float64()))})

        nets = learnt.withColumn("shard", F.col("draw") % shards).select("shard", "toxic", "draw", "ids").groupBy("shard").applyInArrow(go_on, "piece int, n long, x array<double>")
        means = nets.groupBy("piece").agg(Summarizer.mean(array_to_vector("x"), F.col("n").cast("double")).alias("x")).select("piece", vector_to_array("x").alias("x")).orderBy("piece").collect()
        flat = np.concatenate([np.array(r.x) for r in means])
        emb, *kernels, bias, out, last = (p.reshape(x) for p, x in zip(np.split(flat, ends[:-1]), shapes, strict=True))
        start = Model(c, emb, kernels, bias, out, float(last[0]))
    shared = sc.broadcast((start, start.tables()))

    @F.arrow_udf("long")
    def steps(ids: pa.Array) -> pa.Array:
        m, tables = shared.value
        z = [(np.maximum(pooled(m, tables, *padded(x, np.array([len(x)]), c.buckets, max(c.widths)))[0] + m.bias, 0) @ m.out + m.out_bias)[0] for x in lists_of(ids)]
        return pa.array(np.round(np.array(z, float) / c.grain).astype(np.int64))

    marks = others.select(steps("ids").alias("z"), "toxic", "lang").groupBy("z", "toxic", "lang").agg(F.count("*").alias("n")).orderBy("z", "toxic", "lang").toArrow()
    calibrate(start, marks["z"].to_numpy() * c.grain, marks["toxic"].to_numpy().astype(int), marks["lang"].to_pylist(), marks["n"].to_numpy())
    return start


def train(docs: DataFrame, labels: DataFrame, config: Config | None = None) -> Model:
    """Fit on documents with a label, without the held-out fold.  docs: doc_id, text, lang; labels: doc_id, toxic."""
    c = config or Config()
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))

    @F.arrow_udf("array<short>")
    def to_buckets(texts: pa.Array) -> pa.Array:
        parts = []
        for part in slices(texts):
            ids, counts = buckets(part, c.buckets)
            parts.append(pa.ListArray.from_arrays(pa.array(2 * np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.ravel().astype(np.int16))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int16()))

    drawn = marked.withColumn("draw", F.abs(F.xxhash64(F.lit(c.seed), "doc_id") % 1_000_000_007))
    sample = drawn.filter("toxic = 1").orderBy("draw", "doc_id").limit(c.sample_toxic).unionByName(drawn.filter("toxic = 0").orderBy("draw", "doc_id").limit(c.sample_clean))
    begun = sampled_texts(docs, F.broadcast(sample), to_buckets)
    fits = gathered(begun, c.sample_words)
    rows = fits.toArrow()
    ids = [x for chunk in rows["ids"].chunks for x in np.split(chunk.flatten().to_numpy().reshape(-1, 2), np.cumsum(chunk.value_lengths().to_numpy() // 2)[:-1]) if len(chunk)]
    # the same order in every run: rows that repeat a doc_id by their words
    names = [(d, i, x[:50].tobytes(), len(x)) for d, i, x in zip(rows["draw"].to_pylist(), rows["doc_id"].to_pylist(), ids, strict=True)]
    order = np.array(sorted(range(len(ids)), key=names.__getitem__), dtype=int)
    langs = rows["lang"].to_pylist()
    ids, langs = [ids[i] for i in order], [langs[i] for i in order]
    toxic, draw = rows["toxic"].to_numpy()[order].astype(int), rows["draw"].to_numpy()[order]
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    kept = (draw // 7 % 1000) >= 1000 * c.calibration
    kept |= not (0 < toxic[~kept].sum() < (~kept).sum())
    base = float(np.log((n1 + 1) / (n0 + 1))) if not (n1 and n0) else 0.0
    learnt = [x for x, k in zip(ids, kept, strict=True) if k]
    model = fit(c, learnt, toxic[kept], agreement(learnt, toxic[kept], c.buckets), base)
    kinds = {r.toxic: r.n for r in drawn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    more = fits is not begun or kinds.get(1, 0) > c.sample_toxic or kinds.get(0, 0) > c.sample_clean
    if more and 0 < toxic[kept].sum() < kept.sum():
        # a table of known size, so that Spark doesn't shuffle texts for the labels of a few; where there are many, only texts that have one
        known = stash(drawn)
        return train_on_all(model, learnt, toxic[kept], sampled_texts(perhaps_among(docs.select("doc_id", "text", "lang"), known), known, to_buckets))
    # Cuts use the rows kept from training; where there are none, all sampled rows.
    cal = ~kept if (~kept).any() else kept
    if cal.any():
        model_tables = model.tables()
        z = np.array([(np.maximum(pooled(model, model_tables, *padded(x, np.array([len(x)]), c.buckets, max(c.widths)))[0] + model.bias, 0) @ model.out + model.out_bias)[0] for x, k in zip(ids, cal, strict=True) if k])
        calibrate(model, z, toxic[cal], [x for x, k in zip(langs, cal, strict=True) if k])
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``score``, a number from 0 to 1 made from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model, model.tables()))  # 10 MB: buckets x filters x offsets

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        m, tables = shared.value
        z = [logits(m, tables, part) for part in slices(texts)]
        z = np.concatenate(z) if z else np.zeros(0)
        return pa.array(1 / (1 + np.exp(-np.clip(m.scale * z + m.shift, -30, 30))), pa.float64())

    return docs.withColumn("score", scored(F.coalesce(F.col(text), F.lit(""))))


def threshold(model: Model, lang: Column) -> Column:
    """The cut for a row's language; 0.5 for languages without one."""
    if not model.thresholds:
        return F.lit(0.5)
    pairs = [x for k, v in sorted(model.thresholds.items()) for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[F.coalesce(lang, F.lit(""))], F.lit(0.5))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text", "lang"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), threshold(model, F.col("lang")).alias("lang_threshold"), (F.col("score") >= threshold(model, F.col("lang"))).cast("int").alias("flagged"))


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, with all their columns."""
    model = train(docs, table(spark, sf_dir, "labels"))
    # the input row as one column, so that a document's own score can't clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", "lang")
    kept = score(rows, model).filter(F.col("score") < threshold(model, F.col("lang")))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
