"""Near-duplicate documents by ProbMinHash, banding and verification.

Shingles of five words arrive at a text's registers as Poisson processes, a shingle's rate being the number of times the
text has it: each arrival falls into a random register, and a register keeps the
shingle of its first arrival.  A shingle stops as soon as its next arrival comes later than every
register's first.  Two texts agree in a register with a chance that is the probability Jaccard similarity of their
weighted shingles.  A text with repeated shingles has a second sketch in which each counts once, whose registers agree with the chance
of the Jaccard similarity of sets; without repeats both are the same.  Bands of registers make buckets, of both sketches alike, so that
copies which differ in repeats meet too; every two texts that share one are verified on their
shingles: they are linked where either similarity is 0.8 or more.  Only pairs whose numbers of different
shingles rule it out, neither having repeats, aren't compared.  Linked texts make classes, named by the smallest doc_id.

No bucket is turned into all its pairs at once.  Exact copies are one text.  Then every text of a bucket
is compared with the bucket's head, and links are joined into components.  Only pairs of different
components remain: small buckets give them by a join, large ones by blocks, compared whole within a
task that gives nothing but links between components.  So no bucket is capped.

Cases: words are runs of non-white-space; a text of one to four words is one shingle; null, empty and
blank texts have no words and are copies of each other; very long texts are shingled whole; repeated rows are copies; a null doc_id
is grouped like others and names a class only where all its ids are null; an empty table gives an empty
result; of extra columns none are kept by ``classes``, and ``keep_one`` keeps all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, checkpoint, mix, slices, stash, table, unit, word_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Buckets of more texts than PAIRS are compared in blocks of up to some 4 x BLOCK texts.
PAIRS, BLOCK = 8, 64
SALTS = 8


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``words`` words, with repeats, and how many each text has."""
    h, counts = word_hashes(texts)
    with np.errstate(over="ignore"):
        starts = np.cumsum(counts) - counts
        n = np.maximum(counts - words + 1, np.minimum(counts, 1))
        first = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        sizes = np.repeat(np.minimum(counts, words), n)
        out = sizes.astype(np.uint64)
        for o in range(words):
            inside = o < sizes
            out = np.where(inside, mix(out * GOLDEN + h[np.minimum(first + o, max(len(h) - 1, 0))]) if len(h) else out, out)
    return out, n


def signatures(texts: pa.Array, registers: int, words: int = WORDS, weighted: bool = True) -> np.ndarray:
    """For each text, the shingle that each register keeps: texts x registers; 0 for texts without words."""
    return _signed(*shingles(texts, words), registers, weighted)


def _signed(h: np.ndarray, n: np.ndarray, registers: int, weighted: bool) -> np.ndarray:
    rows = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    bits = np.uint64(max(1, int(len(n) - 1).bit_length()))
    key = np.sort((rows << (np.uint64(64) - bits)) | (h >> bits))
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    rate = np.diff(np.append(np.flatnonzero(new), len(key))).astype(np.float64) if weighted else np.ones(int(new.sum()))
    key = key[new]
    row = (key >> (np.uint64(64) - bits)).astype(np.int64)
    shingle = key & ((np.uint64(1) << (np.uint64(64) - bits)) - np.uint64(1))
    # the same width whatever the batch, or equal texts would differ
    shingle = shingle >> (np.uint64(64 - 44) - bits)
    best = np.full(len(n) * registers, np.inf)
    kept = np.zeros(len(n) * registers, np.uint64)
    time = np.zeros(len(key))
    with np.errstate(over="ignore"):
        seed = mix(shingle + GOLDEN)
    alive, k = np.arange(len(key)), 0
    total = np.bincount(row, rate, minlength=len(n))
    # By this time all registers of nearly every text are taken; later arrivals wait until that is known.
    horizon = registers * (np.log(registers) + 4) / np.maximum(total, 1e-12)
    waiting = []
    while len(alive):
        with np.errstate(over="ignore"):
            draw = mix(seed[alive] + np.uint64(2 * k + 1) * GOLDEN)
            slot = mix(draw ^ GOLDEN) % np.uint64(registers)
        time[alive] += -np.log(unit(draw)) / rate[alive]
        soon = time[alive] <= horizon[row[alive]]
        if not soon.all():
            waiting.append((alive[~soon], slot[~soon], np.full((~soon).sum(), k)))
            alive, slot = alive[soon], slot[soon]
        where = row[alive] * registers + slot.astype(np.int64)
        _arrive(best, kept, where, time[alive], shingle[alive])
        worst = best.reshape(len(n), registers).max(1) if len(n) else best
        alive = alive[time[alive] < worst[row[alive]]]
        k += 1
    worst = best.reshape(len(n), registers).max(1)
    if waiting and not np.isfinite(worst[n > 0]).all():
        _rest(best, kept, waiting, time, rate, row, shingle, seed, registers)
    return kept.reshape(len(n), registers)


def _arrive(best: np.ndarray, kept: np.ndarray, where: np.ndarray, time: np.ndarray, shingle: np.ndarray) -> None:
    np.minimum.at(best, where, time)
    first = best[where] == time
    kept[where[first]] = shingle[first] + np.uint64(1)


def _rest(best, kept, waiting, time, rate, row, shingle, seed, registers) -> None:
    """Arrivals behind the horizon, of texts that still have empty registers."""
    alive, slot, k = (np.concatenate(x) for x in zip(*waiting, strict=True))
    open_ = ~np.isfinite(best.reshape(-1, registers).max(1))
    some = open_[row[alive]]
    alive, slot, k = alive[some], slot[some], k[some].astype(np.uint64)
    while len(alive):
        _arrive(best, kept, row[alive] * registers + slot.astype(np.int64), time[alive], shingle[alive])
        some = time[alive] < best.reshape(-1, registers).max(1)[row[alive]]
        alive, k = alive[some], k[some] + np.uint64(1)
        with np.errstate(over="ignore"):
            draw = mix(seed[alive] + (np.uint64(2) * k + np.uint64(1)) * GOLDEN)
            slot = mix(draw ^ GOLDEN) % np.uint64(registers)
        time[alive] += -np.log(unit(draw)) / rate[alive]


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(tid, text_key, doc_id, bands, size, repeats): each different text once, with its smallest doc_id.

    bands: buckets of its sketch, and of the one without weights if it repeats shingles; size counts its different shingles.
    """
    registers = bands * rows

    def buckets(sig: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            own = np.zeros((len(sig), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
            for o in range(rows):
                own = mix(own * GOLDEN + sig.reshape(len(sig), bands, rows)[:, :, o])
        return own

    @F.arrow_udf("struct<bands: array<long>, size: long, repeats: boolean>")
    def sketch(texts: pa.Array) -> pa.Array:
        keys, sizes, again = [], [], []
        for part in slices(texts):
            h, n = shingles(part)
            own = np.array([len(np.unique(x)) for x in np.split(h, np.cumsum(n)[:-1])], np.int64)
            plain, twice = buckets(_signed(h, n, registers, False)), own < n
            some = np.flatnonzero(twice)
            weighted = buckets(_signed(h[np.repeat(twice, n)], n[twice], registers, True))
            place = dict(zip(some.tolist(), range(len(some)), strict=True))
            keys += [np.union1d(x, weighted[place[i]]) if i in place else x for i, x in enumerate(plain)]
            sizes.append(own)
            again.append(twice)
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)))
        counts = [np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((sizes, np.int64), (again, bool))]
        return pa.StructArray.from_arrays([lists, *map(pa.array, counts)], ["bands", "size", "repeats"])

    keyed = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), sketch(F.coalesce(F.col(text), F.lit(""))).alias("s"))
    once = keyed.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("s").alias("s"))
    return stash(once.select(F.monotonically_increasing_id().alias("tid"), "text_key", "doc_id", "s.bands", "s.size", "s.repeats"))


def text_key(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def shingle_sets(docs: DataFrame, texts: DataFrame, tids: DataFrame, text: str) -> DataFrame:
    """(tid, set, counts): the sorted shingle hashes of the given texts, as bytes, and how often each occurs; no counts where all do once."""

    @F.arrow_udf("struct<set: binary, counts: binary>")
    def sets(column: pa.Array) -> pa.Array:
        out = []
        for part in slices(column):
            h, n = shingles(part)
            for x in np.split(h, np.cumsum(n)[:-1]):
                own, times = np.unique(x, return_counts=True)
                out.append((own.tobytes(), times.astype(np.int32).tobytes() if len(own) < len(x) else b""))
        return pa.StructArray.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["set", "counts"])

    wanted = texts.join(tids.distinct(), "tid").select("tid", F.col("text_key").alias("_key"), F.col("doc_id").alias("_doc"))
    # one row of each text: its smallest doc_id; rows that repeat it only repeat a set
    found = docs.join(wanted.hint("shuffle_hash"), (text_key(text) == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    return stash(found.select("tid", sets(F.coalesce(F.col(text), F.lit(""))).alias("s")).select("tid", "s.set", "s.counts"))


def set_similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays without repeats."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = (x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()
    return both / (len(x) + len(y) - both)


def probability_jaccard(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard similarity of sorted arrays x and y without repeats whose items weigh a and b.

    The sum, over common items d, of 1 / sum over all items e of max(a_e / a_d, b_e / b_d).  In the order of a / b those before d
    count by b and the others by a, so that sums from both ends give all of them.
    """
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    same = x[at] == y
    if not same.any():
        return 0.0
    u, v = a[at[same]].astype(np.float64), b[same].astype(np.float64)
    order = np.argsort(u / v, kind="stable")
    u, v = u[order], v[order]
    alone_a, alone_b = a.sum() - u.sum(), b.sum() - v.sum()
    by_a = np.cumsum(u[::-1])[::-1] + alone_a
    by_b = np.cumsum(v) - v + alone_b
    return float((1 / (by_a / u + by_b / v)).sum())


def similarity_of(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of both similarities of two texts, each (set, counts)."""
    plain = set_similarity(x[0], y[0])
    if not len(x[1]) and not len(y[1]):
        return plain
    weights = [c if len(c) else np.ones(len(s), np.int32) for s, c in (x, y)]
    return max(plain, probability_jaccard(x[0], y[0], *weights))


def _views(sets: pa.Array, counts: pa.Array):
    return ((np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.int32)) for s, c in zip(sets, counts, strict=True))


def similar(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b), a < b, those whose shingles are similar enough."""

    @F.arrow_udf("double")
    def jaccard(a: pa.Array, ca: pa.Array, b: pa.Array, cb: pa.Array) -> pa.Array:
        return pa.array([similarity_of(x, y) for x, y in zip(_views(a, ca), _views(b, cb), strict=True)], pa.float64())

    side = lambda t, s, c: sets.select(F.col("tid").alias(t), F.col("set").alias(s), F.col("counts").alias(c))
    both = pairs.join(side("a", "sa", "ca"), "a").join(side("b", "sb", "cb"), "b")
    return both.withColumn("j", jaccard("sa", "ca", "sb", "cb")).filter(F.col("j") >= similarity).select("a", "b").distinct()


def fits(a: str, b: str, repeats_a: str, repeats_b: str, similarity: float) -> Column:
    """Whether texts of so many different shingles can be similar enough: without repeats the smaller has at least that share of the larger."""
    return F.col(repeats_a) | F.col(repeats_b) | (F.least(a, b) + 1e-6 >= similarity * F.greatest(a, b))


def components(links: DataFrame) -> DataFrame:
    """(tid, label): the smallest tid that each linked tid is connected with, by pointer jumping in rounds.

    Every round each tid takes the smallest label among its neighbours' and its own, and then its label's label.
    """
    edges = checkpoint(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct().withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")))
    labels = checkpoint(edges.groupBy(F.col("a").alias("tid")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        # a tid with very many neighbours is dealt over salts
        far = labels.select(F.col("tid").alias("b"), "label", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        lead = edges.join(far, ["b", "salt"]).groupBy(F.col("a").alias("tid")).agg(F.min("label").alias("near"))
        step = labels.join(lead, "tid").select("tid", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("tid").alias("new"), F.col("label").alias("far"))
        after = checkpoint(step.join(jump, "new", "left").select("tid", F.least("new", F.coalesce("far", "new")).alias("new"), "label"))
        changed = after.filter("new <> label").limit(1).count()
        labels = after.select("tid", F.col("new").alias("label"))
        if not changed:
            return labels


def links(docs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """(tid, label): components of the texts that are linked."""
    banded = texts.select("tid", "size", "repeats", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stash(banded.join(shared, "bucket"))
    # A text that others were copied from shares the most buckets with the most texts; it leads its buckets.
    known = shared.groupBy("tid").agg(F.sum("n").alias("known"))
    led = stash(shared.join(known, "tid"))
    heads = led.groupBy("bucket").agg(F.max_by(F.struct("tid", "size", "repeats"), F.struct("known", -F.col("tid"))).alias("h"))
    heads = heads.select("bucket", F.col("h.tid").alias("head"), F.col("h.size").alias("head_size"), F.col("h.repeats").alias("head_repeats"))
    members = stash(led.select("tid", "size", "repeats", "bucket", "n").join(heads, "bucket"))
    stars = members.filter("tid <> head").filter(fits("size", "head_size", "repeats", "head_repeats", similarity)).select(F.least("head", "tid").alias("a"), F.greatest("head", "tid").alias("b")).distinct()
    near = checkpoint(stars)
    first = checkpoint(similar(shingle_sets(docs, texts, _ends(near), text), near, similarity))
    labels = components(first)
    # What the heads didn't settle: pairs of different components.
    labelled = members.join(labels, "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("bucket")
    open_ = checkpoint(labelled.join(mixed, "bucket"))
    small, large = open_.filter(F.col("n") <= PAIRS), open_.filter(F.col("n") > PAIRS)
    x = small.select("bucket", "label", F.col("tid").alias("a"), F.col("size").alias("size_a"), F.col("repeats").alias("repeats_a"))
    y = small.select("bucket", F.col("label").alias("other"), F.col("tid").alias("b"), F.col("size").alias("size_b"), F.col("repeats").alias("repeats_b"), "head")
    pairs = checkpoint(x.join(y, "bucket").filter("a < b AND label <> other AND a <> head AND b <> head").filter(fits("size_a", "size_b", "repeats_a", "repeats_b", similarity)).select("a", "b").distinct())
    sets = shingle_sets(docs, texts, _ends(pairs).union(large.select("tid")), text)
    second = similar(sets, pairs, similarity).union(_blocks(large, sets, similarity))
    return components(first.union(second))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("tid")).union(pairs.select(F.col("b").alias("tid")))


def _blocks(large: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between different components in large buckets.  A task compares two blocks and gives only links that join components."""
    blocks = F.ceil(F.col("n") / (4 * BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("tid"), blocks).cast("int")
    held = large.join(sets.groupBy("tid").agg(F.first(F.struct("set", "counts")).alias("s")).select("tid", "s.set", "s.counts"), "tid").withColumn("blocks", blocks).withColumn("own", own)
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "tid", "label", "set", "counts")

    def compare(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        own, tid, label = t["own"].to_numpy(), t["tid"].to_numpy(), t["label"].to_numpy().copy()
        sizes = np.array([len(x.as_buffer()) // 8 for x in t["set"]], np.int64)
        repeats = np.array([len(x.as_buffer()) > 0 for x in t["counts"]], bool)
        times = [np.frombuffer(x.as_buffer(), np.int32) if r else np.ones(m, np.int32) for x, r, m in zip(t["counts"], repeats, sizes, strict=True)]
        # shares of each text's weight; the chance to agree can't exceed the sum of the lesser shares of common shingles
        shares = np.insert(np.concatenate([np.zeros(0), *[x / max(x.sum(), 1) for x in times]]), np.cumsum(sizes) - sizes, 0.0)
        known, codes = np.unique(np.frombuffer(b"".join(x.as_buffer() for x in t["set"]), np.uint64), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        held, weight = np.zeros(len(known) + 1, np.int32), np.zeros(len(known) + 1)
        # each set's codes, and one that no set has: so that a set without shingles has a sum too
        padded = np.insert(codes, starts, len(known))
        starts = starts + np.arange(len(sizes))
        left, right = np.flatnonzero(own == i), own == j
        out = []
        for r in left:
            near = np.minimum(sizes, sizes[r]) + 1e-6 >= similarity * np.maximum(sizes, sizes[r])
            rest = right & (label != label[r]) & ((tid > tid[r]) | (i != j)) & (near | repeats | repeats[r])
            if not rest.any():
                continue
            mine = codes[starts[r] - r : starts[r] - r + sizes[r]]
            held[mine] = 1
            both = np.add.reduceat(held[padded], starts)
            held[mine] = 0
            all_ = sizes + sizes[r] - both
            alike = np.where(all_ > 0, both / np.maximum(all_, 1), 1.0) >= similarity
            weight[mine] = shares[starts[r] + 1 : starts[r] + 1 + sizes[r]]
            may = rest & ~alike & (repeats | repeats[r]) & (np.add.reduceat(np.minimum(weight[padded], shares), starts) + 1e-9 >= similarity)
            weight[mine] = 0
            for o in np.flatnonzero(rest & (alike | may)):
                if label[o] != label[r] and (alike[o] or probability_jaccard(mine, codes[starts[o] - o : starts[o] - o + sizes[o]], times[r], times[o]) >= similarity):
                    out.append((min(tid[r], tid[o]), max(tid[r], tid[o])))
                    label[label == label[o]] = label[r]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def _classes(docs: DataFrame, similarity: float, text: str) -> DataFrame:
    """(text_key, class_id, first_id): of each different text, its class and whether it is the text that the class keeps."""
    texts = sketches(docs, text=text)
    named = texts.select("tid", "text_key", "doc_id").join(links(docs, texts, similarity, text), "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    named = stash(named)
    best = named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min_by("tid", F.struct(F.col("doc_id").isNull(), "doc_id", "tid")).alias("kept"))
    return named.join(best, "label").select("text_key", "doc_id", "class_id", (F.col("tid") == F.col("kept")).alias("kept"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id), one row for each row of docs; class_id is the smallest doc_id of the class."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    named = _classes(rows, similarity, "text").select(F.col("text_key").alias("_key"), "class_id")
    return rows.select("doc_id", text_key("text").alias("text_key")).join(named, F.col("text_key") == F.col("_key")).select("doc_id", "class_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """One row of docs for each class: that of the smallest doc_id; of its repeated rows any one."""
    named = _classes(docs.select("doc_id", F.col(text).alias("text")), similarity, "text").filter("kept").select(F.col("text_key").alias("_key"), F.col("doc_id").alias("_doc"))
    # the input row as one column, so that its names can't clash with those used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(text).alias("key"), F.col("doc_id").alias("id"))
    kept = rows.join(named.hint("shuffle_hash"), (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_doc"))).select("row", "key")
    # rows that repeat both doc_id and text
    again = kept.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("again"))
    held = kept.join(again, F.col("key") == F.col("again"), "left")
    one = held.filter("again IS NULL").select("row").unionByName(held.filter("again IS NOT NULL").dropDuplicates(["key"]).select("row"))
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)
