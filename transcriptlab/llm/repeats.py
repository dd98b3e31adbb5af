"""Repeated byte strings, found with a sparse suffix array.

A string of SPAN bytes is judged by every place it starts at.  Its anchor is the run of GRAM bytes within it whose hash is least,
the leftmost on ties: equal strings have equal anchors at equal offsets, and consecutive strings mostly share one, so that only
one suffix in some fifty has to be sorted.  Suffixes whose leading GRAM bytes stand nowhere else can't repeat and go first, after one count.

What is left is range-partitioned by leading bytes between sampled splitters.  A bucket sorts its suffixes by multikey
quicksort, eight bytes a key, and what stands before each anchor likewise, read backwards; neighbours in both
orders give the lengths of common bytes.  Two strings with offset o to the anchor are equal where suffixes share SPAN - o bytes onwards
and o bytes backwards.  Bytes are compared, not their hashes.

Splitters lie between runs of GRAM bytes, so that suffixes on both sides of one differ within these and no comparison across a
boundary can find anything.  A run that more than LIMIT suffixes begin with would make a bucket too large: such a run is dealt by
ranges of offsets, down to single ones, and then by the string itself; equal strings of one batch go on as one.

Cases: a null text is empty; texts shorter than SPAN bytes have no string; repeated rows and copies repeat each other; a text of one byte
over and over repeats itself; a null doc_id is one like others; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, mix, slices, stash, table

SPAN, GRAM = 200, 96
#: Suffixes of one bucket, and of one run of bytes before it is dealt by offsets.
BUCKET, LIMIT = 16_384, 4_096
#: Shared runs that are broadcast; where there are more, they are joined.
BROADCAST_GRAMS = 2_000_000
#: Shared runs that splitters are drawn from.
SAMPLE = 20_000
#: Suffixes that a task holds as matrices at once, unless one run of bytes has more.
CHUNK = 8_192

PLACE = np.uint64((1 << 31) - 1)
INTERVAL = "doc_id long, key binary, start long, end long"
BUNDLE = "bucket int, part int, deal int, gram long, doc_id long, key binary, at long, offset int, n int, data binary"


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins, with the end of the last."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def anchors(data: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """For every run of strings of one text with one anchor: text, hash and place of the anchor, first and last start of a string; places in ``data``."""
    none = np.zeros(0, np.int64)
    if len(data) < span:
        return none, none.view(np.uint64), none, none, none
    with np.errstate(over="ignore"):
        h = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)[data]
        done, size, whole = 0, 1, None
        rest = gram
        while rest:  # the hash of a run from those of runs of powers of two
            if rest & 1:
                part = h[done:]
                whole = part.copy() if whole is None else whole[: len(part)] * GOLDEN + part[: len(whole)]
                whole ^= whole >> np.uint64(31)
                done += size
            rest >>= 1
            if rest:
                h = h[:-size] * GOLDEN + h[size:]
                h ^= h >> np.uint64(29)
                size *= 2
        whole = mix(whole[: len(data) - gram + 1])
    least = (whole & ~PLACE) | np.arange(len(whole), dtype=np.uint64)
    width, size = span - gram + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(data) - span + 1], least[width - size : width - size + len(data) - span + 1])
    place = (least & PLACE).astype(np.int64)
    lengths = np.diff(ends)
    inside = np.zeros(len(data) + 1, np.int8)
    some = np.flatnonzero(lengths >= span)
    np.add.at(inside, ends[some], 1)
    np.add.at(inside, ends[some] + lengths[some] - span + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[: len(place)], dtype=np.int8))
    if not len(starts):
        return none, none.view(np.uint64), none, none, none
    place = place[starts]
    new = np.append(True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    at = place[first]
    return np.searchsorted(ends, at, side="right") - 1, whole[at], at, starts[first], starts[last]


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first eight bytes at each place, as a number in the order of the bytes."""
    return np.ascontiguousarray(data[at[:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch["text"], 500_000):
            data, ends = flat(part)
            _, gram, at, _, _ = anchors(data, ends)
            yield pa.record_batch({"gram": pa.array(gram.view(np.int64)), "lead": pa.array(signed(leading(data, at)))})


def shared_grams(docs: DataFrame) -> DataFrame:
    """(gram, lead, n): runs of bytes that are anchors at least twice, with their first eight bytes."""
    found = docs.select("text").mapInArrow(gram_rows, "gram long, lead long")
    return stash(found.groupBy("gram").agg(F.count("*").alias("n"), F.min("lead").alias("lead")).filter("n > 1"))


def splitters(shared: DataFrame, suffixes: int, grams: int) -> list[tuple[int, int]]:
    """(lead, gram) at which buckets begin, from a sample of the shared runs by the hash of each, so that buckets hold like numbers of suffixes."""
    buckets = -(-suffixes // BUCKET)
    if buckets < 2:
        return []
    share = min(1.0, SAMPLE / grams)
    drawn = shared.filter(F.pmod(F.xxhash64("gram"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("lead", "gram", F.least("n", F.lit(LIMIT)).alias("n")).toPandas()
    drawn = drawn.sort_values(["lead", "gram"])
    weight = drawn["n"].cumsum().to_numpy()
    if not len(weight):
        return []
    cuts = np.unique(np.searchsorted(weight, weight[-1] * np.arange(1, buckets) / buckets, side="right"))
    return [(int(drawn["lead"].iloc[i]), int(drawn["gram"].iloc[i])) for i in cuts if i < len(drawn)]


def parts_of(n: np.ndarray, limit: int, width: int = SPAN - GRAM + 1) -> np.ndarray:
    """Offsets that one part of a run with n suffixes covers: all, or as many as keep the parts within the limit, one at least."""
    return np.maximum(width // np.maximum(-(-n // limit), 1), 1)


def bundles(data: np.ndarray, text: np.ndarray, gram: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, ends: np.ndarray, cuts: tuple, limit: int) -> dict[str, np.ndarray | list]:
    """The suffixes to sort: the bytes of the strings of each anchor, one row for each range of offsets.  n: how often the run occurs."""
    step = parts_of(n, limit)
    first, last = (at - high) // step, (at - low) // step
    count = last - first + 1
    row = np.repeat(np.arange(len(at)), count)
    part = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    step = step[row]
    start = np.maximum(low[row], at[row] - (part + 1) * step + 1)
    stop = np.minimum(high[row], at[row] - part * step)
    whole = data.tobytes()
    cut = [whole[s : e + SPAN] for s, e in zip(start.tolist(), stop.tolist(), strict=True)]
    leads, grams = cuts
    lead, own = signed(leading(data, at)), gram.view(np.int64)
    bucket = np.searchsorted(leads, lead, side="left")
    after = np.searchsorted(leads, lead, side="right")
    for i in np.flatnonzero(after > bucket):  # splitters with the same first bytes
        bucket[i] += int(np.searchsorted(grams[bucket[i] : after[i]], own[i], side="right"))
    single = (n[row] > limit) & (step == 1)
    deal = np.zeros(len(row), np.int64)
    for i in np.flatnonzero(single):
        deal[i] = int.from_bytes(hashlib.blake2b(cut[i], digest_size=4).digest(), "big") % -(-int(n[row[i]]) // (limit * (SPAN - GRAM + 1)))
    return {"bucket": bucket[row], "part": part, "deal": deal, "gram": own[row], "text": text[row], "at": start - ends[text[row]], "offset": at[row] - start, "n": stop - start + 1, "data": cut, "single": single}


def combined(b: dict) -> tuple[np.ndarray, np.ndarray]:
    """Rows that go on, and rows known to repeat: of equal single strings in a batch the first goes on and all repeat."""
    keep = np.ones(len(b["at"]), bool)
    known = np.zeros(len(b["at"]), bool)
    seen: dict[tuple, int] = {}
    for i in np.flatnonzero(b["single"]):
        own = (b["gram"][i], b["part"][i], b["data"][i])
        if own in seen:
            keep[i], known[i], known[seen[own]] = False, True, True
        else:
            seen[own] = i
    return keep, known


def _emit(b: dict, doc_id: pa.Array, key: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of BUNDLE; a row with a null data is an interval that is known to repeat."""
    keep, known = combined(b)
    order = np.concatenate([np.flatnonzero(keep), np.flatnonzero(known)])
    data = [b["data"][i] for i in np.flatnonzero(keep)] + [None] * int(known.sum())
    text = pa.array(b["text"][order])
    ints = {c: pa.array(b[c][order].astype(np.int32)) for c in ("bucket", "part", "deal", "offset", "n")}
    out = {"bucket": ints["bucket"], "part": ints["part"], "deal": ints["deal"], "gram": pa.array(b["gram"][order]), "doc_id": doc_id.take(text), "key": key.take(text), "at": pa.array(b["at"][order]), "offset": ints["offset"], "n": ints["n"], "data": pa.array(data, pa.binary())}
    yield pa.record_batch(out)


def suffixes(docs: DataFrame, limit: int = LIMIT, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """Rows of BUNDLE of all anchors of docs (doc_id, key, text) that are shared."""
    shared = shared_grams(docs)
    total = shared.agg(F.count("*").alias("grams"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    at = splitters(shared, total["n"], max(total["grams"], 1))
    sc = docs.sparkSession.sparkContext
    cuts = sc.broadcast((np.array([x for x, _ in at], np.int64), np.array([y for _, y in at], np.int64)))

    if total["grams"] <= broadcast_grams:
        known = shared.select("gram", "n").toArrow()
        order = np.argsort(known["gram"].to_numpy())
        held = sc.broadcast((known["gram"].to_numpy()[order], known["n"].to_numpy()[order].astype(np.int64)))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams, counts = held.value
            for batch in batches:
                done = 0
                for part in slices(batch["text"], 500_000):
                    data, ends = flat(part)
                    text, gram, place, low, high = anchors(data, ends)
                    where = np.minimum(np.searchsorted(grams, gram.view(np.int64)), max(len(grams) - 1, 0))
                    some = grams[where] == gram.view(np.int64) if len(grams) else np.zeros(len(gram), bool)
                    if some.any():
                        found = bundles(data, text[some], gram[some], place[some], low[some], high[some], counts[where[some]], ends, cuts.value, limit)
                        yield from _emit(found, batch["doc_id"].slice(done, len(part)), batch["key"].slice(done, len(part)))
                    done += len(part)

        return docs.mapInArrow(cut, BUNDLE)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch["text"], 500_000):
                data, ends = flat(part)
                text, gram, place, low, high = anchors(data, ends)
                own, base = pa.array(text + done), ends[text]
                yield pa.record_batch({"gram": pa.array(gram.view(np.int64)), "doc_id": batch["doc_id"].take(own), "key": batch["key"].take(own), "place": pa.array(place - base), "low": pa.array(low - base), "high": pa.array(high - base)})
                done += len(part)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch["text"], 500_000):
                data, ends = flat(part)
                lists = batch["anchors"].slice(done, len(part))
                rows, text = lists.flatten(), np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
                f = {c: rows.field(c).to_numpy() for c in ("gram", "place", "low", "high", "n")}
                base = ends[text]
                found = bundles(data, text, f["gram"].view(np.uint64), f["place"] + base, f["low"] + base, f["high"] + base, f["n"], ends, cuts.value, limit)
                yield from _emit(found, batch["doc_id"].slice(done, len(part)), batch["key"].slice(done, len(part)))
                done += len(part)

    rows = docs.mapInArrow(places, "gram long, doc_id long, key binary, place long, low long, high long").join(shared.select("gram", "n"), "gram")
    # one list for each text; a row that repeats another has the same anchors and takes its list
    lists = rows.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_set(F.struct("gram", "place", "low", "high", "n")).alias("anchors"))
    held = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")))
    return held.select("doc_id", "key", "text", "anchors").mapInArrow(joined, BUNDLE)


def multikey(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of rows by group and then by their keys: each level sorts by one key what all before it left tied."""
    order = np.argsort(group, kind="stable")
    cls = group[order]
    tied = np.arange(len(order))
    for level in range(keys.shape[1]):
        same = np.append(False, cls[1:] == cls[:-1])
        tied = np.flatnonzero(same | np.append(same[1:], False))
        if not len(tied):
            break
        rows = order[tied]
        key = keys[rows, level]
        by = np.lexsort((key, cls[tied]))
        order[tied] = rows[by]
        key, own = key[by], cls[tied]
        new = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))
        cls = cls.copy()
        cls[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))] + len(order) * (level + 1)
    return order


def common(sides: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each row in that order the number of leading bytes it shares with the row before it; -1 where that is of another group."""
    a, b = sides[order[1:]], sides[order[:-1]]
    differ = a != b
    n = np.where(differ.any(1), differ.argmax(1), sides.shape[1])
    return np.append(-1, np.where(group[order[1:]] == group[order[:-1]], n, -1))


def _padded(whole: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of ``width`` bytes from each start on, forwards or backwards; zeros behind its size."""
    o = np.arange(width)
    places = np.clip(start[:, None] + step * o, 0, max(len(whole) - 1, 0))
    return np.where(o < size[:, None], whole[places], 0).astype(np.uint8) if len(whole) else np.zeros((len(start), width), np.uint8)


def repeated(group: np.ndarray, whole: np.ndarray, begin: np.ndarray, offset: np.ndarray, n: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last): runs of the strings of each row that stand elsewhere in its group too.

    A row's bytes begin at ``begin`` of ``whole``; its n strings start at the first n of them, the first with that offset to the anchor.
    """
    least = offset - n + 1
    wide, back = span - int(least.min()), int(offset.max())
    wide, back = -(-wide // 8) * 8, max(-(-back // 8) * 8, 8)
    right = _padded(whole, begin + offset, span - least, wide, 1)
    left = _padded(whole, begin + offset - 1, offset, back, -1)
    m = len(group)
    orders, shares = [], []
    for side in (right, left):
        order = multikey(np.ascontiguousarray(side).view(">u8"), group)
        orders.append(order)
        shares.append(common(side, order, group))
    width = int(n.max())
    flags = np.zeros((m, width + 2), bool)
    cls = [np.empty(m, np.int64), np.empty(m, np.int64)]
    for o in range(int(least.min()), int(offset.max()) + 1):
        some = np.flatnonzero((least <= o) & (o <= offset))
        if len(some) < 2:
            continue
        for c, order, share, need in zip(cls, orders, shares, (span - o, o), strict=True):
            c[order] = np.cumsum(share < need)
        key = cls[0][some] * (m + 1) + cls[1][some]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        both = np.append(same, False) | np.append(False, same)
        rows = some[by[both]]
        flags[rows, offset[rows] - o + 1] = True
    change = flags[:, 1:].astype(np.int8) - flags[:, :-1]
    row, first = np.nonzero(change == 1)
    _, last = np.nonzero(change == -1)
    return row, first, last - 1


def _bucket(t: pa.Table) -> pa.Table:
    """The repeated intervals of one bucket."""
    gram = t["gram"].to_numpy()
    by = np.argsort(gram, kind="stable")
    edges = np.append(np.flatnonzero(np.append(True, gram[by][1:] != gram[by][:-1])), len(by))
    out = {c: [] for c in ("row", "start", "end")}
    i = 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + CHUNK, side="right")) - 1)
        rows = by[edges[i] : edges[j]]
        data, ends = flat(t["data"].take(pa.array(rows)))
        row, first, last = repeated(gram[rows], data, ends[:-1], t["offset"].to_numpy()[rows].astype(np.int64), t["n"].to_numpy()[rows].astype(np.int64))
        at = t["at"].to_numpy()[rows][row]
        for c, x in zip(out, (rows[row], at + first, at + last + SPAN), strict=True):
            out[c].append(x)
        i = j
    row = pa.array(np.concatenate(out["row"]))
    return pa.table({"doc_id": t["doc_id"].take(row), "key": t["key"].take(row), "start": pa.array(np.concatenate(out["start"])), "end": pa.array(np.concatenate(out["end"]))})


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def repeated_spans(docs: DataFrame, limit: int = LIMIT, broadcast_grams: int = BROADCAST_GRAMS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, spans): bytes of each text that a repeated string covers, as disjoint (start, end) in order; key is the text's MD5."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    found = stash(suffixes(rows, limit, broadcast_grams))
    sorted_ = found.filter("data IS NOT NULL").groupBy("bucket", "part", "deal").applyInArrow(_bucket, INTERVAL)
    known = found.filter("data IS NULL").select("doc_id", "key", F.col("at").alias("start"), (F.col("at") + F.col("n") + SPAN - 1).alias("end"))

    @F.arrow_udf("array<struct<start: long, end: long>>")
    def merged(lists: pa.Array) -> pa.Array:
        out = []
        for spans in lists:
            own: list[list[int]] = []
            for start, end in sorted((s["start"].as_py(), s["end"].as_py()) for s in spans):
                if own and start <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], end)
                else:
                    own.append([start, end])
            out.append([{"start": s, "end": e} for s, e in own])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

    covered = sorted_.unionByName(known).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return covered.select("doc_id", "key", merged("spans").alias("spans"))


def without_repeats(docs: DataFrame, limit: int = LIMIT, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): for each row of docs its size, what is removed, and the bytes that remain."""
    spans = repeated_spans(docs, limit, broadcast_grams).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "spans")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text"))
    held = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")

    @F.arrow_udf("binary")
    def rest(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(pc.fill_null(text.cast(pa.large_binary()), b""), spans.to_pylist(), strict=True):
            b, at, kept = t.as_py(), 0, []
            for s in own or ():
                kept.append(b[at : s["start"]])
                at = s["end"]
            out.append(b"".join([*kept, b[at:]]))
        return pa.array(out, pa.binary())

    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return held.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce("spans", none).alias("spans"), rest("text", "spans").alias("kept"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
