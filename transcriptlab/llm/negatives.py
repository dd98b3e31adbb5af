"""Hard negatives of embeddings, by coordinate pruning over buckets of like length.

Vectors lie in buckets by their length, and buckets of many in several shards.  A shard is written with its longest length and, for
each coordinate, its unit vectors' values there in order with their places.  An anchor goes to a shard only
if its length times the shard's longest reaches the score it needs.  That score over both lengths is the least cosine t; then the angle
to an axis can't differ by more than acos(t), which gives a feasible range of values for each of the anchor's FOCUS
largest coordinates.  The shortest of these ranges in the lists gives candidates, the other ranges thin them out, and
what is left is scored exactly.

Positives come first: the anchor's best rows of its own label.  Each positive's score sets a window of scores for negatives, whose
lower end is what a negative needs.  In both searches an anchor first meets one shard of its longest bucket; the kth score found there
is what the others have to reach.

Cases: rows without a label or vec_id, and vectors that are null, empty, or hold null or non-finite components take no part; rows
that repeat a vec_id are rows of their own; ties go to the smaller vec_id; vectors of different lengths don't meet; a positive of
score 0 has negatives of score 0 and one below 0 has none; fewer rows than asked for give fewer; an anchor without positives gives
nothing; zero vectors score 0 with all; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, stash, table
from .vectors import matrix, usable

#: Coordinates whose ranges are used; rows of a shard and anchors of a block; buckets of one number of dimensions, at most.
FOCUS, SHARD, BLOCK, BUCKETS = 5, 8192, 1024, 64
SLACK = 1e-9
FOUND = "q long, slot int, vec_id long, rid long, score double"


@dataclass(frozen=True)
class Lists:
    """Rows of a shard by (vec_id, rid); ``order[f]`` and ``values[f]``: places and values of coordinate f, values ascending."""

    ids: np.ndarray
    rids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    unit: np.ndarray
    longest: float
    order: np.ndarray
    values: np.ndarray


def coordinate_lists(ids: np.ndarray, rids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> Lists:
    by = np.lexsort((rids, ids))
    ids, rids, labels, x = ids[by], rids[by], labels[by], x[by]
    size = np.sqrt((x * x).sum(1))
    unit = x / np.where(size > 0, size, 1)[:, None]
    order = np.argsort(unit, axis=0, kind="stable").T.astype(np.int32)
    return Lists(ids, rids, labels, x, unit, float(size.max(initial=0)), order, np.take_along_axis(unit.T, order, 1))


def feasible(q: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value in each coordinate of a unit vector whose product with the unit vector q is no less than the cosine."""
    a, b = np.arccos(np.clip(q, -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    return np.cos(np.minimum(a + b, np.pi)) - SLACK, np.cos(np.maximum(a - b, 0)) + SLACK


def candidates(lists: Lists, q: np.ndarray, least: float, focus: int = FOCUS) -> np.ndarray:
    """Places of all rows that may have a product with q of at least ``least``, in order."""
    size = float(np.sqrt(q @ q))
    reach = size * lists.longest
    if least > reach * (1 + SLACK):
        return np.zeros(0, np.int64)
    if least <= 0 or not reach:
        return np.arange(len(lists.ids))
    u = q / size
    top = np.argsort(-np.abs(u), kind="stable")[:focus]
    low, high = feasible(u[top], least / reach * (1 - SLACK))
    ends = [(np.searchsorted(lists.values[f], lo, side="left"), np.searchsorted(lists.values[f], hi, side="right")) for f, lo, hi in zip(top, low, high, strict=True)]
    first = int(np.argmin([stop - start for start, stop in ends]))
    found = np.sort(lists.order[top[first], ends[first][0] : ends[first][1]].astype(np.int64))
    for i, f in enumerate(top):
        if i != first and ends[i][1] - ends[i][0] < len(lists.ids):
            own = lists.unit[found, f]
            found = found[(own >= low[i]) & (own <= high[i])]
    return found


def best_positives(lists: Lists, q: np.ndarray, own: int, label: int, k: int, floor: float, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best other rows of the label that reach the floor."""
    some = candidates(lists, q, floor)
    if seen is not None:
        seen.append(len(some))
    some = some[(lists.labels[some] == label) & (lists.rids[some] != own)]
    scores = lists.x[some] @ q
    some, scores = some[scores >= floor], scores[scores >= floor]
    by = np.argsort(-scores, kind="stable")[:k]
    return some[by], scores[by]


def best_negatives(lists: Lists, q: np.ndarray, label: int, k: int, low: np.ndarray, high: np.ndarray, floors: np.ndarray, seen: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (low, high) of scores the k best rows of other labels in it that reach its floor."""
    least = np.maximum(low, floors)
    some = candidates(lists, q, float(least.min()))
    if seen is not None:
        seen.append(len(some))
    some = some[lists.labels[some] != label]
    scores = lists.x[some] @ q
    by = np.argsort(-scores, kind="stable")
    some, scores = some[by], scores[by]
    start, stop = np.searchsorted(-scores, -high, side="left"), np.searchsorted(-scores, -least, side="right")
    return [(some[i : min(j, i + k)], scores[i : min(j, i + k)]) for i, j in zip(start, np.maximum(start, stop), strict=True)]


def labelled(rows: DataFrame, scale: int = 256, noise: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, v): usable rows of (vec_id, embedding, label); components as floor(scale * x), every ``noise``-th label moved by one."""
    x = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
    x = x.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("v", True))
    moved = F.when(F.col("vec_id") % noise == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return x.select("vec_id", moved.alias("label"), F.transform("v", lambda c: F.floor(c * scale).cast("double")).alias("v"))


def length(v: str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda n, c: n + c * c))


def index(rows: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """(dim, bucket, salt, longest, lists): a written row for each shard of rows (rid, vec_id, label, v)."""
    sized = rows.select("*", F.size("v").alias("dim"), length("v").alias("size"))
    counts = {r["dim"]: r["n"] for r in sized.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    wanted = {d: min(BUCKETS, -(-n // shard_rows)) for d, n in counts.items()}
    most = max(wanted.values(), default=1)
    # lengths at which buckets end, of each number of dimensions; the shards are right whatever they are
    cut = sized.groupBy("dim").agg(F.percentile_approx("size", [i / most for i in range(1, most)] or [0.5], 1000).alias("cuts"))
    cuts = {r["dim"]: sorted({r["cuts"][round(most * i / wanted[r["dim"]]) - 1] for i in range(1, wanted[r["dim"]])}) for r in cut.collect()}
    bucket = F.lit(0)
    for d, ends in cuts.items():
        bucket = F.when(F.col("dim") == d, sum((F.col("size") > c).cast("int") for c in ends) if ends else F.lit(0)).otherwise(bucket)
    placed = sized.withColumn("bucket", bucket.cast("int"))
    salts = placed.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("salts"))
    dealt = placed.join(F.broadcast(salts), ["dim", "bucket"])  # at most BUCKETS rows for each number of dimensions
    dealt = dealt.select("rid", "vec_id", "label", "v", "dim", "bucket", F.pmod(F.xxhash64("rid"), "salts").cast("int").alias("salt"))

    def build(t: pa.Table) -> pa.Table:
        own = coordinate_lists(t["vec_id"].to_numpy(), t["rid"].to_numpy(), t["label"].to_numpy(), matrix(t["v"]))
        key = {c: pa.array([t[c][0].as_py()], pa.int32()) for c in ("dim", "bucket", "salt")}
        return pa.table(key | {"longest": pa.array([own.longest]), "lists": pa.array([pickle.dumps(own, protocol=5)], pa.binary())})

    return stash(dealt.groupBy("dim", "bucket", "salt").applyInArrow(build, "dim int, bucket int, salt int, longest double, lists binary"))


def met(asked: DataFrame, shards: DataFrame, find: Any, block_rows: int = BLOCK) -> DataFrame:
    """Rows of FOUND: asked (q, dim, bucket, salt, ...) held against their shards, a block of anchors and a shard in each task.

    ``find(lists, row)`` gives (slot, places, scores) for a row of asked as a dict, its vector as an array.
    """
    by = ["dim", "bucket", "salt"]
    sizes = asked.groupBy(*by).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    needed = shards.join(sizes, by).select(*by, "lists", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    blocks = asked.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("q"), "blocks").cast("int")).drop("blocks")

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [np.zeros(0)] for c in ("q", "slot", "vec_id", "rid", "score")}
        if left.num_rows and right.num_rows:
            lists = pickle.loads(right["lists"][0].as_py())
            for row, v in zip(left.drop(["v"]).to_pylist(), matrix(left["v"]), strict=True):
                for slot, places, scores in find(lists, row | {"v": v}):
                    n = len(places)
                    for c, x in zip(out, (np.full(n, row["q"]), np.full(n, slot), lists.ids[places], lists.rids[places], scores), strict=True):
                        out[c].append(x)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({c: pa.array(np.concatenate(x).astype(kind.to_pandas_dtype()), kind) for (c, x), kind in zip(out.items(), kinds, strict=True)})

    by.append("block")
    return blocks.groupBy(*by).cogroup(needed.groupBy(*by)).applyInArrow(task, FOUND)


def ways(asked: DataFrame, stats: DataFrame, first: bool) -> DataFrame:
    """asked with (bucket, salt) of its first shard, or of all others whose longest length lets it reach its column ``least``."""
    held = asked.join(F.broadcast(stats), "dim")  # at most BUCKETS rows for each number of dimensions
    home = (F.col("bucket") == F.col("home")) & (F.col("salt") == F.pmod(F.xxhash64("q"), "salts").cast("int"))
    far = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    reach = F.col("size") * F.col("longest") * (1 + SLACK) >= F.col("least")
    return far.filter(home if first else reach & ~home).drop("salts", "longest", "home")


def ranked(found: DataFrame, k: int, by: list[str]) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, v), v whole numbers.

    For each anchor and each of its best positives: the best rows of another label with
    low * positive score <= 100 * negative score <= high * positive score.
    """
    kept = checkpoint(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "v"))
    shards = index(kept, shard_rows)
    stats = checkpoint(shards.groupBy("dim", "bucket").agg(F.count("*").cast("int").alias("salts"), F.max("longest").alias("longest")))
    stats = stats.withColumn("home", F.max("bucket").over(Window.partitionBy("dim")))
    anchors = checkpoint(kept.filter(anchor).select(F.col("rid").alias("q"), F.col("vec_id").alias("anchor_id"), "label", "v", F.size("v").alias("dim"), length("v").alias("size")))
    none = float("-inf")

    def positive(lists: Lists, row: dict) -> list:
        return [(0, *best_positives(lists, row["v"], row["q"], row["label"], positives, row["least"]))]

    near = checkpoint(met(ways(anchors.withColumn("least", F.lit(none)), stats, True), shards, positive, block_rows))
    floor = near.groupBy("q").agg(F.when(F.count("*") >= positives, F.min("score")).alias("least"))
    limited = anchors.join(floor, "q", "left").withColumn("least", F.coalesce("least", F.lit(none)))
    found = near.unionByName(met(ways(limited, stats, False), shards, positive, block_rows))
    best = checkpoint(ranked(found, positives, ["q"]).select("q", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    windows = best.filter("positive_score >= 0").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("windows"))
    mined = anchors.join(windows, "q")

    def negative(lists: Lists, row: dict) -> list:
        score = np.array([w["positive_score"] for w in row["windows"]])
        floors = np.array(row.get("floors") or [none] * len(score))
        got = best_negatives(lists, row["v"], row["label"], negatives, np.ceil(low * score / 100 - SLACK), np.floor(high * score / 100 + SLACK), floors)
        return [(w["slot"], *g) for w, g in zip(row["windows"], got, strict=True)]

    least = F.array_min(F.transform("windows", lambda w: F.ceil(w["positive_score"] * low / 100 - SLACK).cast("double")))
    near = checkpoint(met(ways(mined.withColumn("least", least), stats, True), shards, negative, block_rows))
    full = near.groupBy("q", "slot").agg(F.when(F.count("*") >= negatives, F.min("score")).alias("floor"))
    by_anchor = full.filter("floor IS NOT NULL").groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("slot", "floor"))).alias("full"))
    rest = mined.join(by_anchor, "q", "left").withColumn("floors", F.transform("windows", lambda w: F.greatest(F.ceil(w["positive_score"] * low / 100 - SLACK).cast("double"), F.coalesce(F.try_element_at("full", w["slot"]), F.lit(none)))))
    rest = rest.withColumn("least", F.array_min("floors")).drop("full")
    found = near.unionByName(met(ways(rest, stats, False), shards, negative, block_rows))
    taken = ranked(found, negatives, ["q", "slot"]).select("q", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").cast("long").alias("negative_score"))
    out = taken.join(best, ["q", "slot"]).join(anchors.select("q", "anchor_id"), "q")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("positive_score").cast("long").alias("positive_score"), "negative_score")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(labelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(CAST(c AS DOUBLE) * 256)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.rid AS q, a.vec_id AS anchor_id, a.label = b.label AS same, b.rid, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.rid <> b.rid AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT q, anchor_id, rid AS prid, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, rid) <= 5
)
SELECT * FROM (
  SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.q, p.prid ORDER BY s.score DESC, s.vec_id, s.rid) AS INTEGER) AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.q = p.q AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
) WHERE rank <= 10
"""
