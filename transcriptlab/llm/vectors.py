"""What both vector searches share: which vectors take part, the index of trees, and the ways of queries through it.

Data lies in cells around pivots, which come from a bounded sample; every vector is in the cell of its nearest pivot, and
cells of many vectors in several shards.  Each shard's tree is built once and written.  A query first searches one shard of
its own cell, which gives it a kth score; then only the cells that can hold something better, by their
covering radius, are searched, a block of queries and a shard in each task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, stash

#: Vectors of each length that pivots are chosen from, about, and pivots of each length, at most: what is broadcast doesn't grow with the data.
SAMPLE, PIVOTS = 4096, 512
KEY = ("dim", "pivot", "salt")


@dataclass(frozen=True)
class Method:
    """A tree, its search and a bound of cells; scores are better if larger.

    ``build(x)`` makes the tree of an array; ``find(tree, x, ids, rids, q, own, k, floor)`` gives places of queries, places
    in x and scores, of each query's k best rows that aren't its own (``own`` and ``rids`` number rows) and not below its floor;
    ``bound(q, centres, radii, norms)`` is an array, queries x cells, that no score within a cell exceeds.
    """

    build: Callable[[np.ndarray], Any]
    find: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]
    bound: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def usable(v: str, zero: bool) -> Column:
    """Vectors without null or non-finite components; with ``zero`` False, not those of zeros alone."""
    x = F.col(v)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    some = F.lit(True) if zero else F.exists(x, lambda c: c != 0)
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(some, F.lit(False))


def vectors(table: DataFrame, zero: bool, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(rid, vec_id, v): usable vectors, one row for each row of the table; rid numbers them."""
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable("v", zero))
    return checkpoint(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v"))


def matrix(v: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as an array."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def by_length(v: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of list its places and their array."""
    sizes = v.value_lengths().to_numpy()
    out = []
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        out.append((at, matrix(v.take(pa.array(at)))))
    return out


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of a and of b, up to rounding."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def exact_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances from differences, so that their error is a part in 10**12 of them however large the vectors are."""
    return np.stack([np.sqrt(((a - y) ** 2).sum(1)) for y in b], 1) if len(b) else np.zeros((len(a), 0))


def choose_pivots(rows: DataFrame, shard_rows: int) -> dict[int, np.ndarray]:
    """Pivots of each length of vector: far apart, out of a bounded sample that is the same in every run."""
    sized = rows.select("vec_id", "rid", "v", F.size("v").alias("dim"))
    counts = {r["dim"]: r["n"] for r in sized.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    # a row is drawn by its own hash against its length's share, so that nothing is sorted and equal vectors aren't drawn together
    share = F.lit(0)
    for dim, n in counts.items():
        share = F.when(F.col("dim") == dim, int(min(1.0, SAMPLE / n) * (1 << 30))).otherwise(share)
    drawn = sized.withColumn("draw", F.pmod(F.xxhash64("vec_id", "rid"), F.lit(1 << 30))).filter(F.col("draw") < share)
    sample: dict[int, list] = {}
    for r in sorted(drawn.select("dim", F.xxhash64("v").alias("order"), "vec_id", "v").collect(), key=lambda r: (r["order"], r["vec_id"])):
        sample.setdefault(r["dim"], []).append(r["v"])
    out = {}
    for dim in counts:
        x = np.array(sample.get(dim) or [sized.filter(F.col("dim") == dim).first()["v"]], np.float64)
        taken = [0]
        far = gaps(x, x[[0]])[:, 0]
        while len(taken) < min(PIVOTS, -(-counts[dim] // shard_rows)) and far.max() > 0:
            taken.append(int(far.argmax()))
            far = np.minimum(far, gaps(x, x[[taken[-1]]])[:, 0])
        out[dim] = x[taken]
    return out


def in_cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows with dim and pivot, the place of the nearest pivot."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    @F.arrow_udf("int")
    def nearest(v: pa.Array) -> pa.Array:
        out = np.zeros(len(v), np.int32)
        for at, x in by_length(v):
            if x.shape[1] in shared.value:
                out[at] = gaps(x, shared.value[x.shape[1]]).argmin(1)
        return pa.array(out, pa.int32())

    return rows.withColumn("dim", F.size("v")).withColumn("pivot", nearest("v"))


def index(data: DataFrame, pivots: dict[int, np.ndarray], method: Method, shard_rows: int) -> DataFrame:
    """(dim, pivot, salt, rows, radius, norm, tree): a written row for each shard, of ``shard_rows`` vectors or so."""
    placed = in_cells(data, pivots)
    cells = placed.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("salts"))
    dealt = placed.join(F.broadcast(cells), ["dim", "pivot"])  # a row for each pivot
    dealt = dealt.select("rid", "vec_id", "v", "dim", "pivot", F.pmod(F.xxhash64("rid"), "salts").cast("int").alias("salt"))
    shared = data.sparkSession.sparkContext.broadcast(pivots)

    def build(t: pa.Table) -> pa.Table:
        order = np.lexsort((t["rid"].to_numpy(), t["vec_id"].to_numpy()))
        x = matrix(t["v"])[order]
        ids, rids = t["vec_id"].to_numpy()[order], t["rid"].to_numpy()[order]
        key = [t[c][0].as_py() for c in KEY]
        radius = float(exact_gaps(x, shared.value[key[0]][[key[1]]]).max()) * (1 + 1e-12)
        norm = float(np.sqrt((x * x).sum(1)).max())
        tree = pickle.dumps((ids, rids, x, method.build(x)), protocol=5)
        return pa.table({"dim": pa.array([key[0]], pa.int32()), "pivot": pa.array([key[1]], pa.int32()), "salt": pa.array([key[2]], pa.int32()), "rows": [len(x)], "radius": [radius], "norm": [norm], "tree": pa.array([tree], pa.binary())})

    return stash(dealt.groupBy(*KEY).applyInArrow(build, "dim int, pivot int, salt int, rows long, radius double, norm double, tree binary"))


def searched(asked: DataFrame, built: DataFrame, method: Method, k: int, block_rows: int) -> DataFrame:
    """(q, query_id, vec_id, rid, score): asked (q, query_id, v, floor, dim, pivot, salt) held against their shards in blocks."""
    sizes = asked.groupBy(*KEY).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    needed = built.join(sizes, [*KEY]).select(*KEY, "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    blocks = asked.join(sizes, [*KEY]).withColumn("block", F.pmod(F.xxhash64("q"), "blocks").cast("int")).drop("blocks")

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"q": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "rid": pa.int64(), "score": pa.float64()}
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        ids, rids, x, tree = pickle.loads(right["tree"][0].as_py())
        own = left["q"].to_numpy()
        at, got, score = method.find(tree, x, ids, rids, matrix(left["v"]), own, k, left["floor"].to_numpy())
        columns = (own[at], left["query_id"].to_numpy()[at], ids[got], rids[got], score)
        return pa.table({c: pa.array(a, t) for (c, t), a in zip(kinds.items(), columns, strict=True)})

    by = [*KEY, "block"]
    return blocks.groupBy(*by).cogroup(needed.groupBy(*by)).applyInArrow(task, "q long, query_id long, vec_id long, rid long, score double")


def search(queries: DataFrame, data: DataFrame, k: int, method: Method, block_rows: int, shard_rows: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of data but its own, both as ``vectors`` gives them.

    Every row is a query or a candidate of its own, also where rows repeat a vec_id.  Vectors of different lengths don't meet.
    """
    pivots = choose_pivots(data, shard_rows)
    built = index(data, pivots, method, shard_rows)
    # a row for each pivot
    cells = {(r["dim"], r["pivot"]): r for r in built.groupBy("dim", "pivot").agg(F.max("radius").alias("radius"), F.max("norm").alias("norm"), F.count("*").alias("salts")).collect()}
    shared = data.sparkSession.sparkContext.broadcast({(d, p): (r["radius"], r["norm"], r["salts"]) for (d, p), r in cells.items()})
    centres = data.sparkSession.sparkContext.broadcast(pivots)
    home = F.struct(F.col("dim"), F.col("pivot"))

    @F.arrow_udf("array<struct<pivot: int, salt: int>>")
    def ways(v: pa.Array, floor: pa.Array, pivot: pa.Array, first: pa.Array) -> pa.Array:
        """Shards beside the first that may hold something not below the floor."""
        lows, homes, firsts = (a.to_numpy(zero_copy_only=False) for a in (floor, pivot, first))
        out: list[list] = [[] for _ in range(len(v))]
        for at, q in by_length(v):
            known = [(p, *shared.value[q.shape[1], p]) for p in range(len(centres.value.get(q.shape[1], ()))) if (q.shape[1], p) in shared.value]
            if known:
                places, radii, norms, salts = map(np.array, zip(*known, strict=True))
                may = method.bound(q, centres.value[q.shape[1]][places], radii, norms) >= lows[at][:, None]
                for i, j in zip(*np.nonzero(may), strict=True):
                    row = at[i]
                    out[row] += [{"pivot": int(places[j]), "salt": s} for s in range(salts[j]) if (places[j], s) != (homes[row], firsts[row])]
        return pa.array(out, pa.list_(pa.struct([("pivot", pa.int32()), ("salt", pa.int32())])))

    salts = F.coalesce(F.create_map(*[x for (d, p), r in cells.items() for x in (F.struct(F.lit(d).alias("dim"), F.lit(p).alias("pivot")), F.lit(int(r["salts"])))])[home], F.lit(0)) if cells else F.lit(0)
    asked = in_cells(queries.select(F.col("rid").alias("q"), F.col("vec_id").alias("query_id"), "v"), pivots).withColumn("salts", salts)
    # lengths that no candidate has are answered by nothing; a query may lie nearest to a pivot whose cell is empty only if it is no candidate
    asked = asked.withColumn("salt", F.when(F.col("salts") > 0, F.pmod(F.xxhash64("q"), "salts")).otherwise(0).cast("int"))
    near = checkpoint(searched(asked.withColumn("floor", F.lit(float("-inf"))), built, method, k, block_rows))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id", "rid")
    if max((p for _, p in cells), default=0) == 0 and all(r["salts"] == 1 for r in cells.values()):
        return _ranked(near, best, k)  # every query has seen its only shard
    floors = near.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    limited = asked.join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    rest = limited.withColumn("way", F.explode(ways("v", "floor", "pivot", "salt"))).select("q", "query_id", "v", "floor", "dim", "way.pivot", "way.salt")
    return _ranked(near.unionByName(searched(rest, built, method, k, block_rows)), best, k)


def _ranked(found: DataFrame, best: Window, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def merge(top: np.ndarray, who: np.ndarray, rows: np.ndarray, scores: np.ndarray, places: np.ndarray) -> None:
    """Take scores of rows against places into their best; places of smaller ids are smaller, so ties go to these."""
    k = top.shape[1]
    both = np.concatenate([top[rows], scores], 1)
    names = np.concatenate([who[rows], np.broadcast_to(places, scores.shape)], 1)
    at = np.lexsort((names, -both), axis=-1)[:, :k]
    top[rows], who[rows] = np.take_along_axis(both, at, 1), np.take_along_axis(names, at, 1)
