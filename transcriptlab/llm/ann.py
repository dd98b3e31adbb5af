"""Approximate nearest neighbours with vantage-point trees.

Every shard of the data has a tree: a node's vantage point parts its points at the median of their
distances to it, and each half keeps the least and greatest distance.  By the triangle inequality no point of a half
is nearer to a query than the query's distance to the vantage point lies outside that range.  A half is
pruned where this bound, times the relaxation factor, exceeds the query's kth distance so far: factor 1 is exact, greater
factors prune more and may lose points on the far side of a median that the query lies near.

Queries of a block go through a tree together: their bounds to all leaves come from their distances to the
vantage points, each query first looks into the leaves of least bound, and then into all that it may not prune.

Cases: as in the exact search, and vectors of zeros take no part; ties go to the smaller vec_id; halves are
cut by rank, so any number of equal vectors makes balanced halves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import Method, exact_gaps, gaps, merge, search, vectors

LEAF, FIRST = 32, 2
#: Points that may become a node's vantage point, and points that the choice looks at.
CHOICE, LOOK = 16, 256
#: Of production: recall and share of pairs compared are given in the README.
FACTOR = 3.0


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, from differences and not from products, so that equal vectors are at 0."""
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))


@dataclass
class Tree:
    """Leaves, and for each the vantage points above it with the range of distances that leads there."""

    vantage: np.ndarray
    leaves: list[np.ndarray]
    paths: list[list[tuple[int, float, float]]]


def vantage_tree(x: np.ndarray) -> Tree:
    vantage: list[int] = []
    tree = Tree(np.zeros(0, int), [], [])
    rng = np.random.default_rng(len(x))
    open_ = [(np.arange(len(x)), [])]
    while open_:
        points, path = open_.pop()
        if len(points) <= LEAF:
            tree.leaves.append(points)
            tree.paths.append(path)
            continue
        # of some points the one whose distances to others differ most
        some = rng.choice(points, CHOICE, replace=False)
        v = int(some[gaps(x[rng.choice(points, min(LOOK, len(points)), replace=False)], x[some]).std(0).argmax()])
        d = distances(x[points], x[[v]])[:, 0]
        order = np.argsort(d, kind="stable")
        for half in (order[: len(order) // 2], order[len(order) // 2 :]):
            open_.append((points[half], [*path, (len(vantage), float(d[half[0]]), float(d[half[-1]]))]))
        vantage.append(v)
    tree.vantage = np.array(vantage, int)
    return tree


def bounds(tree: Tree, x: np.ndarray, q: np.ndarray, factor: float) -> np.ndarray:
    """queries x leaves: at factor 1 no point of the leaf is nearer."""
    parts = [distances(q, x[tree.vantage[i : i + 64]]) for i in range(0, len(tree.vantage), 64)]
    d = np.concatenate(parts, 1) if parts else np.zeros((len(q), 0))
    out = np.zeros((len(q), len(tree.leaves)))
    for j, path in enumerate(tree.paths):
        for number, low, high in path:
            np.maximum(out[:, j], np.maximum(low - d[:, number], d[:, number] - high), out=out[:, j])
    return out * factor


def tree_search(tree: Tree, x: np.ndarray, ids: np.ndarray, rids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray, factor: float, seen: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, place, - distance) of each query's k nearest found that aren't further than - floor.

    seen: takes the number of pairs of queries and points that were compared.
    """
    low = bounds(tree, x, q, factor)
    top = np.full((len(q), k), -np.inf)
    who = np.full((len(q), k), len(x))
    compared = 0

    def limits() -> np.ndarray:
        return -np.maximum(top[:, -1], floor)

    def look(rows: np.ndarray, leaf: int) -> None:
        nonlocal compared
        places = tree.leaves[leaf]
        for part in np.array_split(rows, -(-len(rows) // 256)):
            scores = -distances(q[part], x[places])
            compared += scores.size
            scores[own[part][:, None] == rids[places][None]] = -np.inf
            better = scores.max(1) >= top[part, -1]
            if better.any():
                merge(top, who, part[better], scores[better], places)

    first = np.argsort(low, axis=1, kind="stable")[:, :FIRST]
    for place in range(first.shape[1]):
        for leaf in np.unique(first[:, place]):
            look(np.flatnonzero(first[:, place] == leaf), int(leaf))
    for leaf in np.argsort(low.mean(0), kind="stable"):
        looked = (first == leaf).any(1)
        rows = np.flatnonzero(~looked & (low[:, leaf] <= limits() * (1 + 1e-9) + 1e-12))
        if len(rows):
            look(rows, int(leaf))
    if seen is not None:
        seen.append(compared)
    at, col = np.nonzero(np.isfinite(top) & (top >= floor[:, None]))
    return at, who[at, col], top[at, col]


def nearest_in_ball(q: np.ndarray, centres: np.ndarray, radii: np.ndarray, norms: np.ndarray, factor: float) -> np.ndarray:
    """queries x balls: minus the least distance to a ball, times the factor."""
    away = exact_gaps(q, centres)
    return -np.maximum(away - radii, 0) * factor + 1e-11 * (away + radii)  # rounding must not prune


def method(factor: float) -> Method:
    return Method(vantage_tree, partial(tree_search, factor=factor), partial(nearest_in_ball, factor=factor))


def neighbours(queries: DataFrame, data: DataFrame, k: int, factor: float = FACTOR, block_rows: int = 2048, shard_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score double): the k nearest found, by Euclidean distance."""
    return search(queries, data, k, method(factor), block_rows, shard_rows).withColumn("score", F.abs("score"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(table(spark, sf_dir, "embeddings"), zero=False)
    return neighbours(rows.filter(F.col("vec_id") % 100 == 0), rows, 10)
