"""Exact top-k by inner product with a dual-tree search of cover trees.

The data's shards each have a cover tree: a node has a centre and a covering radius, and is parted around centres that lie
further apart than its radius divided by BASE, until every point is within that of one.  The queries of a
block get a cover tree too.  Pairs of nodes are visited together: for centres p and r with
covering radii P and R no inner product in the pair exceeds p.r + P|r| + R|p| + PR, and the pair is pruned where that is
less than the worst kth score among the node's queries.  Within a leaf of queries each has a bound of its own:
p.r + R|p|, |p|N and (|p|^2 + N^2 - d^2) / 2, where N is the largest norm in the data's node and d the distance that is left
between the query and its ball.  Nodes with the highest bound come first.  Every query's kth score starts from the leaves nearest
in angle, so that pruning begins at the roots.

Cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a
null vec_id; rows that repeat a vec_id are queries and candidates of their own, a row meets all rows but itself; equal vectors under several ids are
candidates each, ties go to the smaller vec_id; vectors of different lengths don't meet; fewer candidates than k give
fewer rows; an empty table gives an empty result; extra columns are not kept, so names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .vectors import Method, gaps, merge, search, vectors

BASE = 1.15
LEAF, QUERY_LEAF = 8, 16
#: Points that a leaf of queries is compared with at once.
CHUNK = 128


@dataclass
class Tree:
    """Nodes by number: the children of one stand together, its points are ``order[start:stop]``."""

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    kids: np.ndarray
    last: np.ndarray
    size: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.size = np.sqrt((self.centre**2).sum(1))

    def opened(self, nodes: np.ndarray) -> np.ndarray:
        """The children of nodes that have some, and the nodes that have none."""
        n = self.last[nodes] - self.kids[nodes]
        inner = n > 0
        first = np.repeat(self.kids[nodes[inner]] - (np.cumsum(n[inner]) - n[inner]), n[inner])
        return np.concatenate([nodes[~inner], first + np.arange(int(n.sum()))])

    def points(self, nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.order[self.start[i] : self.stop[i]] for i in nodes])


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of the rows of x.  The nearest of a node's centres takes each point, and radii are measured."""
    order = np.arange(len(x))
    norms = np.sqrt((x * x).sum(1))
    rows: list[list] = []  # centre, radius, norm, start, stop, first child, behind the last child

    def node(centre: int, start: int, stop: int) -> None:
        own = order[start:stop]
        radius = float(gaps(x[own], x[[centre]]).max()) * (1 + 1e-9) + 1e-9 * norms[centre]
        rows.append([centre, radius, float(norms[own].max()), start, stop, 0, 0])

    node(0, 0, len(x))
    at = 0
    while at < len(rows):
        centre, radius, _, start, stop, *_ = rows[at]
        own = order[start:stop]
        far = gaps(x[own], x[[centre]])[:, 0]
        if stop - start > leaf and far.max() > 0:
            centres, owner, limit = [centre], np.zeros(len(own), int), far.max() / BASE
            while far.max() > limit:
                centres.append(int(own[far.argmax()]))
                d = gaps(x[own], x[[centres[-1]]])[:, 0]
                d[own == centres[-1]] = 0
                nearer = d < far
                owner[nearer], far[nearer] = len(centres) - 1, d[nearer]
            sizes = np.bincount(owner, minlength=len(centres))
            order[start:stop] = own[np.argsort(owner, kind="stable")]
            rows[at][5] = len(rows)
            for c, n in zip(centres, sizes, strict=True):
                if n:
                    node(c, start, start + n)
                    start += n
            rows[at][6] = len(rows)
        at += 1
    centre, radius, norm, start, stop, kids, last = zip(*rows, strict=True)
    return Tree(order, x[list(centre)], np.array(radius), np.array(norm), *(np.array(a, np.int64) for a in (start, stop, kids, last)))


def bound(q: np.ndarray, centres: np.ndarray, radii: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """queries x balls: no inner product with a vector of the ball exceeds it."""
    own = (q * q).sum(1)[:, None]
    dots = q @ centres.T
    gap = np.maximum(np.sqrt(np.maximum(own + (centres * centres).sum(1)[None] - 2 * dots, 0)) - radii, 0)
    most = np.minimum(np.minimum(dots + np.sqrt(own) * radii, np.sqrt(own) * norms), (own + norms**2 - gap**2) / 2)
    return most + 1e-9 * (np.abs(most) + 1)  # rounding must not prune


def dual_search(tree: Tree, x: np.ndarray, ids: np.ndarray, rids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray, seen: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, place, score) of each query's k largest inner products that aren't below its floor; ids must be sorted.

    seen: takes the number of pairs of queries and points that were compared.
    """
    top = np.full((len(q), k), -np.inf)
    who = np.full((len(q), k), len(x))
    asked = cover_tree(q, QUERY_LEAF)
    leaves = np.flatnonzero(tree.kids == tree.last)
    compared = 0

    def limits(rows: np.ndarray) -> np.ndarray:
        return np.maximum(top[rows, -1], floor[rows])

    def compare(rows: np.ndarray, nodes: np.ndarray, done: np.ndarray) -> None:
        nonlocal compared
        places = tree.points(nodes)
        scores = q[rows] @ x[places].T
        compared += scores.size
        scores[own[rows][:, None] == rids[places][None]] = -np.inf
        better = scores.max(1) >= limits(rows)
        if better.any():
            merge(top, who, rows[better], scores[better], places)
        done[nodes] = True

    def leaf(rows: np.ndarray, nodes: np.ndarray, done: np.ndarray) -> None:
        while len(nodes):
            may = bound(q[rows], tree.centre[nodes], tree.radius[nodes], tree.norm[nodes])
            alive = (may >= limits(rows)[:, None]).any(0)
            nodes, may = nodes[alive], may[:, alive]
            if (tree.kids[nodes] == tree.last[nodes]).all():
                break
            nodes = tree.opened(nodes)
        fresh = ~done[nodes]
        nodes, may = nodes[fresh], may[:, fresh] if len(nodes) else np.zeros((len(rows), 0))
        first = np.argsort(-may.max(0), kind="stable") if len(nodes) else np.zeros(0, int)
        sizes = np.cumsum(tree.stop[nodes[first]] - tree.start[nodes[first]])
        at = 0
        while at < len(first):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, side="right")))
            part = first[at:stop]
            alive = (may[:, part] >= limits(rows)[:, None]).any(0)
            if alive.any():
                compare(rows, nodes[part[alive]], done)
            elif (may[:, first[stop:]].max(initial=-np.inf) < limits(rows)).all():
                break
            at = stop

    groups = np.flatnonzero(asked.kids == asked.last)
    done = {int(g): np.zeros(len(tree.radius), bool) for g in groups}
    for g in groups:  # a kth score for every query
        rows = asked.order[asked.start[g] : asked.stop[g]]
        near = leaves[np.argsort(-(tree.centre[leaves] @ asked.centre[g]), kind="stable")]
        enough = int(np.searchsorted(np.cumsum(tree.stop[near[: 8 * k]] - tree.start[near[: 8 * k]]), 4 * k)) + 1
        compare(rows, near[:enough], done[int(g)])
    open_ = [(0, np.zeros(1, np.int64))]
    while open_:
        g, nodes = open_.pop()
        rows = asked.order[asked.start[g] : asked.stop[g]]
        if asked.kids[g] == asked.last[g]:
            leaf(rows, nodes, done[g])
            continue
        most = tree.centre[nodes] @ asked.centre[g] + asked.radius[g] * tree.size[nodes] + tree.radius[nodes] * asked.size[g] + asked.radius[g] * tree.radius[nodes]
        most = np.minimum(most, (asked.size[g] + asked.radius[g]) * tree.norm[nodes])
        nodes = nodes[most + 1e-9 * (np.abs(most) + 1) >= limits(rows).min()]
        # both sides go down: nodes that are larger than the query group are opened for its children
        wide = tree.radius[nodes] >= asked.radius[g]
        nodes = np.concatenate([nodes[~wide], tree.opened(nodes[wide])])
        open_ += [(int(c), nodes) for c in range(asked.kids[g], asked.last[g])]
    if seen is not None:
        seen.append(compared)
    at, col = np.nonzero(np.isfinite(top) & (top >= floor[:, None]))
    return at, who[at, col], top[at, col]


METHOD = Method(cover_tree, dual_search, bound)


def top_k(queries: DataFrame, data: DataFrame, k: int, block_rows: int = 2048, shard_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score long): exact; components must be whole numbers and products below 2**53."""
    return search(queries, data, k, METHOD, block_rows, shard_rows).withColumn("score", F.col("score").cast("long"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(table(spark, sf_dir, "embeddings"), zero=True)
    whole = rows.select("rid", "vec_id", F.transform("v", lambda c: F.floor(c * 256).cast("double")).alias("v"))
    return top_k(whole.filter(F.col("vec_id") % 50 == 0), whole, 5)


OP2_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), w AS (SELECT rid, vec_id, list_transform(v, lambda c: CAST(floor(CAST(c AS DOUBLE) * 256) AS BIGINT)) AS v FROM e),
s AS (
  SELECT q.rid AS q, q.vec_id AS query_id, d.rid, d.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM w q JOIN w d ON q.rid <> d.rid AND len(q.v) = len(d.v) WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, rid) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
