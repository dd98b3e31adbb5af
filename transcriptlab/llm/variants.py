"""Spelling variants: words that one inserted, deleted or replaced letter parts, found with k-d trees over letter counts.

Words are points whose coordinates are the counts of their letters.  One replaced letter moves a point by 2 in L1, one inserted or
deleted letter by 1.  So for each pair of lengths (n, n) and (n, n + 1) the words of length n search the tree of the other length within 2 or
1: a box of the tree is entered only if its L1 distance to the word is no more than that, a leaf's words are held
against the word's counts, and those within reach are compared letter by letter.

A k-d tree over a bounded sample cuts the points of each length into cells, and cells of many words into shards.  A word goes to all
cells that its search can reach.  A task builds a shard's tree, searches it for a block of words, and gives for each word the
number of its near words and the best of them, so that no pair leaves a task.  Every word is in one shard, so the numbers add up.

A word's form is its near word of largest count if that is RATIO times its own; roots are found by pointer jumping along forms.

Cases: a null text has no words; runs of a row with a null doc_id lose no letter; texts are read whole; repeated rows count again; equal counts go to the word first in code-point order; a word without near words has none as form and is its
own root; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, stash, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs that can give a word: a letter may yet be deleted, never added.  Greedy, so a run of that length or more is taken whole.
LETTERS = r"[A-Za-zÀ-ÿ]{%d,}"
LEAST, OFTEN, RATIO, MODULUS = 5, 3, 2, 97
#: Words of a cell's shard, words searched in one task, cells of one length at most, and words that the cells are chosen from.
SHARD, BLOCK, CELLS, SAMPLE = 8_192, 32_768, 1_024, 40_000
LEAF = 64
#: Words held against a leaf at once, letters compared at once, and the longest words whose counts are compared by a product.
CHUNK, COMPARED, SHORT = 16_384, 1 << 22, 64
FOUND = "word string, near long, best_n long, best string"


def occurrences(docs: DataFrame, least: int = LEAST, often: int = OFTEN, modulus: int = MODULUS) -> DataFrame:
    """(word, n): words of docs (doc_id, text) with at least ``least`` code points, ``often`` times or more.

    Where ``modulus`` divides the CRC-32 of ``doc_id:run``, the run loses its code point at that number modulo its length; null doc_ids have no number.
    """
    run = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS % least), F.lit(0))).alias("run")
    runs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), run).withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter((F.length("word") >= least) & (F.col("n") >= often))


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words of one length, one byte each, and the count of each of 256 code points."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    x = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1) if raw else np.zeros((0, 1), np.uint8)
    counts = np.zeros((len(raw), 256), np.int32)
    for c in range(x.shape[1] if raw else 0):
        counts[np.arange(len(raw)), x[:, c]] += 1
    return x, counts


@dataclass(frozen=True)
class Node:
    """The points of a box, or two halves: counts of ``axis`` up to ``at``, and above; ``low`` and ``high`` bound that count in the box."""

    points: np.ndarray | None = None
    number: int = 0
    axis: int = 0
    at: int = 0
    low: int = 0
    high: int = 0
    left: Node | None = None
    right: Node | None = None


def kd_tree(counts: np.ndarray, leaf: int = LEAF, most: int | None = None) -> tuple[Node, int]:
    """The tree of points, cut at the axis of largest variance near its median, and its number of leaves, ``most`` of them at most."""
    size = 0
    wanted = np.inf if most is None else most

    def node(points: np.ndarray, low: np.ndarray, high: np.ndarray, share: float) -> Node:
        nonlocal size
        own = counts[points]
        spread = own.astype(np.float32).var(0) if len(points) > 1 else np.zeros(1)
        if len(points) <= leaf or share < 2 or spread.max() == 0:
            size += 1
            return Node(points, size - 1)
        axis = int(spread.argmax())
        values = np.sort(own[:, axis])
        middle = int(values[len(values) // 2])
        at = min((a for a in (middle - 1, middle) if values[0] <= a < values[-1]), key=lambda a: abs(np.searchsorted(values, a, side="right") - len(values) / 2))
        below = own[:, axis] <= at
        up, down = low.copy(), high.copy()
        up[axis], down[axis] = at + 1, at
        return Node(None, 0, axis, at, int(low[axis]), int(high[axis]), node(points[below], low, down, share / 2), node(points[~below], up, high, share / 2))

    top = np.full(counts.shape[1], np.iinfo(np.int32).max, np.int64)
    return node(np.arange(len(counts)), np.zeros_like(top), top, wanted), size


def visited(tree: Node, counts: np.ndarray, reach: int) -> Iterator[tuple[Node, np.ndarray]]:
    """Leaves whose boxes lie within ``reach`` (L1) of some of the points, with these."""
    open_ = [(tree, np.arange(len(counts)), np.zeros(len(counts), np.int64))]
    while open_:
        node, rows, gap = open_.pop()
        if not len(rows):
            continue
        if node.points is not None:
            yield node, rows
            continue
        value = counts[rows, node.axis].astype(np.int64)
        before = np.maximum(np.maximum(node.low - value, value - node.high), 0)
        for child, low, high in ((node.left, node.low, node.at), (node.right, node.at + 1, node.high)):
            there = gap - before + np.maximum(np.maximum(low - value, value - high), 0)
            some = there <= reach
            open_.append((child, rows[some], there[some]))


def home(tree: Node, counts: np.ndarray) -> np.ndarray:
    """The number of the leaf whose box each point lies in."""
    out = np.zeros(len(counts), np.int32)
    for node, rows in visited(tree, counts, 0):
        out[rows] = node.number
    return out


def unary(counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A column for each occurrence of each letter that may occur: the product of two rows is the size of their common multiset."""
    axis = np.repeat(np.arange(len(most)), most)
    step = np.concatenate([np.arange(m) for m in most]) if len(axis) else np.zeros(0, int)
    return (counts[:, axis] > step).astype(np.float32)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows differ by exactly one replaced letter, or, where b is a letter longer, by one inserted letter."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(1) == 1
    ahead = np.cumprod(a == b[:, :n], 1).sum(1)
    behind = np.cumprod((a == b[:, 1:])[:, ::-1], 1).sum(1)
    return ahead + behind >= n


def near_words(tree: Node, x: np.ndarray, counts: np.ndarray, q: np.ndarray, q_counts: np.ndarray, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of all near words among x for words q of the same length, or of one letter less.

    seen: takes the number of words whose counts were compared.
    """
    longer = x.shape[1] - q.shape[1]
    short = x.shape[1] <= SHORT
    if short:
        most = np.maximum(counts.max(0, initial=0), q_counts.max(0, initial=0))
        bits, asked = unary(counts, most), unary(q_counts, most)
        need = q.shape[1] - 1 + longer
    pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for leaf, rows in visited(tree, q_counts, 2 - longer):
        for part in np.split(rows, range(CHUNK if short else LEAF, len(rows), CHUNK if short else LEAF)):
            if seen is not None:
                seen.append(len(part) * len(leaf.points))
            if short:
                i, j = np.nonzero(asked[part] @ bits[leaf.points].T >= need - 0.5)
            else:
                i, j = np.nonzero([np.abs(counts[leaf.points] - own).sum(1) <= 2 - longer for own in q_counts[part]])
            i, j = part[i], leaf.points[j]
            step = max(COMPARED // x.shape[1], 1)
            for s in range(0, len(i), step):
                a, b = i[s : s + step], j[s : s + step]
                good = one_edit(q[a], x[b])
                pairs.append((a[good], b[good]))
    return tuple(np.concatenate(side) for side in zip(*pairs, strict=True))


def best_of(rows: np.ndarray, size: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``size`` rows how often it is among rows, and the least rank beside it."""
    best = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(best, rows, ranks)
    return np.bincount(rows, minlength=size), best


def by_count(words: pa.ChunkedArray, n: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Words and counts, best first: by count, then by code points."""
    t = pa.table({"n": n, "word": words}).sort_by([("n", "descending"), ("word", "ascending")])
    return t["word"].combine_chunks(), t["n"].to_numpy()


def _searched(asked: pa.Table, held: pa.Table) -> pa.Table:
    """Near counts and best near words, from a block of words and a shard; for a shard of longer words those of both sides."""
    out: dict[str, list] = {"word": [], "near": [], "best_n": [], "best": []}
    if asked.num_rows and held.num_rows:
        words, n = by_count(held["word"], held["n"])
        others, m = by_count(asked["word"], asked["n"])
        (x, counts), (q, q_counts) = letters(words), letters(others)
        i, j = near_words(kd_tree(counts)[0], x, counts, q, q_counts)
        sides = [(others, i, words, n, j)]
        if x.shape[1] > q.shape[1]:
            sides.append((words, j, others, m, i))
        for own, rows, names, sizes, ranks in sides:
            near, best = best_of(rows, len(own), ranks)
            some = np.flatnonzero(near)
            out["word"].append(own.take(pa.array(some)))
            out["near"].append(pa.array(near[some]))
            out["best_n"].append(pa.array(sizes[best[some]]))
            out["best"].append(names.take(pa.array(best[some])))
    kinds = {"word": pa.string(), "near": pa.int64(), "best_n": pa.int64(), "best": pa.string()}
    return pa.table({c: pa.chunked_array([a.cast(kind) for a in out[c]], kind) for c, kind in kinds.items()})


def cells(words: DataFrame, shard_rows: int = SHARD) -> dict[int, Node]:
    """For each length of word the tree whose leaves are its cells, from a bounded sample that is the same in every run."""
    sized = words.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("n")).collect()  # a row for each length
    total = sum(r["n"] for r in sized)
    share = int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30))
    drawn = words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) <= share).select("word", F.length("word").alias("size")).toArrow()
    lengths = drawn["size"].to_numpy()
    out = {}
    for r in sized:
        some = drawn["word"].filter(pa.array(lengths == r["size"])).combine_chunks()
        counts = letters(some)[1] if len(some) else np.zeros((1, 256), np.int8)
        out[r["size"]] = kd_tree(counts, 1, min(CELLS, -(-r["n"] // shard_rows)))[0]
    return out


def near_counts(words: DataFrame, shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """(word, near, best_n, best) of words (word, n) that have near words: how many, and the one of largest count, the first on ties."""
    trees = cells(words, shard_rows)
    shared = words.sparkSession.sparkContext.broadcast(trees)

    def each_length(words: pa.Array, work: Callable[[int, np.ndarray, np.ndarray], None]) -> None:
        sizes = pc.utf8_length(words).to_numpy()
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            work(int(size), rows, letters(words.take(pa.array(rows)))[1])

    @F.arrow_udf("int")
    def cell(words: pa.Array) -> pa.Array:
        out = np.zeros(len(words), np.int32)

        def work(size: int, rows: np.ndarray, counts: np.ndarray) -> None:
            out[rows] = home(shared.value[size], counts)

        each_length(words, work)
        return pa.array(out)

    @F.arrow_udf("array<struct<tree: int, cell: int>>")
    def reached(words: pa.Array) -> pa.Array:
        out: list[list] = [[] for _ in range(len(words))]

        def work(size: int, rows: np.ndarray, counts: np.ndarray) -> None:
            for longer in (0, 1):
                if size + longer in shared.value:
                    for leaf, some in visited(shared.value[size + longer], counts, 2 - longer):
                        for i in rows[some]:
                            out[i].append({"tree": size + longer, "cell": leaf.number})

        each_length(words, work)
        return pa.array(out, pa.list_(pa.struct([("tree", pa.int32()), ("cell", pa.int32())])))

    placed = words.select("word", "n", F.length("word").alias("tree"), cell("word").alias("cell"))
    placed = stash(placed)
    salts = checkpoint(placed.groupBy("tree", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("salts")))
    held = placed.join(salts, ["tree", "cell"]).select("word", "n", "tree", "cell", F.pmod(F.xxhash64("word"), "salts").cast("int").alias("salt"))
    asked = placed.select("word", "n", F.explode(reached("word")).alias("way")).select("word", "n", F.length("word").alias("size"), "way.tree", "way.cell").join(salts, ["tree", "cell"])
    asked = asked.select("word", "n", "size", "tree", "cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    by = ["tree", "cell", "salt", "size"]
    asked = stash(asked)
    blocks = checkpoint(asked.groupBy(*by).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")))
    left = asked.join(blocks, by).select(*by, "word", "n", F.pmod(F.xxhash64("word", F.lit(1)), "blocks").cast("int").alias("block"))
    right = held.join(blocks, ["tree", "cell", "salt"]).select(*by, "word", "n", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    by.append("block")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_searched, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("top")).select("word", "near", (-F.col("top.n")).alias("best_n"), F.col("top.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), forms without rings: the last word along the forms, by pointer jumping."""
    known = stash(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("far"))
        known = stash(known.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        if not known.filter("moved").limit(1).count():
            return known.select("word", "root")
        known = known.select("word", "root")


def spelling_forms(words: DataFrame, ratio: int = RATIO, shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), one row each; form is the near word of largest count if that is ``ratio`` times n."""
    words = stash(words)
    near = near_counts(words, shard_rows, block_rows)
    enough: Column = F.col("best_n") >= ratio * F.col("n")
    held = words.join(near, "word", "left").select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"))
    held = stash(held)
    last = roots(held.filter("form IS NOT NULL"))
    return held.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(occurrences(table(spark, sf_dir, "documents").select("doc_id", "text")))


#: CRC-32 by a table of 256 entries, made from its polynomial; runs hold code points up to 255, so one or two bytes each.
OP11_SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS crc
), runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{5,}')) AS run FROM documents)
  GROUP BY doc_id, run
), bytes AS (
  SELECT doc_id, run, n, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END)) AS b
  FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, crc[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM bytes, crc
), w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), holes AS (
  SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS hole, left(word, i - 1) || substr(word, i + 1) AS less
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS i FROM w)
), pairs AS (
  SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN w b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN w b ON a.less = b.word
), near AS (
  SELECT word, count(*) AS n_near, arg_min(struct_pack(o := other, n := n), struct_pack(n := -n, o := other)) AS best FROM pairs GROUP BY word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * w.n THEN best.o END AS form, CASE WHEN best.n >= 2 * w.n THEN best.n END AS form_n
  FROM w LEFT JOIN near ON near.word = w.word
), chain AS (
  SELECT word, word AS at, form AS next FROM f
  UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON f.word = chain.next
)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n FROM f JOIN chain ON chain.word = f.word AND chain.next IS NULL
"""
