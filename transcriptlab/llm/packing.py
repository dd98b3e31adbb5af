"""Best-fit packing into sequences of several permitted lengths.

Pieces are packed best-fit decreasing: largest first, each into the open bin that it leaves fullest; where
none has room, a bin of the least-cost permitted length is opened, and at the end each bin shrinks to the
shortest permitted length that holds its contents.  Which lengths may be opened is decided jointly: the
whole plan is made for every set of permitted lengths that has the longest, and the cheapest plan stays.

Sizes are whole numbers up to the longest length, so best-fit decreasing depends only on how many pieces
there are of each size.  Spark counts them; the plan is made from that histogram, in runs of equal bins, so that its
size depends on the lengths and not on the data; and each piece finds its bin from its rank among the
pieces of its size.  Ranks come from counts of salted groups, so a size that a third of all documents share
is spread over many tasks.

Cases: a document longer than the longest length is cut into pieces of that length and a rest, none is
dropped; null and empty texts have size 0, one piece and no bin (bin_id null); repeated rows are pieces of
their own; among pieces of one size, doc_id and piece order decide; an empty table gives an empty result; of extra columns only
the id is kept, so names can't clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table, word_count

LENGTHS = (256, 512, 1024, 2048, 4096)
#: A salted group has about so many pieces.
GROUP = 20_000


def default_cost(length: int) -> float:
    """Work of a sequence: linear in its length, with a share that grows as attention does."""
    return length * (1 + length / 8192)


@dataclass
class Run:
    """``count`` equal bins, numbered from ``first``."""

    first: int
    count: int
    length: int
    room: int


def plan(histogram: dict[int, int], lengths: tuple[int, ...], cost=default_cost) -> tuple[float, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Cost, slots and bins of best-fit decreasing over all sizes, opening only ``lengths``.

    Slots (ordered by size, then rank): pieces of a size with ranks from ``rank`` on go ``each`` to a bin from bin
    ``bin`` on, behind ``offset`` words.  Bins (ordered): from bin ``first`` on, bins are ``length`` long and hold ``used``.
    """
    lengths = tuple(sorted(lengths))
    rooms: dict[int, list[Run]] = {}
    slots: list[tuple[int, int, int, int, int]] = []
    done: list[Run] = []
    bins = 0
    for size in sorted((s for s in histogram if s > 0), reverse=True):
        left, rank = histogram[size], 0

        def put(run: Run, each: int, size: int = size) -> None:
            """All of run's bins take ``each`` pieces."""
            nonlocal left, rank
            slots.append((size, rank, run.first, each, run.length - run.room))
            left, rank = left - each * run.count, rank + each * run.count
            run.room -= each * size
            (rooms.setdefault(run.room, []) if run.room else done).append(run)

        while left:
            room = min((r for r in rooms if r >= size), default=None)
            if room is None:
                # The least cost for each word that the bin can be filled with: whole pieces of this size, then smaller ones.
                length = min((x for x in lengths if x >= size), key=lambda x: (cost(x) / min(x, size * left), x))
                each = length // size
                count = max(1, left // each)
                run = Run(bins, count, length, length)
                bins += count
            else:
                run = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                each = room // size
            full = min(run.count, left // each)
            rest = left - full * each if full < run.count else 0
            if full:
                put(Run(run.first, full, run.length, run.room), each)
            if full < run.count:
                if rest:
                    put(Run(run.first + full, 1, run.length, run.room), rest)
                over = run.count - full - (1 if rest else 0)
                if over:
                    rooms.setdefault(run.room, []).append(Run(run.first + run.count - over, over, run.length, run.room))
    done += [r for rs in rooms.values() for r in rs]
    done.sort(key=lambda r: r.first)
    used = [r.length - r.room for r in done]
    final = [min(x for x in lengths if x >= u) for u in used]
    total = math.fsum(cost(x) * r.count for x, r in zip(final, done, strict=True))
    s = np.array(slots, dtype=np.int64).reshape(-1, 5)
    s = s[np.lexsort((s[:, 1], s[:, 0]))]
    return total, dict(zip(("size", "rank", "bin", "each", "offset"), s.T, strict=True)), {"first": np.array([r.first for r in done], np.int64), "count": np.array([r.count for r in done], np.int64), "length": np.array(final, np.int64), "used": np.array(used, np.int64)}


def best_plan(histogram: dict[int, int], lengths: tuple[int, ...], cost=default_cost) -> tuple[float, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The cheapest plan over every set of lengths to open; downsizing may use every permitted length."""
    longest, others = max(lengths), sorted(set(lengths) - {max(lengths)})
    best = None
    for k in range(len(others) + 1):
        for extra in combinations(others, k):
            got = plan(histogram, (*extra, longest), cost)
            shrunk = np.array([min(x for x in lengths if x >= u) for u in got[2]["used"]], np.int64)
            total = math.fsum(cost(int(x)) * int(n) for x, n in zip(shrunk, got[2]["count"], strict=True))
            if best is None or total < best[0]:
                best = (total, got[1], got[2] | {"length": shrunk})
    return best


def pieces(docs: DataFrame, longest: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, size): one row for each piece of each document."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), word_count(F.col(text)).alias("words"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("words") / longest)).cast("int")
    return sized.select("doc_id", "words", F.explode(F.sequence(F.lit(0), parts - 1)).alias("piece")).select("doc_id", "piece", F.least(F.lit(longest), F.col("words") - F.col("piece") * longest).cast("long").alias("size"))


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, cost=default_cost, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, size, bin_id, bin_length, bin_used, start): where each piece lies."""
    spark, longest = docs.sparkSession, max(lengths)
    cut = checkpoint(pieces(docs, longest, doc_id, text))
    # at most a row for each size up to the longest length
    histogram = {int(r["size"]): int(r["n"]) for r in cut.groupBy("size").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    _, slots, bins = best_plan(histogram, lengths, cost)
    groups = max(64, total // GROUP)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # a row for each salt
    starts = salted.groupBy("size", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("size", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("own", F.row_number().over(within) - 1).join(starts, ["size", "salt"]).select("doc_id", "piece", "size", (F.col("own") + F.col("before")).alias("rank"))
    shared = spark.sparkContext.broadcast((slots, bins))  # bounded by the lengths

    def place(batches):
        slots, bins = shared.value
        key = (slots["size"] << 40) + slots["rank"]
        for b in batches:
            size, rank = b["size"].to_numpy(), b["rank"].to_numpy()
            some = size > 0
            i = np.maximum(np.searchsorted(key, (size << 40) + rank, side="right") - 1, 0)
            if len(key):
                past = rank - slots["rank"][i]
                bin_id = slots["bin"][i] + past // slots["each"][i]
                start = slots["offset"][i] + past % slots["each"][i] * size
                j = np.maximum(np.searchsorted(bins["first"], bin_id, side="right") - 1, 0)
                length, used = bins["length"][j], bins["used"][j]
            else:
                bin_id = start = length = used = np.zeros(len(size), np.int64)
            yield pa.record_batch([b["doc_id"], b["piece"], b["size"], *(pa.array(x, pa.int64(), mask=~some) for x in (bin_id, length, used, start))], names=["doc_id", "piece", "size", "bin_id", "bin_length", "bin_used", "start"])

    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, size long, bin_id long, bin_length long, bin_used long, start long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
