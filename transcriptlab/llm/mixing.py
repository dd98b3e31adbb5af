"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points are mapped through the sources' cumulative weights: slot i belongs to the source in
whose share point i falls.  Slots are ranked within their source, and the r-th slot of a source takes block
r modulo its number of blocks, where a source's documents, shuffled by a hash, lie end to end and are cut
into blocks of equal word counts.  Taking a block again is a further pass over the source; no block is
taken more than three times.

Ranks and offsets come from two levels (within a chunk of slots or a hash range of documents, and the sums of those
before it), so that a source with a third of all rows is spread over many tasks.

Cases: null and empty texts have size 0, are no part of any block and have taken 0; a very long text spans
many blocks; repeated rows are documents of their own; ties of the shuffle are settled by doc_id and text
hash; a null source is a source, after all others; a null doc_id is an id like others; an empty table, or
one of empty texts alone, takes nothing (target 0); of extra columns none are kept by ``mix``, all by the stage, whatever their names.  What is known of sources is a row for
each; these are ordered in one task, a million of them in a few seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
#: Words in a block (each source's blocks are equal, of at most so many words).
BLOCK = 128
#: Slots in a chunk, documents in a hash range.
CHUNK, GROUP = 1 << 16, 20_000
#: Cells that the unit interval is cut into for the lookup of points, at least; more where there are many sources.
CELLS = 1024
#: Fractional part of the golden ratio.
PHI = 0.6180339887498949


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): shares by weight, where no target is above ``most`` times its source's size.

    Reshaping the excess again and again ends where each source has the lesser of its limit and a common
    level times its weight; one pass over the sources in the order in which they reach their limits finds it.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filled = sources.withColumn("weight", weight.cast("double")).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    filled = filled.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    filled = filled.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
    filled = filled.withColumn("place", F.row_number().over(by_limit))
    level = F.min_by("level", F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.col("place"))).over(everything)
    return filled.withColumn("level", level).select("source", "source_size", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))).alias("target"))


def schedule(plan: DataFrame, slots: int, chunk: int = CHUNK) -> DataFrame:
    """(slot, sid, rank): the source of every slot, and the slot's rank among its source's slots.

    plan: sid, low, high, the half-open interval of [0, 1) that is the source's share.
    """
    spark = plan.sparkSession
    # a point meets the sources of its cell: some four, if they were equal
    count = max(CELLS, plan.count() // 4)
    low_bits, high_bits = F.col("slot").bitwiseAND(F.lit((1 << 20) - 1)), F.shiftright("slot", 20)
    # in two parts, so that the product keeps its digits for any number of slots
    point = ((low_bits * F.lit(PHI)) % 1.0 + (high_bits * F.lit((1 << 20) * PHI % 1.0)) % 1.0 + 0.5) % 1.0
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", F.floor(F.col("point") * count).cast("int"))
    cells = plan.filter("high > low").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * count).cast("int"), F.least(F.lit(count - 1), F.floor(F.col("high") * count).cast("int")))))
    placed = points.join(cells, "cell").filter("point >= low AND point < high").select("slot", "sid", F.floor(F.col("slot") / chunk).alias("chunk"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("sid", "chunk").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    return placed.withColumn("own", own).join(starts, ["sid", "chunk"]).select("slot", "sid", (F.col("own") + F.col("before")).alias("rank"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """(doc_id, text_key, source, size, source_size, target, taken), one row for each row of docs."""
    sizes = checkpoint(docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))
    # a row for each source
    blocks = F.ceil(F.col("source_size") / block)
    plan = targets(sizes, weights, most).withColumn("blocks", blocks).withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    plan = plan.withColumn("share", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))
    upto, whole = Window.orderBy("sid"), Window.partitionBy()
    plan = plan.withColumn("shares", F.sum("share").over(whole)).withColumn("high", F.when(F.col("shares") > 0, F.sum("share").over(upto) / F.col("shares")).otherwise(0.0))
    last = F.max(F.when(F.col("share") > 0, F.col("sid"))).over(whole)
    plan = plan.withColumn("high", F.when(F.col("sid") >= last, 1.0).otherwise(F.col("high"))).withColumn("low", F.coalesce(F.lag("high").over(upto), F.lit(0.0)))
    plan = checkpoint(plan)
    slots = plan.agg(F.round(F.first("shares")).cast("long")).first()[0] or 0
    facts = plan.select(F.col("source").alias("_s"), "sid", "source_size", "target", "blocks")

    # Documents end to end within their source, in hash order.
    n = sizes.count()
    groups = max(64, n // GROUP)
    order = F.xxhash64(F.lit(seed), "doc_id", "text_key")
    laid = sizes.withColumn("draw", order).withColumn("part", F.floor((F.shiftright(F.col("draw"), 24) + F.lit(1 << 39)) * groups / F.lit(1 << 40)).cast("int")).join(facts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy("sid", "part").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.coalesce(F.sum("size").over(Window.partitionBy("sid", "part").orderBy("draw", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = checkpoint(laid.withColumn("own", own).join(starts, ["sid", "part"]).withColumn("start", F.col("own") + F.col("before")).select("doc_id", "text_key", "source", "size", "source_size", "target", "blocks", "sid", "start"))

    taken = schedule(plan, slots).join(facts.select("sid", F.col("blocks").alias("b")), "sid").filter(F.col("rank") < most * F.col("b")).groupBy("sid", (F.col("rank") % F.col("b")).alias("block")).agg(F.count("*").alias("times"))
    # The first source_size % blocks blocks have a word more than the others.
    base, extra = F.floor(F.col("source_size") / F.col("blocks")), F.col("source_size") % F.col("blocks")

    def block_of(at):
        return F.when(at < extra * (base + 1), F.floor(at / (base + 1))).otherwise(extra + F.floor((at - extra * (base + 1)) / base))

    def begin(j):
        return j * base + F.least(j, extra)

    end = F.col("start") + F.col("size")
    parts = laid.filter("size > 0").withColumn("block", F.explode(F.sequence(block_of(F.col("start")), block_of(end - 1))))
    words = F.least(end, begin(F.col("block") + 1)) - F.greatest(F.col("start"), begin(F.col("block")))
    got = parts.select("sid", "start", "block", words.alias("words")).join(taken, ["sid", "block"]).groupBy(F.col("sid").alias("_sid"), F.col("start").alias("_start")).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    joined = laid.join(got, (F.col("sid") == F.col("_sid")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
    return joined.select("doc_id", "text_key", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number; only one document of a source is cut."""
    took = mix(docs).groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    often = took.withColumn("copies", copies).filter("copies > 0").select("id", "key", "copies")
    # the input row as one column, so that its names can't clash with those used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own"), F.xxhash64("text").alias("own_key"))
    joined = rows.join(often.hint("shuffle_hash"), F.col("own").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
