"""Transcripts of one clip by several models: the largest agreement among so many of them, and what follows from it.

Two transcripts of a clip that name one language and are alike make an edge.  Sets grow by a model at a time: a set's last model gives the
next, and that must have an edge with each of the others, found by a join.  So only sets that hold at every step are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alignment import common_blocks

# Number words that are compared as digits, and the classes of language that can be confirmed.
NUMBERS = {word: str(n) for n, word in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}
CLASSES = ("english_only", "hindi_english")
UNSURE = "uncertain"
ALIKE = 0.88


def compared(text: Column) -> Column:
    """Words for comparison: letters and digits, Devanagari too, number words as digits."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\x{0900}-\x{097F}]+", " "), " "), lambda w: w != "")
    digits = F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(digits, w), w))


def word_likeness(a: Column, b: Column) -> Column:
    """Twice the words that two arrays share in blocks, as a share of the words of both; 1 if both are empty."""
    shared = F.aggregate(common_blocks(a, b), F.lit(0), lambda n, x: n + x["size"])
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(2.0 * shared / F.greatest(F.size(a) + F.size(b), F.lit(1)))


def agreeing(votes: DataFrame, k: int, alike: float = ALIKE) -> DataFrame:
    """(id, members, score) for each clip that has k models, by place, of which every two agree: those whose least likeness is largest.

    votes: id, place (of the model, unique in a clip), language_class, words.  Ties go to the first places.
    """
    sure = votes.filter(F.col("language_class").isin(*CLASSES) & (F.size("words") > 0)).select("id", "place", F.col("language_class").alias("kind"), "words")
    if k < 2:
        return sure.limit(0).select("id", F.array("place").alias("members"), F.lit(0.0).alias("score"))
    other = sure.select("id", "kind", F.col("place").alias("next"), F.col("words").alias("_words"))
    pairs = sure.join(other, ["id", "kind"]).filter("place < next")
    edges = pairs.withColumn("s", word_likeness(F.col("words"), F.col("_words"))).filter(F.col("s") >= alike).select("id", "place", "next", "s")
    sets = edges.select("id", F.array("place", "next").alias("members"), F.col("s").alias("score"))
    for size in range(2, k):
        step = edges.select("id", F.col("place").alias("last"), "next", "s")
        grown = sets.withColumn("last", F.element_at("members", -1)).join(step, ["id", "last"]).select("id", "members", F.least("score", "s").alias("score"), "next")
        for i in range(size - 1):
            grown = grown.withColumn("last", F.col("members")[i]).join(step, ["id", "last", "next"]).select("id", "members", F.least("score", "s").alias("score"), "next")
        sets = grown.select("id", F.concat("members", F.array("next")).alias("members"), "score")
    best = F.min_by(F.struct("members", "score"), F.struct(-F.col("score"), F.col("members"))).alias("best")
    return sets.groupBy("id").agg(best).select("id", "best.members", "best.score")


def confirmed(clips: DataFrame, votes: DataFrame, k: int = 2, alike: float = ALIKE) -> DataFrame:
    """(id, status, language_class, text, reason) for each of clips (id, gold, bucket), by votes (id, place, model, ok, transcript, language_class, confidence).

    cloud_failed without a good vote: gold and bucket stay.  cloud_confirmed where k models agree: their class, and the text of the surest of
    them, the longest on ties.  Else needs_human_review, with the surest good text and the class that two name, or the only one.
    """
    good = votes.filter(F.coalesce("ok", F.lit(False)) & (F.coalesce("transcript", F.lit("")) != "")).withColumn("words", compared(F.col("transcript")))
    sets = agreeing(good, k, alike)
    held = good.join(sets, "id", "left").withColumn("inside", F.coalesce(F.array_contains("members", F.col("place")), F.lit(False)))
    surest = F.struct((~F.col("inside")).alias("o"), (-F.coalesce("confidence", F.lit(0.0))).alias("c"), (-F.length("transcript")).alias("l"), "place")
    named = F.col("language_class").isin(*CLASSES, UNSURE)
    facts = held.groupBy("id").agg(
        F.count("*").alias("n"),
        F.min_by("transcript", surest).alias("best"),
        F.max("inside").alias("agree"),
        F.min_by("language_class", F.when(F.col("inside"), F.col("place"))).alias("agreed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("inside"), F.struct("place", "model")))), lambda x: x["model"]), ", ").alias("models"),
        F.sum(named.cast("int")).alias("m"),
        *[F.sum((F.col("language_class") == c).cast("int")).alias(c) for c in (*CLASSES, UNSURE)],
    )
    most = F.greatest(*[F.coalesce(c, F.lit(0)) for c in (*CLASSES, UNSURE)])
    first = F.coalesce(*[F.when(F.col(c) == most, c) for c in (*CLASSES, UNSURE)])
    major = F.when((F.col("m") > 0) & ((most >= 2) | (F.col("m") == 1)), first).otherwise(UNSURE)
    rows = clips.select("id", "gold", "bucket").join(facts, "id", "left")
    none, few = F.col("n").isNull(), F.col("n") < k
    kind = F.when(none, F.coalesce("bucket", F.lit(UNSURE))).when(~few & F.col("agree"), F.col("agreed")).otherwise(major)
    status = F.when(none, "cloud_failed").when(~few & F.col("agree"), "cloud_confirmed").otherwise("needs_human_review")
    reason = (
        F.when(none, "no successful result")
        .when(few, F.format_string(f"only %d successful transcript(s); need {k}", "n"))
        .when(F.col("agree"), F.concat(F.lit(f"{k} models agree on transcript and language class: "), "models"))
        .when(major != UNSURE, "language class resolved but no confirming transcript subset")
        .otherwise("classification uncertain")
    )
    return rows.select("id", status.alias("status"), kind.alias("language_class"), F.when(none, F.coalesce("gold", F.lit(""))).otherwise(F.col("best")).alias("text"), reason.alias("reason"))
