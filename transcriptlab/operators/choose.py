"""Jobs that choose between a quick transcript and later ones under rules of safety."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import texts as X
from ..functions.meaning import listed

#: Second passes in the order in which they may replace a draft.
ACTIONS = ("fallbackRescue", "structure", "termPolish", "hindiPolish", "processSecondPass", "finalizer")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(X.filled(text), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0)))


def segment_usable(text: Column, error: Column) -> Column:
    return (X.filled(error) == "") & ~X.no_speech(text) & ~X.degenerate(text) & (word_count(text) >= 3)


def segment_choice(segments: DataFrame, mode: str = "auto") -> DataFrame:
    """segments (fast, fast_error, second, second_error: texts, null for none) with ``chosen`` (fast or second) and its text.

    mode fast keeps the quick text, second prefers the other where it is usable; auto takes the second where only it is usable, where it has two markers
    of Hindi or more, more than the quick one, and isn't much shorter, or where it has one and the quick text reads like a lossy translation.
    """
    fast, second = segment_usable(F.col("fast"), F.col("fast_error")), F.col("second").isNotNull() & segment_usable(F.col("second"), F.col("second_error"))
    marks = lambda c: F.size(F.array_intersect(R.letters(F.col(c)), listed(R.SEGMENT_MARKERS)))
    richer = (F.col("_m2") >= 2) & (F.col("_m2") > F.col("_m1")) & (word_count(F.col("second")) >= F.greatest(F.lit(4), F.floor(word_count(F.col("fast")) * 0.55)))
    lost = (F.col("_m2") >= 1) & R.translation_loss(F.col("fast"))
    auto = F.when(~F.col("_u2"), False).when(~F.col("_u1"), True).otherwise(richer | lost)
    takes = {"fast": F.lit(False), "second": F.col("_u2"), "auto": auto}[mode]
    rows = segments.withColumn("_u1", fast).withColumn("_u2", second).withColumn("_m1", marks("fast")).withColumn("_m2", marks("second"))
    rows = rows.withColumn("chosen", F.when(takes, "second").otherwise("fast")).withColumn("text", X.filled(F.when(F.col("chosen") == "second", F.col("second")).otherwise(F.col("fast"))))
    return rows.drop("_u1", "_u2", "_m1", "_m2")


def best_safe(first: DataFrame, candidates: DataFrame, most_seconds: float, bonus: dict[str, float]) -> DataFrame:
    """(id, backend, text, seconds, reason): the first text, or the best candidate that may replace it; of equals the first by name.

    first: id, text, seconds; candidates: id, backend, text, seconds.  The later of both times counts where a candidate is taken.
    """
    met = first.select("id", F.col("text").alias("draft"), F.col("seconds").alias("first_seconds")).join(candidates.select("id", "backend", "text", "seconds"), "id", "left")
    met = met.withColumn("verdict", R.candidate_verdict(F.col("draft"), F.col("text"), F.col("seconds"), most_seconds))
    score = F.round(R.selection_score(F.col("draft"), F.col("text"), F.col("seconds"), F.col("backend"), bonus), 6)
    order = F.when(F.col("backend").isNotNull() & F.col("verdict.accepted"), F.struct((-score).alias("s"), "backend"))
    best = met.groupBy("id", "draft", "first_seconds").agg(F.min_by(F.struct("backend", "text", "seconds"), order).alias("x"))
    taken = F.col("x").isNotNull()
    return best.select(
        "id", F.when(taken, F.col("x.backend")).otherwise("server").alias("backend"), F.when(taken, F.col("x.text")).otherwise(F.col("draft")).alias("text"),
        F.when(taken, F.greatest("first_seconds", "x.seconds")).otherwise(F.col("first_seconds")).alias("seconds"), F.when(taken, "best_safe_candidate").otherwise("no_safe_candidate").alias("reason"),
    )


def product_rows(first: DataFrame, polish: DataFrame) -> DataFrame:
    """(id, text, seconds, route, selected_from): first texts, or the second pass where that was accepted and has no error; its time is added only then.

    first: id, text, seconds; polish: id, text, seconds, accepted, error.
    """
    second = polish.select("id", F.col("text").alias("_t"), F.col("seconds").alias("_s"), (F.col("accepted") & (X.filled(F.col("error")) == "")).alias("_ok"))
    met = first.join(second, "id", "left")
    taken = F.coalesce("_ok", F.lit(False))
    return met.select("id", F.when(taken, F.col("_t")).otherwise(F.col("text")).alias("text"), (F.col("seconds") + F.when(taken, F.col("_s")).otherwise(0.0)).alias("seconds"), F.when(taken, "hindi_polish_replaced").otherwise("fast_kept").alias("route"), F.when(taken, "polish").otherwise("first").alias("selected_from"))


def polish_wanted(text: Column, route: Column, risk: Column, seconds: Column, most_seconds: float) -> Column:
    """struct(should, force): whether a second pass is tried: by a known risk or words of Hindi always, else for short recordings of the quick routes."""
    marked = X.filled(text).rlike(R.INDIC) | F.arrays_overlap(R.letters(text), listed("aap agar bhai haan hai hain hindi hinglish kaise kya matlab nahi nahin theek toh yaar yeh".split()))
    force = F.coalesce(risk, F.lit(False)) | marked
    quick = F.lower(X.stripped(route)).isin("fast_server_translate", "fast_server_native", "fast_server_native_process_fallback_skipped")
    return F.struct((force | (quick & F.coalesce(seconds <= most_seconds, F.lit(True)))).alias("should"), force.alias("force"))


def derived_backend(runs: DataFrame, source: str, name: str, rewritten: Column) -> DataFrame:
    """runs and, under a new name, those of one backend with their text rewritten where a rule fired: ``rules`` names them, ``derived_from`` their source.

    rewritten: struct(text, rules) over the run's columns.
    """
    base = runs.withColumn("rules", F.array().cast("array<string>")).withColumn("derived_from", F.lit(None).cast("string"))
    own = runs.filter(F.col("backend") == source).withColumn("_x", rewritten)
    fired = F.size("_x.rules") > 0
    new = own.withColumn("backend", F.lit(name)).withColumn("actual", F.when(fired, F.col("_x.text")).otherwise(F.col("actual"))).withColumn("rules", F.col("_x.rules")).withColumn("derived_from", F.lit(source)).drop("_x")
    return base.unionByName(new)


def winning_action(outcomes: DataFrame, order: tuple[str, ...] = ACTIONS) -> DataFrame:
    """(id, action, text): of each draft's accepted second passes (id, action, accepted, text) the first in order; actions out of it never win."""
    place = reduce(lambda c, x: F.when(F.col("action") == x[1], x[0]).otherwise(c), enumerate(order), F.lit(None).cast("int"))
    good = outcomes.filter("accepted").withColumn("_p", place).filter("_p IS NOT NULL")
    return good.groupBy("id").agg(F.min_by(F.struct("action", "text"), "_p").alias("x")).select("id", "x.action", "x.text")
