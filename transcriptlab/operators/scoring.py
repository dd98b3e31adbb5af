"""Scores of transcripts against reference text, and summaries of the systems that made them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import meaning as M


def score_runs(runs: DataFrame, mode: str = "meaning", terms: str | None = None) -> DataFrame:
    """runs with wer, meaning and term coverage, language preservation, repetition, the useful score and that of verbatim mode.

    runs: gold, actual, seconds, error; category, quality_flags and the words of both texts (toks, hyp) where there are such; terms names a column of expected terms, without
    which they are the reference's anchors.  Parts are rounded to 3 digits before they are used further, and the score last, where a half goes up; the flags use the unrounded score.
    Where no terms are expected their part is that of meaning.  In verbatim mode texts of mixed languages lose up to 0.35 of
    their score with the scripts that they lack.  A critical error caps the score at 0.5, and such a transcript is never usable.
    """
    words = lambda known, text: F.col(known) if known in runs.columns else C.tokens(F.col(text), lower=False)
    rows = runs.withColumn("_ref", words("toks", "gold")).withColumn("_hyp", words("hyp", "actual"))
    rows = rows.withColumn("_x", M.run_counts(F.col("_ref"), F.col("_hyp"), F.col("gold"), F.col("actual"), F.col(terms) if terms else None))
    rows = rows.withColumn("wer", C.error_rate(F.col("_x.errors"), F.col("_ref"), F.col("_hyp"))).withColumn("meaning_coverage", M.share(F.col("_x.wanted"), F.col("_x.met"))).withColumn("repeat", C.repeat_share(F.col("_x.copied"), F.col("_hyp")))
    rows = rows.withColumn("term_coverage", F.when(F.col("_x.terms") > 0, F.round(F.col("_x.heard") / F.col("_x.terms"), 3))).drop("_ref", "_hyp", "_x")
    rows = rows.withColumn("language_score", M.language_preservation(F.col("gold"), F.col("actual")))
    rows = rows.withColumn("critical", M.critical_error(F.col("actual"), F.col("quality_flags") if "quality_flags" in runs.columns else None))
    rows = rows.withColumn("literal_score", F.round(1 - F.least("wer", F.lit(1.0)), 3)).withColumn("speed_score", C.latency_score(F.col("seconds")))
    rows = rows.withColumn("reliability_score", F.when(F.col("error").isNotNull(), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - F.least("repeat", F.lit(1.0))), 3)))
    said = F.coalesce("term_coverage", "meaning_coverage")
    useful = 0.45 * F.col("meaning_coverage") + 0.20 * said + 0.15 * F.greatest(F.lit(0.0), 1 - F.least("wer", F.lit(1.0))) + 0.10 * F.col("speed_score") + 0.10 * F.col("reliability_score")
    mixed = M.mixed_language(F.col("category") if "category" in runs.columns else F.lit(None), F.col("gold"))
    verbatim = F.when(mixed, useful * (0.65 + 0.35 * F.col("language_score"))).otherwise(useful)
    capped = lambda c: F.when(F.col("critical"), F.least(c, F.lit(0.5))).otherwise(c)
    rows = rows.withColumn("_useful", capped(verbatim if mode == "verbatim" else useful)).withColumn("verbatim_score", F.round(capped(verbatim) + 1e-9, 3))
    clean = F.col("error").isNull() & (F.col("repeat") < 0.2)
    usable = (F.col("_useful") >= 0.75) & (F.col("seconds") <= 2.5) & clean & ~F.col("critical")
    return rows.withColumn("useful_score", F.round(F.col("_useful") + 1e-9, 3)).withColumn("usable", usable).withColumn("fast", F.col("seconds") <= 1.5).withColumn("hang_risk", (F.col("seconds") > 6) | ~clean).drop("_useful")


def mean(c: str) -> Column:
    """To 4 digits.  Means of 3-digit scores can lie on a half, where the order of summing would decide; they go up."""
    return F.round(F.avg(c) + 1e-9, 4)


def rate(flag: str) -> Column:
    return F.round(F.avg(F.col(flag).cast("int")), 4)


def leaderboard(scored: DataFrame) -> DataFrame:
    """One row for each backend; partial aggregates leave little to shuffle.  Quantiles of seconds need these alone, no scores; the score has a thousand values at most."""
    figures = scored.groupBy("backend").agg(
        F.count("*").alias("clips"), mean("useful_score").alias("avg_useful"), F.round(F.percentile("useful_score", F.lit(0.5)), 4).alias("median_useful"), mean("wer").alias("avg_wer"), mean("meaning_coverage").alias("avg_coverage"),
        rate("usable").alias("usable_rate"), rate("fast").alias("fast_rate"), rate("hang_risk").alias("hang_risk_rate"),
    )
    late = C.percentiles(scored, "backend", "seconds", 0.95, ("half_even",)).select("backend", F.round("half_even", 4).alias("p95_seconds"))
    middle = C.percentiles(scored, "backend", "seconds", 0.5, ("floor", "half_up")).select("backend", F.round((F.col("floor") + F.col("half_up")) / 2, 4).alias("p50_seconds"))
    return figures.join(middle, "backend").join(late, "backend").orderBy(F.col("avg_useful").desc(), "p50_seconds")


def category_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("category", "backend").agg(F.count("*").alias("n"), mean("wer").alias("wer"), F.round(F.avg(1 - F.col("meaning_coverage")), 4).alias("meaning_loss"), F.round(F.avg("seconds"), 4).alias("seconds"))


def bucket_rollup(scored: DataFrame) -> DataFrame:
    """For each backend its categories and all of them, from one aggregate over grouping sets."""
    sets = scored.groupingSets([[F.col("backend"), F.col("category")], [F.col("backend")]], F.col("backend"), F.col("category"))
    return sets.agg(F.count("*").alias("n"), mean("useful_score").alias("useful"), mean("wer").alias("wer")).select("backend", F.coalesce("category", F.lit("all")).alias("bucket"), "n", "useful", "wer")


def paired_delta(scored: DataFrame, a: str, b: str) -> DataFrame:
    """Mean difference a - b over the clips that both have, by category, with its 95 % interval.

    Pairs are formed by one aggregate on the clip and not by a self-join.
    """
    def of(backend: str, c: str) -> Column:
        return F.max(F.when(F.col("backend") == backend, F.col(c)))

    pairs = scored.filter(F.col("backend").isin(a, b)).groupBy("id", "category").agg(*[(of(a, c) - of(b, c)).alias(c) for c in ("useful_score", "wer", "seconds")])
    d = F.col("useful_score")
    half = 1.96 * F.stddev_samp(d) / F.sqrt(F.count(d))
    return pairs.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg(d), 4).alias("useful_delta"), mean("wer").alias("wer_delta"), F.round(F.avg("seconds"), 4).alias("seconds_delta"), F.round(F.avg(d) - half, 4).alias("low"), F.round(F.avg(d) + half, 4).alias("high"))


def quality_gate(scored: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Each backend's figures held against limits: at least for rates and scores, at most for seconds."""
    figures = scored.groupBy("backend").agg(F.percentile("seconds", F.lit(0.95)).alias("p95_seconds"), F.max("seconds").alias("max_seconds"), F.avg("useful_score").alias("useful"), F.avg(F.col("usable").cast("int")).alias("usable_rate"))
    long = figures.unpivot("backend", [F.col(c).cast("double") for c in limits], "metric", "value")
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("metric")]
    passed = F.when(F.col("metric").endswith("seconds"), F.col("value") <= limit).otherwise(F.col("value") >= limit)
    return long.select("backend", "metric", F.round("value", 4).alias("value"), limit.alias("threshold"), passed.alias("passed"))


def worst_runs(scored: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("backend", "category").orderBy("useful_score", "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("backend", "category", "rank", "id", "useful_score")
