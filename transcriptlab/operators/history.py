"""Jobs over the history of attempts: health, rolling windows, sessions, best rows, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import percentiles as percentile_table
from .reports import exclusive

#: Rank of an attempt's status: a final text is worth more than a first paste.
STATUS_RANK = {"finalizer_replaced": 4, "paste_attempted": 3, "copy_fallback": 2, "no_speech": 1, "failed": 0}


def _rank():
    return F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])[F.col("status")]


def newest(attempts: DataFrame, n: int) -> DataFrame:
    return attempts.orderBy(F.col("ordinal").desc()).limit(n)


def health(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("paste_success").cast("int")), 4).alias("success_rate"), F.round(F.avg((F.col("status") == "no_speech").cast("int")), 4).alias("blank_rate"), F.round(F.percentile("release_to_paste", F.lit(0.5)), 4).alias("p50"), F.round(F.percentile("release_to_paste", F.lit(0.95)), 4).alias("p95"))


def status_counts(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("release_to_paste").isNull()).alias("without_time"))


def percentiles(attempts: DataFrame, p: float = 0.95) -> DataFrame:
    """The same quantile by five definitions."""
    timed = attempts.filter("release_to_paste IS NOT NULL")
    linear = timed.groupBy("status").agg(F.round(F.percentile("release_to_paste", F.lit(p)), 4).alias("linear"))
    placed = percentile_table(timed, "status", "release_to_paste", p, ("half_even", "floor", "half_up"))
    opened = exclusive(timed, "status", "release_to_paste", p).select(F.col("status").alias("_open"), F.round("value", 4).alias("exclusive"))
    linear = linear.join(opened, F.col("status").eqNullSafe(F.col("_open"))).drop("_open")
    both = linear.join(placed.withColumnRenamed("status", "_status"), F.col("status").eqNullSafe(F.col("_status")))
    return both.select("status", "linear", "exclusive", *[F.round(m, 4).alias(m) for m in ("half_even", "floor", "half_up")])


def rolling_health(attempts: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and success over tumbling or sliding windows; the same function serves a stream with a watermark."""
    window = F.window("created_at", length, slide) if slide else F.window("created_at", length)
    return attempts.groupBy(window.alias("w")).agg(F.count("*").alias("n"), F.count_if("paste_success").alias("successes")).select(F.col("w.start").alias("start"), "n", "successes")


def sessions(attempts: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's attempts without a gap as long as this."""
    found = attempts.groupBy("user_id", F.session_window("created_at", gap).alias("w")).agg(F.count("*").alias("n"), F.count_if("paste_success").alias("successes"))
    return found.select("user_id", F.col("w.start").alias("start"), "n", "successes")


def best_per_audio(attempts: DataFrame) -> DataFrame:
    """The best attempt of each recording: status, then the newest.  An aggregate, so that a recording's rows needn't be sorted."""
    best = attempts.groupBy("audio_path").agg(F.max_by(F.struct("run_id", "status"), F.struct(_rank(), "created_at", "ordinal")).alias("x"), F.count("*").alias("n"))
    return best.select("audio_path", "x.run_id", "x.status", "n")


def feedback_asof(events: DataFrame, feedback: str = "purchase") -> DataFrame:
    """Each feedback event with the newest earlier event of the same user that isn't feedback; -1 without one."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col("event_type") != feedback, F.col("event_id"))
    return events.withColumn("attempt_id", F.last(at, ignorenulls=True).over(before)).filter(F.col("event_type") == feedback).select("event_id", "user_id", F.coalesce("attempt_id", F.lit(-1).cast("long")).alias("attempt_id"))


def pending(work: DataFrame, results: DataFrame, redo: tuple[str, ...] = ("failed",)) -> DataFrame:
    """Recordings to be done: without a result, or whose newest result has a status that is done again."""
    last = results.groupBy("audio_path").agg(F.max_by("status", "ordinal").alias("status"))
    done = last.filter(~F.col("status").isin(*redo)).select("audio_path")
    return work.select("audio_path").distinct().join(done, "audio_path", "left_anti")
