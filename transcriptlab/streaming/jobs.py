"""Structured Streaming forms of the history jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import rolling_health
from ..sources.io import ATTEMPT


def attempt_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", files).json(path)


def unique_chunks(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (run, index) once, forgotten after the watermark."""
    return stream.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["run_id", "index"])


def rolling(stream: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    flagged = stream.withColumn("paste_success", F.col("status").isin("paste_attempted", "finalizer_replaced"))
    return rolling_health(flagged.withWatermark("created_at", late), length, slide)


def ready_chunks(chunks: DataFrame, now: float, hold: float = 0.25) -> DataFrame:
    """chunks (run_id, index, written_at) that may be read: all but the newest of a run, and that once it has been still for ``hold`` seconds.

    ``pending`` tells whether the run still has a chunk that may not be read, which blocks its update.
    """
    newest = chunks.groupBy("run_id").agg(F.max("index").alias("_last"), F.max_by("written_at", "index").alias("_at"))
    waits = F.col("_at") > now - hold
    met = chunks.join(newest, "run_id").withColumn("pending", waits)
    return met.filter((F.col("index") < F.col("_last")) | ~waits).drop("_last", "_at")


def funnel(events: DataFrame, length: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """(start, event, n): events by kind in tumbling windows; of a stream or, with late None, of a table."""
    rows = events.withWatermark("created_at", late) if late else events
    return rows.groupBy(F.window("created_at", length).alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event", "n")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """(session_id, start, n, kinds): runs of a visitor's events without a gap as long as this; of a stream or a table."""
    rows = events.withWatermark("created_at", late) if late else events
    found = rows.groupBy("session_id", F.session_window("created_at", gap).alias("w")).agg(F.count("*").alias("n"), F.size(F.collect_set("event")).alias("kinds"))
    return found.select("session_id", F.col("w.start").alias("start"), "n", "kinds")


def route_outcome(sessions: DataFrame) -> DataFrame:
    """sessions (risk, pending, timed_out, merged, reasons) with the route of each when it ends.

    no_risk without a risk; pending where chunks lack at the deadline; rejected where reasons stand against the update; partial where only a merged part is
    there; else safe.
    """
    none = F.size(F.coalesce("reasons", F.array().cast("array<string>"))) == 0
    route = F.when(~F.coalesce("risk", F.lit(False)), "no_risk").when(F.col("pending") & F.col("timed_out") & ~F.col("merged"), "pending").when(~none, "rejected").when(F.col("merged") & F.col("pending"), "partial").otherwise("safe")
    return sessions.withColumn("route", route)
