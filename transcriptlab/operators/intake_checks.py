"""Jobs that pick attempts of the history for gold texts and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import texts as X


def joined_spaces(text: Column) -> Column:
    return F.regexp_replace(X.stripped(text), X.BLANK, " ")


def gold_candidates(attempts: DataFrame, newest: int, least_seconds: float = 2.0, least_chars: int = 20) -> DataFrame:
    """(audio_path, ordinal, text): recordings that gold texts may be built from, the newest of them by their first attempt.

    attempts: ordinal, audio_path, status, paste_success, error_type, seconds, raw_text, pasted_text, corrected_text.  An attempt counts if it
    was pasted without an error, lasted long enough, has a text of 20 characters or more (the raw one before others) and no Indic script.
    """
    text = joined_spaces(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("raw_text", "pasted_text", "corrected_text")]))
    rows = attempts.filter(X.filled(F.col("audio_path")) != "").withColumn("_text", text)
    good = rows.filter((F.col("status") == "paste_attempted") & F.coalesce("paste_success", F.lit(False)) & (X.filled(F.col("error_type")) == "") & (F.col("seconds") >= least_seconds) & (F.length("_text") >= least_chars) & ~F.col("_text").rlike(r"[\x{0900}-\x{0DFF}]"))
    one = good.groupBy("audio_path").agg(F.min_by(F.struct("ordinal", F.col("_text").alias("text")), "ordinal").alias("x"))
    return one.select("audio_path", "x.ordinal", "x.text").orderBy(F.col("ordinal").desc()).limit(newest)


def work_candidates(attempts: DataFrame, known: DataFrame, least_seconds: float = 1.5, least_chars: int = 25) -> DataFrame:
    """(candidate_id, run_id, words): attempts that are worth a review for what they say about work, without those already known (candidate_id).

    Left out: lost attempts, recordings known to be short, texts of failed recognition, short texts, and texts without a word of work.
    """
    text = joined_spaces(F.regexp_replace(X.effective_text(F.col("corrected_text"), F.col("pasted_text"), F.col("raw_text")), r"(?i)\[(?:BLANK_AUDIO|NOISE|SILENCE|INAUDIBLE)\]", " "))
    rows = attempts.filter((X.filled(F.col("audio_path")) != "") & ~R.lost_attempt(F.col("status"), F.col("error_type")) & ~F.coalesce(F.col("seconds") < least_seconds, F.lit(False))).withColumn("_text", text)
    failed = F.lower("_text").rlike("asr failure detected|transcript looks empty or repetitive|retry with language set")
    hits = rows.filter(~failed & (F.length("_text") >= least_chars)).withColumn("words", R.keyword_hits(F.col("_text"))).filter(F.size("words") > 0)
    named = hits.select(F.concat(F.lit("history_"), F.replace("run_id", F.lit("-"), F.lit("_"))).alias("candidate_id"), "run_id", "words")
    return named.join(known.select("candidate_id").distinct(), "candidate_id", "left_anti")


def later_success(attempts: DataFrame, rank: Column) -> DataFrame:
    """(audio_path, run_id): each recording's success of the best rank, of equals the later row."""
    good = attempts.filter(F.coalesce("paste_success", F.lit(False)))
    return good.groupBy("audio_path").agg(F.max_by("run_id", F.struct(rank, F.col("ordinal"))).alias("run_id"))
