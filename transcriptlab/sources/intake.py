"""Readers of foreign formats, cleaning of what comes in, and upserts of small rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import BLANK, caption_text, stripped

# Events that a site may send.
SITE_EVENTS = ("site viewed", "site cta clicked", "download requested", "language vote clicked", "demo switched", "builderr clicked", "builderr challenge clicked", "builder profile clicked")

_CAPTIONS = "events array<struct<tStartMs: bigint, dDurationMs: bigint, segs: array<struct<utf8: string>>>>"
_METRICS = "evt string, eid string, heard string, transcript_source string, mic_audio_quality_status string, mic_audio_b64 string, mic_audio_mime string"
_ROW = "id string, text string"


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, stop, text): captions of JSON files, a file's pieces of text joined; ones without a start or text are left out."""
    events = spark.read.schema(_CAPTIONS).json(path, multiLine=True).select(F.col("_metadata.file_name").alias("file"), F.explode("events").alias("e"))
    text = caption_text(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    start = F.col("e.tStartMs") / 1000.0
    rows = events.select("file", start.alias("start"), (start + F.coalesce("e.dDurationMs", F.lit(0)) / 1000.0).alias("stop"), text.alias("text"))
    return rows.filter("start IS NOT NULL AND text <> ''")


def read_session_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Replies with sound of session files (JSON arrays), with ids made of file name and event; the sound as bytes."""
    rows = spark.read.schema(_METRICS).json(path, multiLine=True).withColumn("_stem", F.regexp_replace("_metadata.file_name", r"\.[^.]*$", ""))
    rows = rows.filter((F.col("evt") == "conversationalReply") & (F.coalesce("mic_audio_b64", F.lit("")) != ""))
    return rows.select(F.concat("_stem", F.lit("__"), F.coalesce("eid", F.lit(""))).alias("id"), stripped(F.col("heard")).alias("heard"), F.col("transcript_source").alias("source"), F.col("mic_audio_quality_status").alias("quality"), F.coalesce("mic_audio_mime", F.lit("audio/webm")).alias("mime"), F.unbase64("mic_audio_b64").alias("audio"))


def read_rows(spark: SparkSession, path: str, schema: str = _ROW) -> DataFrame:
    """Rows of JSON files that hold an array of rows, or an object with such an array as ``rows`` or ``items``."""
    element = f"array<struct<{', '.join(': '.join(c.split(' ', 1)) for c in schema.split(', '))}>>"
    whole = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", element)
    boxed = F.from_json("value", f"rows {element}, items {element}")
    rows = F.when(F.ltrim("value").startswith("["), bare).otherwise(F.coalesce(boxed["rows"], boxed["items"]))
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def _firsts(spark: SparkSession, path: str, values: dict[str, Column]) -> DataFrame:
    """The first line of each key; files in the order of their names, lines in theirs."""
    lines = spark.read.text(path).select(F.regexp_extract_all("value", F.lit(r"\S+"), F.lit(0)).alias("p"), F.trim("value").alias("line"), F.struct("_metadata.file_path", F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    rows = lines.filter(F.size("p") >= 2).select(F.col("p")[0].alias("utterance"), F.struct(*[c.alias(n) for n, c in values.items()]).alias("v"), "at")
    rows = rows.filter(F.forall(F.array(*[F.col(f"v.{n}").isNotNull() for n in values]), lambda x: x))
    return rows.groupBy("utterance").agg(F.min_by("v", "at").alias("v")).select("utterance", "v.*")


def read_utterances(spark: SparkSession, root: str) -> DataFrame:
    """(utterance, text, recording, start, stop, wav) of folders with ``text``, ``segments`` and ``wav.scp`` files.

    The first line of a key counts; malformed lines and sound that comes from a command are left out.  An utterance without a
    segment is a recording of its own.
    """
    rest = F.regexp_replace("line", r"^\S+\s+", "")
    text = _firsts(spark, f"{root}/*/text", {"text": rest})
    part = lambda i: F.get("p", F.lit(i))
    segments = _firsts(spark, f"{root}/*/segments", {"recording": part(1), "start": F.expr("try_cast(get(p, 2) AS double)"), "stop": F.expr("try_cast(get(p, 3) AS double)")})
    wavs = _firsts(spark, f"{root}/*/wav.scp", {"wav": F.when(~F.contains(rest, F.lit("|")), rest)}).withColumnRenamed("utterance", "recording")
    rows = text.join(segments, "utterance", "left").withColumn("recording", F.coalesce("recording", "utterance"))
    return rows.join(wavs, "recording", "left").select("utterance", "text", "recording", "start", "stop", "wav")


def clean_web_events(events: DataFrame) -> DataFrame:
    """(event, session, target, location): events that a site may send; values with other characters get a stand-in."""

    def clean(name: str, most: int, otherwise: str) -> Column:
        value = F.substring(stripped(F.col(name)), 1, most)
        return F.when(value.rlike("^[a-zA-Z0-9_+./ -]+$"), value).otherwise(otherwise)

    rows = events.select(clean("event", 48, "").alias("event"), clean("session", 96, "ephemeral").alias("session"), clean("target", 64, "unknown").alias("target"), clean("location", 96, "/").alias("location"))
    return rows.filter(F.col("event").isin(*SITE_EVENTS))


def phrase_fixes(fixes: DataFrame) -> DataFrame:
    """(source, replacement): approved fixes with a note that aren't switched off."""
    full = lambda c: stripped(F.col(c)) != ""
    kept = full("source") & full("replacement") & full("note") & F.coalesce("approved", F.lit(False)) & F.coalesce("enabled", F.lit(True))
    return fixes.filter(kept).select(stripped(F.col("source")).alias("source"), stripped(F.col("replacement")).alias("replacement"))


def check_fixes(delta: DataFrame, most: int = 120) -> DataFrame:
    """delta (source, replacement, note) with white space joined and ``problem``: why a fix can't be taken, else null."""
    plain = lambda c: stripped(F.regexp_replace(F.col(c), BLANK, " "))
    rows = delta.select(plain("source").alias("source"), plain("replacement").alias("replacement"), stripped(F.col("note")).alias("note"))
    problem = (
        F.when((F.col("source") == "") | (F.col("replacement") == ""), "empty")
        .when(F.lower("source") == F.lower("replacement"), "same")
        .when((F.length("source") > most) | (F.length("replacement") > most), "long")
        .when(F.col("note") == "", "no note")
    )
    return rows.withColumn("problem", problem)


def upsert_fixes(base: DataFrame, delta: DataFrame) -> DataFrame:
    """base (source, replacement, enabled, approved, note) with the valid fixes of delta, which replace those of the same source, whatever its case."""
    good = check_fixes(delta).filter("problem IS NULL").groupBy(F.lower("source").alias("k")).agg(F.max(F.struct("source", "replacement", "note")).alias("d"))
    b = base.select(F.lower(F.trim("source")).alias("k"), F.struct("source", "replacement", "enabled", "approved", "note").alias("b"))
    new = F.col("d").isNotNull()
    pick = lambda c: F.when(new, F.col(f"d.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    yes = lambda c: F.when(new, True).otherwise(F.col(f"b.{c}")).alias(c)
    return b.join(good, "k", "full").select(pick("source"), pick("replacement"), yes("enabled"), yes("approved"), pick("note"))


def merge_review(clips: DataFrame, review: DataFrame, fields: tuple[str, ...] = ("audio", "gold", "source", "category", "language")) -> DataFrame:
    """clips with the fields that review gives for them, and review's other clips; columns of clips."""
    c, r = clips.alias("c"), review.alias("r")
    both = [F.coalesce(f"r.{n}", f"c.{n}").alias(n) if n in fields and n in review.columns else F.col(f"c.{n}") for n in clips.columns if n != "id"]
    return c.join(r, F.col("c.id") == F.col("r.id"), "full").select(F.coalesce("c.id", "r.id").alias("id"), *both)


def split_confirmed(rows: DataFrame, full: str, confirmed: str, status: str = "confirmed") -> None:
    """Writes all rows, and the confirmed ones beside them; the second is read from the first, so that both agree."""
    rows.write.mode("overwrite").parquet(full)
    rows.sparkSession.read.parquet(full).filter(F.col("status") == status).write.mode("overwrite").parquet(confirmed)


def dictionary_version(dictionary: DataFrame, version: str = "unversioned") -> DataFrame:
    """One row, ``version:digest``, the same whatever the order of rows.  dictionary: a small table (canonical, aliases)."""
    line = F.concat_ws("\t", "canonical", F.array_join(F.array_sort("aliases"), ","))
    digest = F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256), 1, 12)
    return dictionary.agg(F.concat(F.lit(version + ":"), digest).alias("version"))


def intake_rows(prompts: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """A row for each prompt (prompt_id, text) and language whose recording is still to be made."""
    each = F.posexplode(F.array(*map(F.lit, languages)))
    rows = prompts.select("prompt_id", "text", each.alias("n", "language"))
    return rows.select(F.concat_ws("_", "prompt_id", F.lpad((F.col("n") + 1).cast("string"), 2, "0")).alias("id"), "language", F.col("text").alias("gold"), F.lit("").alias("audio"), F.lit("to_record").alias("status"))
