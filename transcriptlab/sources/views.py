"""Transcript tables derived from the given tables by integer arithmetic, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import TOKEN, WORDS, let, tokens

#: Tokens of an utterance, as in the SQL below: a document is cut into utterances, all of them kept, and each is a clip.  None within
#: ``whole``, where a document is one clip.
MOST: ContextVar[int | None] = ContextVar("most", default=40)
#: A clip's number is its document's times this, and its place.
STEP = 1_000_003
BACKENDS = ((0, "fast"), (1, "accurate"), (2, "tiny"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def whole() -> Iterator[None]:
    """Views built here have all tokens of each document, and the last of its drafts all of them too."""
    before = MOST.set(None)
    try:
        yield
    finally:
        MOST.reset(before)


def spread(df: DataFrame) -> DataFrame:
    """A table dealt out to all cores where its files alone give fewer partitions, as a small file does; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    trust = F.when(F.col("quality") == 1, "gold").when(F.col("quality") == 0, "silver").otherwise("needs_human_review")
    named = spread(docs.select("doc_id", "lang", "source", "text")).join(labels, "doc_id", "left").select("doc_id", F.col("lang").alias("category"), "source", trust.alias("trust"), tokens(F.col("text"), lower=False).alias("words"))
    most = MOST.get()
    if most is None:
        parts = named.withColumn("part", F.lit(0)).withColumnRenamed("words", "toks")
    else:

        def cut(words: Column) -> Column:
            last = F.greatest(F.lit(1), F.ceil(F.size(words) / most)).cast("int") - 1
            return F.transform(F.sequence(F.lit(0), last), lambda p: F.struct(p.alias("part"), F.slice(words, p * most + 1, F.lit(most)).alias("toks")))

        # the utterances are exploded, not their places: a row holds its own words, not all of its document's
        parts = named.select("doc_id", "category", "source", "trust", F.inline(let(F.col("words"), cut)))
    number = F.col("doc_id") * STEP + F.col("part") if most is not None else F.col("doc_id")
    parts = parts.select(number.alias("doc_id"), "category", "source", "trust", "toks", F.array_join("toks", " ").alias("gold"))
    return parts.select("doc_id", F.concat(F.lit("clip_"), "doc_id").alias("id"), "category", "source", "toks", "gold", (F.length("gold") / 15.0).alias("audio_seconds"), "trust")


@F.arrow_udf(WORDS)
def _heard(toks: pa.Array, doc: pa.Array, b: pa.Array) -> pa.Array:
    """What a backend hears of words: some are lost, some replaced, by the numbers of the clip, the backend and the place."""
    flat, n = toks.flatten(), pc.fill_null(toks.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    place = np.arange(1, len(flat) + 1) - np.repeat(ends - n, n)
    d, b = pc.fill_null(doc, 0).to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False).astype(np.int64)
    known = np.repeat(doc.is_valid().to_numpy(zero_copy_only=False), n)
    every = 9 - 2 * b
    lost = (np.repeat((d * 7 + b * 3) % every, n) + place * 5) % np.repeat(every, n) == 0
    other = (np.repeat((d + b) % 11, n) + place * 3) % 11 == 0
    kept = ~(lost & known)
    if flat.null_count:
        kept &= flat.is_valid().to_numpy(zero_copy_only=False) | (other & known)
    words = pc.if_else(pa.array(other & known), pa.scalar("zz", flat.type), flat).filter(pa.array(kept))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept))[np.append(0, ends)].astype(np.int32)), words)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clips x backends, with each backend's errors; a work list is an array that is exploded, not a cross join."""
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(n).alias("backend")) for b, n in BACKENDS]))
    rows = clips(spark, sf_dir).withColumn("x", each).select("*", "x.b", "x.backend")

    hyp = _heard("toks", F.col("doc_id").cast("long"), "b")
    flags = F.when((F.col("doc_id") + F.col("b")) % 37 == 0, "minor, negation_flip").when((F.col("doc_id") + F.col("b")) % 31 == 0, "minor")
    return rows.withColumn("hyp", hyp).select("doc_id", "id", "category", "source", "trust", "backend", "toks", "hyp", "gold", F.array_join("hyp", " ").alias("actual"), (((F.col("doc_id") * 37 + F.col("b") * 113) % 900) / 100.0).alias("seconds"), F.when((F.col("doc_id") + F.col("b")) % 41 == 0, "timeout").alias("error"), flags.alias("quality_flags"))


def wide_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, gold, a column for each backend): what each heard of a clip, null where it failed; equal texts of a doc_id once."""
    # words are what stands between a reference's blanks, so that it alone is moved
    rows = clips(spark, sf_dir).select("doc_id", "gold").distinct().withColumn("toks", tokens(F.col("gold"), lower=False))
    heard = rows.select("doc_id", "gold", *[_heard("toks", F.col("doc_id").cast("long"), F.lit(b)).alias(n) for b, n in BACKENDS])
    failed = lambda b: F.coalesce((F.col("doc_id") + b) % 41 == 0, F.lit(False))
    return heard.select("doc_id", "gold", *[F.when(~failed(b), F.array_join(n, " ")).alias(n) for b, n in BACKENDS])


def trapped_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """runs with failure_traps by number, as the given tables have none; a quarter of the clips have no trap."""
    traps = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("noise"))).when(F.col("doc_id") % 4 == 1, F.array(F.lit("terms"), F.lit("noise"))).when(F.col("doc_id") % 4 == 3, F.array(F.lit("negation")))
    return runs(spark, sf_dir).withColumn("failure_traps", traps)


def corrected_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, line): conversations in which every third turn swaps the first two words of the one before it."""
    two = F.lag(F.slice(tokens(F.col("text"), lower=False), F.lit(1), F.lit(2))).over(Window.partitionBy("conv_id").orderBy("turn"))
    line = F.when((F.col("turn") % 3 == 2) & (F.size(two) == 2), F.concat_ws(" not ", two[1], two[0])).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.create_map(*[F.lit(x) for x in ("view", "paste_attempted", "click", "finalizer_replaced", "purchase", "copy_fallback", "signup", "no_speech", "error", "failed")])
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ordinal"), F.concat(F.lit("r"), "event_id").alias("run_id"), F.col("ts").alias("created_at"), "user_id", status[F.col("event_type")].alias("status"), F.col("event_type").isin("view", "click").alias("paste_success"), F.when(~F.col("event_type").isin("signup", "error"), F.col("value") / 50.0).alias("release_to_paste"), F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("audio_path"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") / 15.0).alias("duration"), (((F.col("conv_id") * 17 + F.col("turn") * 29) % 70) / 10.0).alias("compute")).withColumn("end", F.sum("duration").over(upto))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("turn") * 6.0).alias("start"), (F.col("turn") * 6.0 + 4 + F.col("conv_id") % 5).alias("stop"))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a clip's words are moved before its drafts repeat them, so that jobs over a clip's drafts need no shuffle of these
    rows = clips(spark, sf_dir).select("doc_id", "toks").repartition("doc_id").select("doc_id", "toks", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("k"))
    step = F.lit(5) if MOST.get() is not None else F.greatest(F.lit(5), F.ceil(F.size("toks") / 8))
    words = F.slice("toks", F.lit(1), (F.col("k") * step).cast("int"))
    changed = F.when(((F.col("doc_id") + F.col("k")) % 3 == 0) & (F.size(words) > 0), F.concat(F.slice(words, F.lit(1), F.size(words) - 1), F.array(F.lit("zz")))).otherwise(words)
    return rows.select("doc_id", "k", (F.col("k") * 1500).alias("t_ms"), changed.alias("words"))


#: States of attempts in turn.
STATES = ("too_short", "paste_attempted", "paste_attempted", "finalizer_replaced", "no_speech", "copy_fallback", "paste_attempted")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts with texts: every turn of a conversation, with what was heard, pasted and corrected; two turns share a recording."""
    rows = table(spark, sf_dir, "conversations").withColumn("ordinal", F.col("conv_id") * 1000 + F.col("turn"))
    status = F.get(F.array(*map(F.lit, STATES)), ((F.col("conv_id") + F.col("turn")) % 7).cast("int"))
    pasted = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), "text")).when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" ok")))
    corrected = F.when(F.col("conv_id") % 4 == 0, "").when(F.col("conv_id") % 4 == 1, F.concat("text", F.lit(" with the API model")))
    app = F.when(F.col("conv_id") % 3 == 0, "Codex").when(F.col("conv_id") % 3 == 1, "Notes")
    rows = rows.select("ordinal", F.concat(F.lit("r-"), "conv_id", F.lit("-"), "turn").alias("run_id"), F.concat(F.lit("a"), "conv_id", F.lit("_"), F.floor(F.col("turn") / 2)).alias("audio_path"), status.alias("status"), F.when(F.col("ordinal") % 13 == 0, "blank_or_no_speech").alias("error_type"), F.col("text").alias("raw_text"), pasted.alias("pasted_text"), corrected.alias("corrected_text"), (F.length("text") / 15.0).alias("seconds"), app.alias("app"))
    return rows.withColumn("paste_success", F.col("status").isin("paste_attempted", "finalizer_replaced", "copy_fallback"))


SQL = {
    "clips": f"""clips AS (SELECT *, length(gold) / 15.0 AS audio_seconds FROM (SELECT *, 'clip_' || doc_id AS id, array_to_string(toks, ' ') AS gold FROM (
      SELECT doc_id * {STEP} + part AS doc_id, category, source, trust, list_slice(words, part * 40 + 1, part * 40 + 40) AS toks FROM (SELECT *, unnest(range(greatest(1, (len(words) + 39) // 40))) AS part FROM (
        SELECT d.doc_id, d.lang AS category, d.source, regexp_extract_all(d."text", '{TOKEN}') AS words, CASE l.quality WHEN 1 THEN 'gold' WHEN 0 THEN 'silver' ELSE 'needs_human_review' END AS trust FROM documents d LEFT JOIN labels l USING (doc_id))))))""",
    "runs": """runs AS (SELECT *, array_to_string(hyp, ' ') AS actual FROM (SELECT c.doc_id, c.id, c.category, c.source, c.trust, c.toks, c.gold, b.backend,
      list_filter(list_transform(c.toks, lambda x, i: CASE WHEN (c.doc_id * 7 + i * 5 + b.b * 3) % (9 - 2 * b.b) = 0 THEN NULL WHEN (c.doc_id + i * 3 + b.b) % 11 = 0 THEN 'zz' ELSE x END), lambda x: x IS NOT NULL) AS hyp,
      ((c.doc_id * 37 + b.b * 113) % 900) / 100.0 AS seconds, CASE WHEN (c.doc_id + b.b) % 41 = 0 THEN 'timeout' END AS error,
      CASE WHEN (c.doc_id + b.b) % 37 = 0 THEN 'minor, negation_flip' WHEN (c.doc_id + b.b) % 31 = 0 THEN 'minor' END AS quality_flags
      FROM clips c, (VALUES (0, 'fast'), (1, 'accurate'), (2, 'tiny')) b(b, backend)))""",
    "attempts": """attempts AS (SELECT event_id AS ordinal, 'r' || event_id AS run_id, ts AS created_at, user_id,
      CASE event_type WHEN 'view' THEN 'paste_attempted' WHEN 'click' THEN 'finalizer_replaced' WHEN 'purchase' THEN 'copy_fallback' WHEN 'signup' THEN 'no_speech' WHEN 'error' THEN 'failed' END AS status,
      event_type IN ('view', 'click') AS paste_success, CASE WHEN event_type NOT IN ('signup', 'error') THEN value / 50.0 END AS release_to_paste,
      user_id || ':' || strftime(ts, '%Y-%m-%d') AS audio_path FROM events)""",
    "utterances": f"""utterances AS (SELECT *, status IN ('paste_attempted', 'finalizer_replaced', 'copy_fallback') AS paste_success FROM (SELECT conv_id * 1000 + turn AS ordinal, 'r-' || conv_id || '-' || turn AS run_id, 'a' || conv_id || '_' || (turn // 2) AS audio_path,
      [{", ".join(f"'{x}'" for x in STATES)}][(conv_id + turn) % 7 + 1] AS status, CASE WHEN (conv_id * 1000 + turn) % 13 = 0 THEN 'blank_or_no_speech' END AS error_type, "text" AS raw_text,
      CASE turn % 3 WHEN 0 THEN '  ' || "text" WHEN 1 THEN "text" || ' ok' END AS pasted_text, CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN "text" || ' with the API model' END AS corrected_text,
      length("text") / 15.0 AS seconds, CASE conv_id % 3 WHEN 0 THEN 'Codex' WHEN 1 THEN 'Notes' END AS app FROM conversations))""",
    "segments": """segments AS (SELECT conv_id, turn, duration, compute, sum(duration) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS stop
      FROM (SELECT conv_id, turn, length("text") / 15.0 AS duration, ((conv_id * 17 + turn * 29) % 70) / 10.0 AS compute FROM conversations))""",
    "captions": """captions AS (SELECT conv_id, turn, "text", turn * 6.0 AS start, turn * 6.0 + 4 + conv_id % 5 AS stop FROM conversations)""",
    "drafts": """drafts AS (SELECT doc_id, k, k * 1500 AS t_ms, CASE WHEN (doc_id + k) % 3 = 0 AND len(w) > 0 THEN list_append(list_slice(w, 1, len(w) - 1), 'zz') ELSE w END AS words
      FROM (SELECT doc_id, k, list_slice(toks, 1, k * 5) AS w FROM clips, range(1, 9) r(k)))""",
}


def with_views(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names)


# Words that second decodings bring in, roman and in Devanagari, and names that drafts hold.
ROMAN = tuple("karna sakta matlab samajh achcha paega kuchh bhai haan hai chahiye milega".split())
INDIC = tuple("करना देखा वह सब में और अगर मतलब नहीं हाँ यह ठीक ज़रूर चाहिए दें पर".split())
NAMES = ("API", "DataFrame", "MCP", "GPU")


def second_decodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, draft, candidate, witness, seconds): an utterance's first words, a second decoding of them with every kind of fault, and a third."""
    rows = clips(spark, sf_dir).filter(F.size("toks") >= 6).select("doc_id", F.transform(F.slice("toks", F.lit(1), (F.col("doc_id") % 17 + 6).cast("int")), F.lower).alias("w"))
    d = F.col("doc_id")
    of = lambda words, n: F.get(F.array(*map(F.lit, words)), (n % len(words)).cast("int"))
    name = F.when(d % 11 < 2, F.array(of(NAMES, d))).otherwise(F.array().cast("array<string>"))

    def heard(w, i):
        odd = d % 3 + d % 2  # a third of the utterances have hardly any faults
        near = F.concat(w, F.lit("e"))
        return (
            F.when((d + i * 3) % 19 < odd, near)
            .when((d * 5 + i) % 31 < odd, F.reverse(w))
            .when((d + i) % 29 == 0, F.lit(None).cast("string"))
            .when((d % 4 > 0) & ((d + i * 2) % 5 == 0), of(ROMAN, d + i))
            .otherwise(w)
        )

    said = F.filter(F.transform("w", heard), lambda w: w.isNotNull())
    more = F.transform(F.sequence(F.lit(1), (d % 7).cast("int") + 1), lambda i: of(ROMAN, d + i))
    indic = F.when(d % 5 == 0, F.array(of(INDIC, d), of(INDIC, d * 3 + 1)))
    parts = F.concat(F.when(d % 13 == 0, F.array().cast("array<string>")).otherwise(name), said, F.coalesce(indic, F.array().cast("array<string>")), F.when(d % 4 > 1, more).otherwise(F.array().cast("array<string>")), F.when(d % 41 == 0, F.array(*[F.lit("ok")] * 6)).otherwise(F.array().cast("array<string>")))
    candidate = F.when(d % 53 == 0, F.lit("  ")).when(d % 43 == 0, F.concat(F.array_join(parts, " "), F.lit(" �"))).when(d % 23 == 0, F.concat(F.array_join(parts, " "), F.lit(" and"))).otherwise(F.array_join(parts, " "))
    witness = F.array_join(F.transform("w", lambda w, i: F.when((d + i) % 2 == 0, F.concat(w, F.lit("s"))).when((d * 5 + i) % 31 == 0, F.reverse(w)).otherwise(w)), " ")
    return rows.select(d.alias("id"), F.array_join(F.concat(name, "w"), " ").alias("draft"), candidate.alias("candidate"), witness.alias("witness"), (d % 37 / 10.0).alias("seconds"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, frame, energy): the vectors of each label behind each other as the frames of one recording."""
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("rec_"), F.col("vec_id") % 64).alias("clip"), F.col("vec_id").alias("v"), F.posexplode("embedding").alias("at", "x"))
    return rows.select("clip", (F.floor(F.col("v") / 64) * 64 + F.col("at")).alias("frame"), F.abs("x").cast("double").alias("energy"))
