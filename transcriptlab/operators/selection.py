"""Jobs that choose between candidate texts, score tools, and check, cut or count rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import meaning as M
from ..functions import texts as X
from .review import term_coverage


def first_usable(candidates: DataFrame) -> DataFrame:
    """(id, name, text, fell_back) for each id: of (id, name, place, text, error) the first usable text, else the first that isn't blank.

    Usable: no error, not blank, no marker of silence, no runaway repetition.  Where every text is blank: name "none".
    """
    words = C.tokens(F.col("text"))
    usable = F.col("error").isNull() & ~X.no_speech(F.col("text")) & ~X.looped(words)
    row, order = F.struct("name", "text"), F.struct("place", "name")
    best = candidates.groupBy("id").agg(F.min_by(row, F.when(usable, order)).alias("good"), F.min_by(row, F.when(X.stripped(F.col("text")) != "", order)).alias("any"))
    none = F.struct(F.lit("none").alias("name"), F.lit("").alias("text"))
    return best.select("id", F.coalesce("good", "any", none).alias("x"), F.col("good").isNull().alias("fell_back")).select("id", "x.name", "x.text", "fell_back")


def two_phase(first: DataFrame, candidates: DataFrame, policy: str, most_seconds: float = 2.5) -> DataFrame:
    """(id, first_score, score, seconds, polished_by): first rows, replaced by the best second pass that the policy lets in.

    Both: id, backend, useful_score, seconds, actual, error.  Policies: ``empty-only`` (only where the first text failed or is blank),
    ``oracle-any`` (only if better), ``oracle-under-limit`` (better, and quick).  Of equal scores the quicker, then the first by name, is taken.
    """
    failed = F.col("error").isNotNull() | (X.stripped(F.col("actual")) == "")
    base = first.select("id", F.col("useful_score").alias("first_score"), F.col("seconds").alias("first_seconds"), failed.alias("failed"))
    if policy == "oracle-under-limit":
        candidates = candidates.filter(F.col("seconds") <= most_seconds)  # slower ones need no scores
    met = base.join(candidates.select("id", F.col("backend").alias("polished_by"), "useful_score", "seconds"), "id", "left")
    better = F.col("useful_score") > F.col("first_score")
    allowed = {"empty-only": F.col("failed"), "oracle-any": better, "oracle-under-limit": better & (F.col("seconds") <= most_seconds)}[policy]
    # every candidate of a clip is one row of its group; there are as many as systems
    order = F.when(allowed & F.col("polished_by").isNotNull(), F.struct(-F.col("useful_score"), "seconds", "polished_by"))
    best = met.groupBy("id", "first_score", "first_seconds").agg(F.min_by(F.struct("useful_score", "seconds", "polished_by"), order).alias("x"))
    return best.select("id", "first_score", F.coalesce("x.useful_score", "first_score").alias("score"), F.coalesce("x.seconds", "first_seconds").alias("seconds"), F.coalesce("x.polished_by", F.lit("none")).alias("polished_by"))


def app_scores(results: DataFrame) -> DataFrame:
    """results with fact_coverage, term coverage, app_score, critical and usable.

    results: facts array<array<string>> (words of each fact), terms, actual, seconds, error, human_pasteable (null: unknown).
    Without terms their part is that of the facts; without facts these count as covered.  A missed term caps the score at 0.5.
    """
    parts = M.concept_coverage(F.col("facts"), C.tokens(F.col("actual"), lower=False))
    rows = term_coverage(results).withColumn("_parts", parts)
    facts = F.when(F.size("_parts") > 0, F.aggregate("_parts", F.lit(0.0), lambda a, x: a + x) / F.size("_parts")).otherwise(1.0)
    rows = rows.withColumn("_facts", facts).withColumn("critical", F.size("term_misses") > 0)
    terms = F.when(F.size("terms") > 0, F.size("term_hits") / (F.size("term_hits") + F.size("term_misses"))).otherwise(F.col("_facts"))
    human = F.when(F.col("human_pasteable"), 1.0).when(~F.col("human_pasteable"), 0.0).otherwise(0.5)
    score = 0.40 * F.col("_facts") + 0.20 * terms + 0.15 * human + 0.15 * C.latency_score(F.col("seconds")) + 0.10 * F.col("error").isNull().cast("double")
    rows = rows.withColumn("_score", F.when(F.col("critical"), F.least(score, F.lit(0.5))).otherwise(score))
    usable = (F.col("_score") >= 0.75) & F.col("error").isNull() & ~F.col("critical")
    return rows.withColumn("fact_coverage", F.round("_facts", 3)).withColumn("app_score", F.round("_score", 3)).withColumn("usable", usable).drop("_parts", "_facts", "_score")


def tool_summary(scored: DataFrame) -> DataFrame:
    """Figures of each tool with the worst mean over its failure traps; a row without traps counts as "unknown"."""
    traps = F.when(F.size("failure_traps") > 0, F.col("failure_traps")).otherwise(F.array(F.lit("unknown")))
    by_trap = scored.select("tool", "app_score", F.explode(traps).alias("trap")).groupBy("tool", "trap").agg(F.avg("app_score").alias("mean"))
    worst = by_trap.groupBy("tool").agg(F.round(F.min("mean") + 1e-9, 3).alias("worst_trap"))
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    tools = scored.groupBy("tool").agg(
        F.count("*").alias("clips"), F.round(F.avg("app_score") + 1e-9, 3).alias("avg_score"), share(F.col("usable")).alias("usable_rate"), share(F.col("critical")).alias("critical_rate"),
        share(F.col("error").isNotNull()).alias("error_rate"), F.round(F.percentile("seconds", F.lit(0.5)), 4).alias("p50_seconds"),
    )
    return tools.join(worst, "tool")


#: Steps of a dictation in their order.
STEPS = ("hotkey_down", "playback_start", "speech_end", "hotkey_up", "final_visible", "paste_done")


def result_violations(results: DataFrame, clips: DataFrame, tools: list[str]) -> DataFrame:
    """(rule, tool, corpus_id) for each broken rule: steps out of order (missing ones are passed over), an unknown clip, a
    result given twice, a clip that a tool has no result for."""
    times = F.array_compact(F.array(*[F.col(f"timestamps.{s}") for s in STEPS]))
    key = ("tool", "corpus_id")
    late = results.filter(times != F.array_sort(times)).select(F.lit("steps_out_of_order").alias("rule"), *key)
    known = clips.select(F.col("id").alias("corpus_id")).distinct()
    unknown = results.join(known, "corpus_id", "left_anti").select(F.lit("unknown_clip").alias("rule"), *key)
    twice = results.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("given_twice").alias("rule"), *key)
    # what is missing is found from one row of each clip, not from clips x tools
    has = results.groupBy("corpus_id").agg(F.collect_set("tool").alias("has"))
    absent = F.array_except(F.array(*map(F.lit, tools)), F.coalesce("has", F.array().cast("array<string>")))
    missing = known.join(has, "corpus_id", "left").select(F.explode(absent).alias("tool"), "corpus_id").select(F.lit("no_result").alias("rule"), *key)
    return late.unionByName(unknown).unionByName(twice).unionByName(missing)


def confusion(rows: DataFrame, truth: Column, predicted: Column, by: str) -> DataFrame:
    """Counts of true and false decisions by group; rows without truth are left out."""
    p = F.coalesce(predicted, F.lit(False))
    counts = {"tp": truth & p, "fn": truth & ~p, "fp": ~truth & p, "tn": ~truth & ~p}
    return rows.filter(truth.isNotNull()).groupBy(by).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def retention_of_audio(attempts: DataFrame) -> DataFrame:
    """Successful attempts of each day with and without their recording kept."""
    good = attempts.filter("paste_success")
    return good.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("successes"), F.count_if("audio_retained").alias("retained"), F.count_if(~F.col("audio_retained")).alias("missing"))


def throttled(attempts: DataFrame, seconds: int) -> DataFrame:
    """attempts with whether each follows the user's last one by less than a cool-down."""
    before = F.lag("created_at").over(Window.partitionBy("user_id").orderBy("created_at", "ordinal"))
    gap = F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return attempts.withColumn("throttled", F.coalesce(gap < seconds * 1_000_000, F.lit(False)))


def to_prune(files: DataFrame, keep: int) -> DataFrame:
    """Recordings of each user beyond the newest ``keep``: by time, then by name."""
    newest = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("run_id").desc())
    return files.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") > keep).drop("_n")


def chunk_grid(clips: DataFrame, length: float = 6.0, step: float = 5.0, least: float = 1.0) -> DataFrame:
    """(id, chunk, start, stop): recordings cut into chunks that start every ``step`` seconds; a last one under ``least`` seconds goes."""
    last = F.ceil(F.col("audio_seconds") / step) - 1
    rows = clips.filter("audio_seconds > 0").select("id", "audio_seconds", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    start = F.col("chunk") * step
    rows = rows.select("id", "chunk", start.alias("start"), F.least(start + length, "audio_seconds").alias("stop"))
    return rows.filter((F.col("chunk") == 0) | (F.col("stop") - F.col("start") >= least)).select("id", "chunk", F.round("start", 3).alias("start"), F.round("stop", 3).alias("stop"))


#: Shares of errors from which a rate of 3 digits is over 0, and over one half.
PERFECT, POOR = 0.0005, 0.5005


def field_scorecard(wide: DataFrame, fields: list[str]) -> DataFrame:
    """Of each candidate field its rows, blank ones, exact ones, poor ones and ones with repeated words; wide: gold and the fields."""
    # the reference's words are moved once for all fields
    words = wide.select(C.tokens(F.col("gold")).alias("_ref"), *[x for i, c in enumerate(fields) for x in (C.tokens(F.col(c)).alias(f"_hyp{i}"), (X.stripped(F.col(c)) == "").alias(f"_blank{i}"))])
    ref, hyps = F.col("_ref"), [F.col(f"_hyp{i}") for i in range(len(fields))]
    rates = [C.error_rate(C.word_errors(ref, h, marks=(PERFECT, POOR)), ref, h) for h in hyps]
    facts = [F.struct(F.lit(c).alias("field"), F.col(f"_blank{i}").alias("blank"), rates[i].alias("wer"), (C.adjacent_repeat_ratio(hyps[i]) > 0).alias("repeats")) for i, c in enumerate(fields)]
    long = words.select(F.inline(F.array(*facts)))
    return long.groupBy("field").agg(F.count("*").alias("n"), F.count_if("blank").alias("blank"), F.count_if(F.col("wer") == 0).alias("perfect"), F.count_if(F.col("wer") > 0.5).alias("poor"), F.count_if("repeats").alias("repeated"))


def prefix_quality(drafts: DataFrame, clips: DataFrame) -> DataFrame:
    """Mean word error rate of drafts against as many words of the reference, by the time of the draft."""
    # the references of a partition are held, so that drafts, which repeat their words, aren't sorted
    met = drafts.select("doc_id", "t_ms", "words").join(clips.select("doc_id", "toks").hint("shuffle_hash"), "doc_id")
    met = met.withColumn("_ref", F.slice("toks", F.lit(1), F.size("words")))
    rate = C.word_error_rate(F.col("_ref"), F.col("words"), lower=True)
    return met.groupBy("t_ms").agg(F.count("*").alias("n"), F.round(F.avg(rate) + 1e-9, 4).alias("wer"))


def stitch(segments: DataFrame) -> DataFrame:
    """(run, chunks, text): the texts of each run's chunks joined in order; (run, place, text) in.  A run's chunks form one row."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"])
    return segments.groupBy("run").agg(parts.alias("parts")).select("run", F.size("parts").alias("chunks"), X.join_overlapping(F.col("parts")).alias("text"))


def labelled(texts: DataFrame) -> DataFrame:
    """(run, text): the texts of a run's sources, each under its label, in order; blank ones are left out.  (run, place, label, text) in."""
    rows = texts.filter(X.stripped(F.col("text")) != "").withColumn("text", X.stripped(F.col("text")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "label", "text"))), lambda s: F.concat(F.lit("["), s["label"], F.lit("]\n"), s["text"]))
    return rows.groupBy("run").agg(F.array_join(parts, "\n\n").alias("text"))


def audit_claims(claims: DataFrame, evidence: DataFrame, tolerance: float = 0.0005) -> DataFrame:
    """(claim_id, metric, verdict): claims (claim_id, metric, selector, expected) held against evidence (selector, metric, value).

    ok; off: further than the tolerance, or no number; missing and ambiguous: none or several rows of evidence.
    """
    facts = evidence.groupBy("selector", "metric").agg(F.count("*").alias("n"), F.max("value").alias("value"))
    close = F.coalesce(F.abs(F.col("value") - F.col("expected")) <= tolerance, F.lit(False))
    verdict = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when(close, "ok").otherwise("off")
    return claims.join(facts, ["selector", "metric"], "left").select("claim_id", "metric", verdict.alias("verdict"))


def best_or_unclear(candidates: DataFrame, least: float = 0.25, most_repeat: float = 0.3) -> DataFrame:
    """(id, name, score) of the best candidate (id, name, score, repeat) of each id; "unclear" if it scores low or repeats itself."""
    best = candidates.groupBy("id").agg(F.max_by(F.struct("name", "score", "repeat"), F.struct("score", F.col("name"))).alias("x"))
    unclear = F.coalesce((F.col("x.score") < least) | (F.col("x.repeat") >= most_repeat), F.lit(True))
    return best.select("id", F.when(unclear, "unclear").otherwise(F.col("x.name")).alias("name"), F.col("x.score").alias("score"))


def review_candidates(attempts: DataFrame, least_seconds: float, n: int) -> DataFrame:
    """The newest n successful attempts without an error that took long enough, one for each recording (its newest)."""
    good = attempts.filter(F.col("paste_success") & (F.col("release_to_paste") >= least_seconds))
    one = good.groupBy("audio_path").agg(F.max_by(F.struct("run_id", "ordinal"), "ordinal").alias("x"))
    return one.select("audio_path", "x.run_id", "x.ordinal").orderBy(F.col("ordinal").desc()).limit(n).drop("ordinal")


def caption_choice(captions: DataFrame, starts: tuple[float, ...], length: float, least_words: int) -> DataFrame:
    """(conv_id, start, words): of each recording the first of the given starts whose window, ends included, has enough words, else the wordiest, the first of equals."""
    met = F.filter(F.array(*[F.lit(float(s)) for s in starts]), lambda s: (F.col("stop") >= s) & (F.col("start") <= s + length))
    rows = captions.select("conv_id", F.size(X.split_words(F.col("text"))).alias("n"), F.explode(met).alias("at"))
    windows = rows.groupBy("conv_id", "at").agg(F.sum("n").alias("words"))
    row = F.struct("at", "words")
    best = windows.groupBy("conv_id").agg(F.min_by(row, F.when(F.col("words") >= least_words, F.col("at"))).alias("first"), F.min_by(row, F.struct(-F.col("words"), "at")).alias("most"))
    return best.select("conv_id", F.coalesce("first", "most").alias("x")).select("conv_id", F.col("x.at").alias("start"), "x.words")
