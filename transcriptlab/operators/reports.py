"""Jobs that join results with clips, score them anew, summarise them and hold them against limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import meaning as M
from .review import term_coverage
from .scoring import mean, rate


def fill_from_clips(results: DataFrame, clips: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """results with missing attributes taken from their clips (by id); what a result has stays, and unknown ids keep their nulls."""
    known = clips.select("id", *[F.col(c).alias(f"_{c}") for c in attributes])
    out = [F.coalesce(c, f"_{c}").alias(c) if c in attributes else F.col(c) for c in results.columns]
    more = [F.col(f"_{c}").alias(c) for c in attributes if c not in results.columns]
    return results.join(known, "id", "left").select(*out, *more)


def known_results(results: DataFrame, clips: DataFrame) -> DataFrame:
    """Results of clips that are in the corpus."""
    return results.join(clips.select("id").distinct(), "id", "left_semi")


def rescored_terms(runs: DataFrame, clips: DataFrame) -> DataFrame:
    """(doc_id, id, backend, term_coverage, misses): runs against the terms that their clips name, else the clips' anchors.

    clips: id, terms, a text of terms; runs: doc_id, id, backend, gold, actual.
    """
    met = runs.join(clips.select("id", F.col("terms").alias("_given")), "id", "left")
    scored = term_coverage(met.withColumn("_terms", M.expected_terms(F.col("gold"), F.col("_given"))), "_terms")
    return scored.select("doc_id", "id", "backend", "term_coverage", F.size("term_misses").alias("misses"))


def variant_scores(runs: DataFrame, variants: DataFrame) -> DataFrame:
    """(id, backend, source, score, coverage, wer): runs against the reference text that suits each best, the first of equals.

    variants: id, gold_variants, an array of (source, text); an empty text counts for nothing.  The score is .70 meaning, .20 terms (meaning
    where no terms are expected) and .10 words.
    """
    rows = runs.select("id", "backend", "actual").join(variants.select("id", F.posexplode("gold_variants").alias("place", "v")), "id")
    rows = rows.select("id", "backend", "actual", "place", "v.source", "v.text")
    rows = rows.withColumn("_r", C.tokens(F.col("text"), lower=False)).withColumn("_h", C.tokens(F.col("actual"), lower=False))
    # one function for all counts, so that a task has one Python worker with one vocabulary for them
    rows = rows.withColumn("_x", M.run_counts(F.col("_r"), F.col("_h"), F.col("text"), F.col("actual")))
    rows = rows.withColumn("wer", C.error_rate(F.col("_x.errors"), F.col("_r"), F.col("_h"))).withColumn("coverage", M.share(F.col("_x.wanted"), F.col("_x.met")))
    rows = rows.withColumn("term_coverage", F.when(F.col("_x.terms") > 0, F.round(F.col("_x.heard") / F.col("_x.terms"), 3)))
    blank = F.trim("text") == ""
    rows = rows.withColumn("wer", F.when(blank, 1.0).otherwise(F.col("wer"))).withColumn("coverage", F.when(blank, 0.0).otherwise(F.col("coverage")))
    score = 0.70 * F.col("coverage") + 0.20 * F.coalesce("term_coverage", "coverage") + 0.10 * F.greatest(F.lit(0.0), 1 - F.least("wer", F.lit(1.0)))
    best = rows.withColumn("score", score).groupBy("id", "backend").agg(F.max_by(F.struct("source", "score", "coverage", "wer"), F.struct("score", -F.col("place"))).alias("x"))
    return best.select("id", "backend", "x.source", F.round(F.col("x.score") + 1e-9, 3).alias("score"), "x.coverage", "x.wer")


def merged_corpora(corpora: dict[str, DataFrame]) -> DataFrame:
    """Corpora (id and any columns) as one, with source_corpus; the second and later clips of an id get a numbered suffix, in the order given."""
    tagged = None
    for place, (name, rows) in enumerate(corpora.items()):
        own = rows.withColumn("source_corpus", F.lit(name)).withColumn("_place", F.lit(place))
        tagged = own if tagged is None else tagged.unionByName(own, allowMissingColumns=True)
    n = F.row_number().over(Window.partitionBy("id").orderBy("_place"))
    return tagged.withColumn("id", F.when(n > 1, F.concat("id", F.lit("__dup"), n)).otherwise(F.col("id"))).drop("_place")


def first_per_class(rows: DataFrame, by: str, order: str, quotas: dict[str, int]) -> DataFrame:
    """The first rows of each class, as many as its quota; classes without one give none."""
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col(by)]
    # a literal limit for each class is a group limit, which sorts no more than that in a task
    most = max(quotas.values(), default=0)
    first = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("_n", first).filter(F.col("_n") <= most).filter(F.col("_n") <= quota).drop("_n")


def pool_summary(scored: DataFrame, by: str) -> DataFrame:
    """Backend x pool: means of errors, meaning and terms, of the score for meaning and verbatim, and times.  scored: useful_score, verbatim_score."""
    figures = scored.groupBy("backend", by).agg(
        F.count("*").alias("clips"), mean("wer").alias("avg_wer"), mean("meaning_coverage").alias("avg_coverage"), mean("term_coverage").alias("avg_terms"), mean("useful_score").alias("avg_meaning"), mean("verbatim_score").alias("avg_verbatim"),
        F.round(F.percentile("seconds", F.lit(0.5)), 3).alias("p50_seconds"), F.round(F.avg(((F.col("seconds") > 6) | F.col("error").isNotNull()).cast("int")), 4).alias("hang_rate"),
    )
    return figures


def split_metrics(scored: DataFrame) -> DataFrame:
    """backend x bucket: scores, medians, rates and times; without terms their part is that of meaning."""
    keyed = scored.withColumn("cell", F.concat_ws("|", "backend", "bucket")).withColumn("terms", F.coalesce("term_coverage", "meaning_coverage"))
    figures = keyed.groupBy("backend", "bucket", "cell").agg(
        F.count("*").alias("clips"), mean("useful_score").alias("useful"), F.round(F.percentile("useful_score", F.lit(0.5)), 4).alias("median_useful"), mean("meaning_coverage").alias("coverage"), mean("terms").alias("term_coverage"),
        rate("usable").alias("usable_rate"), rate("fast").alias("fast_rate"), rate("hang_risk").alias("hang_risk_rate"), F.round(F.percentile("seconds", F.lit(0.5)), 4).alias("p50_seconds"),
    )
    late = C.percentiles(keyed, "cell", "seconds", 0.95, ("half_even",)).select("cell", F.round("half_even", 3).alias("p95_seconds"))
    return figures.join(late, "cell").drop("cell")


def measured_map(metrics: DataFrame) -> DataFrame:
    """(backend, measured): a map from bucket to a struct of clips, useful and p95_seconds."""
    entry = F.struct("bucket", F.struct("clips", "useful", "p95_seconds").alias("m"))
    return metrics.groupBy("backend").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("measured"))


def strategy_flags(metrics: DataFrame, first: str, staged: str, accepted: DataFrame) -> DataFrame:
    """One row of flags: whether the staged and the quick backend clear their bars; a figure that is missing clears none.

    metrics: backend, bucket, useful, p95_seconds; accepted: bucket, accepted (updates taken).
    """
    cell = lambda b, k, c: F.max(F.when((F.col("backend") == b) & (F.col("bucket") == k), F.col(c)))
    got = metrics.agg(cell(staged, "english_only", "useful").alias("e"), cell(staged, "hindi_english", "useful").alias("h"), cell(staged, "hindi_english", "p95_seconds").alias("s"), cell(first, "english_only", "p95_seconds").alias("f"))
    over = accepted.agg(F.coalesce(F.sum(F.when(F.col("bucket") == "english_only", F.col("accepted"))), F.lit(0)).alias("n"))
    clears = lambda c: F.coalesce(c, F.lit(False))
    both = got.crossJoin(over)  # a row each
    return both.select(clears(F.col("e") >= 0.90).alias("english_ok"), clears(F.col("h") >= 0.85).alias("hindi_english_ok"), clears(F.col("s") <= 4.5).alias("hindi_english_in_time"), clears(F.col("f") <= 2.0).alias("english_fast"), (F.col("n") == 0).alias("no_blind_overwrite"))


def blockers(metrics: DataFrame, backend: str, accepted: DataFrame, least: dict[str, float], most_seconds: float, blocked: bool) -> DataFrame:
    """(goal_met, blockers): what keeps the goal from being met; a missing score is 0, a missing time never in budget."""
    of = lambda k, c, other: F.coalesce(F.max(F.when((F.col("backend") == backend) & (F.col("bucket") == k), F.col(c))), F.lit(other))
    got = metrics.agg(of("english_only", "useful", 0.0).alias("e"), of("hindi_english", "useful", 0.0).alias("h"), of("hindi_english", "p95_seconds", 999.0).alias("s"))
    over = accepted.agg(F.coalesce(F.sum(F.when(F.col("bucket") == "english_only", F.col("accepted"))), F.lit(0)).alias("n"))
    found = F.array_compact(F.array(
        F.when(F.col("e") < least["english_only"], "english_below_target"), F.when(F.col("h") < least["hindi_english"], "hindi_english_below_target"), F.when(F.col("s") > most_seconds, "hindi_english_latency_over_budget"),
        F.when(F.col("n") > 0, "blind_english_overwrite"), F.when(F.lit(blocked), "accelerated_frontier_blocked"),
    ))
    return got.crossJoin(over).select((F.size(found) == 0).alias("goal_met"), F.array_join(found, ",").alias("blockers"))  # a row each


#: Limits of the fixed goal.
GOAL = {"useful": 0.75, "usable": 0.80, "p95": 2.50, "hang": 0.02}


def goal_status(board: DataFrame, ready: DataFrame) -> DataFrame:
    """(backend, fixed_pass, bottleneck): each backend's figures against the goal, and what holds it up.

    board: backend, avg_useful, usable_rate, p95_seconds, hang_risk_rate; ready: one row of counts: clips kept, representative clips of prompts and of real use, real candidates, and the least number.
    """
    passed = (F.col("avg_useful") >= GOAL["useful"]) & (F.col("usable_rate") >= GOAL["usable"]) & (F.col("p95_seconds") <= GOAL["p95"]) & (F.col("hang_risk_rate") <= GOAL["hang"])
    capture, real = F.col("capture_representative") >= F.col("least"), F.col("real_representative") >= F.col("least")
    corpus = (
        F.when((F.col("kept_clips") == 0) & (F.col("real_candidates") == 0), "representative_audio_missing")
        .when((F.col("capture_representative") == 0) & (F.col("real_representative") == 0), "retained_audio_not_representative")
        .otherwise("representative_corpus_too_small")
    )
    state = F.when(~passed, "quality_or_latency_on_fixed_corpus").when(~(capture | real), corpus).when(capture & real, "ready_for_strategy_bakeoff").when(real, "ready_for_real_use_strategy_bakeoff").otherwise("ready_for_capture_sheet_strategy_bakeoff")
    return board.crossJoin(ready).select("backend", passed.alias("fixed_pass"), state.alias("bottleneck"))  # ready is a row


def release_gate(runs: DataFrame, floors: dict[str, tuple[float, float]], split: float = 30.0) -> DataFrame:
    """(backend, check, value, threshold, passed): errors, blanks and times of short and long clips apart, and floors of categories.

    runs: backend, category, actual, error, seconds, audio_seconds, term_coverage, meaning_coverage, unsafe.  Times are of runs without an error;
    a check of long clips or of a category that a backend has no run of is left out.  floors: category to least terms and meaning.
    """
    short, good = F.col("audio_seconds") <= split, F.col("error").isNull()
    late = lambda c: F.percentile(F.when(c & good, F.col("seconds")), F.lit(0.95))
    longest = lambda c: F.max(F.when(c & good, F.col("seconds")))
    checks: list[tuple[str, Column, float, bool]] = [
        ("errors", F.count_if(~good).cast("double"), 0.0, False),
        ("blanks", F.count_if(F.trim("actual") == "").cast("double"), 0.0, False),
        ("short_p95", F.coalesce(late(short), F.lit(0.0)), 3.0, False),
        ("short_max", F.coalesce(longest(short), F.lit(0.0)), 4.0, False),
        ("long_p95", late(~short), 6.0, False),
        ("long_max", longest(~short), 8.0, False),
        ("unsafe", F.count_if("unsafe").cast("double"), 0.0, False),
    ]
    for name, (terms, meaning) in floors.items():
        own = F.col("category") == name
        checks += [(f"{name}_terms", F.avg(F.when(own, F.col("term_coverage"))), terms, True), (f"{name}_meaning", F.avg(F.when(own, F.col("meaning_coverage"))), meaning, True)]
    figures = runs.groupBy("backend").agg(*[c.alias(n) for n, c, _, _ in checks])
    entry = F.array(*[F.struct(F.lit(n).alias("check"), F.round(F.col(n), 4).alias("value"), F.lit(t).alias("threshold"), (F.col(n) >= t if up else F.col(n) <= t).alias("passed")) for n, _, t, up in checks])
    return figures.select("backend", F.explode(entry).alias("x")).select("backend", "x.*").filter("value IS NOT NULL")


def reject_histogram(decisions: DataFrame) -> DataFrame:
    """(kind, name, n): how often each reason stands, by what is before its colon, and accepted rows by bucket.  decisions: bucket, reasons (array)."""
    entry = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    named = F.transform("reasons", lambda r: entry("reason", F.substring_index(r, ":", 1)))
    # outer, as else Spark would test whether there are reasons beforehand, and find each row's several times
    found = decisions.select(F.explode_outer(F.when(F.size("reasons") == 0, F.array(entry("accepted", F.col("bucket")))).otherwise(named)).alias("x"))
    return found.filter("x IS NOT NULL").groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def rule_counts(rewrites: DataFrame) -> DataFrame:
    """How often each rule fired in accepted rewrites.  rewrites: accepted, rules (array)."""
    return rewrites.filter("accepted").select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def first_times(drafts: DataFrame, ends: DataFrame) -> DataFrame:
    """(doc_id, first_partial, first_stable, release_to_paste, release_to_final) of each dictation, in ms.

    drafts: doc_id, t_ms, words, stable; ends: doc_id, speech_end, paste_done, final_visible.  Differences are never under 0; a time that is missing is null.
    """
    said = F.size("words") > 0
    firsts = drafts.groupBy("doc_id").agg(F.min(F.when(said, F.col("t_ms"))).alias("first_partial"), F.min(F.when(said & F.col("stable"), F.col("t_ms"))).alias("first_stable"))
    since = lambda c: F.when(F.col(c).isNotNull() & F.col("speech_end").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col(c) - F.col("speech_end")))
    return ends.join(firsts, "doc_id", "left").select("doc_id", "first_partial", "first_stable", since("paste_done").alias("release_to_paste"), since("final_visible").alias("release_to_final"))


def latency_summary(rows: DataFrame, by: str) -> DataFrame:
    """Medians and late quantiles of the times of ``first_times``, by a column; error rows counted."""
    median = lambda c: F.round(F.percentile(c, F.lit(0.5)), 1)
    out = rows.groupBy(by).agg(F.count("*").alias("n"), median("first_partial").alias("p50_first_partial"), median("first_stable").alias("p50_first_stable"), median("release_to_paste").alias("p50_paste"), median("release_to_final").alias("p50_final"), F.count("error").alias("error_rows"))
    for c in ("release_to_paste", "release_to_final"):
        late = C.percentiles(rows, by, c, 0.95, ("half_up",)).select(F.col(by).alias("_by"), F.round(F.col("half_up").cast("double"), 1).alias("p95_" + c.rsplit("_", 1)[1]))
        out = out.join(late, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    return out


def stream_summary(rows: DataFrame, by: str) -> DataFrame:
    """Updates of streams by a column: risks, safe ones, ones of value, partial ones, routes, and the tail after release.

    rows: risk, safe, value, partial (booleans), route, tail.  The late quantile is the 19th of 20 equal parts, between values, as of an open range.
    """
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if("risk").alias("risks"), F.count_if("safe").alias("safe"), F.count_if("value").alias("valuable"), F.count_if(F.col("safe") & F.col("value")).alias("safe_valuable"), F.count_if("partial").alias("partial"), F.round(F.percentile("tail", F.lit(0.5)), 3).alias("p50_tail"))
    routes = rows.groupBy(by, "route").agg(F.count("*").alias("k")).groupBy(F.col(by).alias("_b")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "route", "k"))), ",").alias("routes"))  # a row for each route
    late = exclusive(rows, by, "tail", 0.95).select(F.col(by).alias("_c"), F.round(F.col("value") + 1e-9, 3).alias("p95_tail"))
    return out.join(routes, F.col(by).eqNullSafe(F.col("_b")), "left").join(late, F.col(by).eqNullSafe(F.col("_c")), "left").drop("_b", "_c")


def exclusive(rows: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """(by, value): the quantile of an open range, between the values at the places around p (n + 1); of one value that."""
    placed = C.percentiles(rows, by, value, p, ("before", "behind"))
    n = rows.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("n"))
    at = F.lit(p) * (F.col("n") + 1) - (C.PLACES["before"](p, F.col("n")) + 1)
    # at the ends of the range the nearest two values are carried on
    between = F.when(F.col("n") == 1, F.col("before")).otherwise(F.col("before") * (1 - at) + F.col("behind") * at)
    return placed.join(n, F.col(by).eqNullSafe(F.col("_by"))).select(by, between.alias("value"))


def tool_statuses(tools: DataFrame, probes: DataFrame) -> DataFrame:
    """(tool, coverage, evidence): tools measured by a score, else by what a probe found, else missing.  tools: tool, measured; probes: tool, status."""
    met = tools.join(probes.groupBy("tool").agg(F.max("status").alias("status")), "tool", "left")
    coverage = F.when(F.col("measured"), "measured_engine").otherwise(F.coalesce("status", F.lit("missing")))
    return met.select("tool", coverage.alias("coverage"), F.when(F.col("measured"), "scorecard").when(F.col("status").isNotNull(), "status_probe").otherwise("").alias("evidence"))


def ab_summary(rows: DataFrame) -> DataFrame:
    """(version, n, errors, meaning, wer, p50, p95, triggered) of the current and the proposed way of each clip.

    rows: for either version a struct of error, meaning, wer, seconds, triggered.
    """
    long = rows.select(F.explode(F.array(F.struct(F.lit("current").alias("version"), F.col("current").alias("x")), F.struct(F.lit("proposed").alias("version"), F.col("proposed").alias("x")))).alias("r")).select("r.version", "r.x.*")
    good = F.col("error").isNull()
    of = lambda c: F.when(good, F.col(c))
    late = lambda p: F.round(F.percentile(of("seconds"), F.lit(p)), 4)
    return long.groupBy("version").agg(F.count_if(good).alias("n"), F.count_if(~good).alias("errors"), F.round(F.avg(of("meaning")) + 1e-9, 4).alias("meaning"), F.round(F.avg(of("wer")) + 1e-9, 4).alias("wer"), late(0.5).alias("p50"), late(0.95).alias("p95"), F.count_if("triggered").alias("triggered"))


def capture_summary(rows: DataFrame, by: str) -> DataFrame:
    """Captures by a column: all, those with text and no error, and their times: end to end and from release to paste.

    rows: actual, error, e2e_seconds, hotkey_up, paste_done.
    """
    good = F.col("error").isNull() & (F.trim("actual") != "")
    time = {"e2e": F.when(good, F.col("e2e_seconds")), "release": F.when(good, F.col("paste_done") - F.col("hotkey_up"))}
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(good).alias("ok"), *[F.round(F.percentile(c, F.lit(p)), 4).alias(f"{n}_p{round(100 * p)}") for n, c in time.items() for p in (0.5, 0.95)])


def selection_summary(rows: DataFrame) -> DataFrame:
    """Backends with how many texts came from the second pass.  rows: backend, useful_score, seconds, selected_from."""
    figures = rows.groupBy("backend").agg(F.count("*").alias("clips"), mean("useful_score").alias("avg_score"), F.count_if(F.col("selected_from") == "polish").alias("from_polish"))
    times = [C.percentiles(rows, "backend", "seconds", p, ("half_even",)).select("backend", F.round("half_even", 3).alias(n)) for n, p in (("p50_seconds", 0.5), ("p95_seconds", 0.95))]
    return figures.join(times[0], "backend").join(times[1], "backend")


def corpus_violations(clips: DataFrame) -> DataFrame:
    """(rule, id) for each broken rule of a corpus: an id twice, no reference text, no facts, a denial without a check.

    clips: id, gold, facts (array), guarded (whether the text denies something), checks (array of checks or forbidden phrases).
    """
    none = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) == 0
    rules = F.array_compact(F.array(F.when(F.trim(F.coalesce("gold", F.lit(""))) == "", "no_gold"), F.when(none("facts"), "no_facts"), F.when(F.col("guarded") & none("checks"), "no_polarity_check")))
    single = clips.select(F.explode(rules).alias("rule"), "id")
    return single.unionByName(clips.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_id").alias("rule"), "id"))


def term_checklist(texts: DataFrame, checks: dict[str, tuple[str, ...]], least: int) -> DataFrame:
    """(doc_id, passed, enough): how many of the checks a text passes, by any of the phrases of each as whole words, and whether enough are.  texts: doc_id, text."""
    said = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))
    heard = [F.exists(M.listed(phrases), lambda p: F.contains(F.col("_s"), F.concat(F.lit(" "), p, F.lit(" ")))).cast("int") for phrases in checks.values()]
    total = heard[0]
    for h in heard[1:]:
        total = total + h
    return texts.withColumn("_s", said).select("doc_id", total.alias("passed"), (total >= least).alias("enough"))
