"""Registered queries that join, summarise, check and choose, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import meaning as M
from ..functions import rules as R
from ..functions import texts as X
from ..operators import choose, corpus, intake_checks, reports, scoring, terms
from ..sources import views as v
from . import sqltext as T
from .history import _SCORED
from .history import SQL as HISTORY
from .selection import SQL as SELECTION
from .selection import _wer

#: Frequent words of the given texts, as markers of a bucket.
MARKS = ("the", "and", "of", "to")
QUOTAS = {"en": 5, "de": 3, "fr": 2}
FLOORS = {"en": (0.6, 0.6), "de": (0.5, 0.95)}
SPLIT = 14.0
BONUS = {"accurate": 0.20, "tiny": -0.10}
CHECKS = {"the": ("the",), "and": ("and", "und", "et", "y"), "of": ("of", "von", "de"), "licence": ("licence", "license"), "all rights": ("all rights reserved", "rights")}


def _scored(s, d):
    scored = scoring.score_runs(v.runs(s, d))
    return scored.withColumn("bucket", R.two_way_bucket(F.col("gold"), F.col("category"), MARKS)).withColumn("audio_seconds", F.length("gold") / 15.0)


def _filled(s, d):
    runs = v.runs(s, d).select("id", "backend", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"), F.when(F.col("doc_id") % 5 != 0, F.col("category")).alias("category"))
    return reports.fill_from_clips(runs, v.clips(s, d), ("source", "category", "trust"))


def _rescored(s, d):
    named = F.when(F.col("doc_id") % 2 == 1, F.concat_ws(", ", F.get("toks", F.lit(0)), F.get("toks", F.lit(4)), F.lit("Foo!")))
    return reports.rescored_terms(v.runs(s, d), v.clips(s, d).withColumn("terms", named)).drop("id")


def _variants(s, d):
    half = F.array_join(F.slice("toks", F.lit(1), F.floor(F.size("toks") / 2).cast("int")), " ")
    pair = lambda n, t: F.struct(F.lit(n).alias("source"), t.alias("text"))
    return reports.variant_scores(v.runs(s, d), v.clips(s, d).withColumn("gold_variants", F.array(pair("primary", F.col("gold")), pair("half", half))))


def _merged(s, d):
    clips = v.clips(s, d)
    return reports.merged_corpora({"trusted": clips.filter("trust = 'gold'").select("id", "category"), "all": clips.select("id", "category", "trust")})


def _decisions(s, d):
    """Updates with their reject reasons, by a bucket of the clip."""
    from .selection import _updates

    reasons = F.filter(F.split("reasons", ";"), lambda r: r != "")
    return _updates(s, d).select(F.when(F.col("doc_id") % 2 == 0, "english_only").otherwise("hindi_english").alias("bucket"), reasons.alias("reasons"))


def _accepted(s, d):
    return _decisions(s, d).groupBy("bucket").agg(F.count_if(F.size("reasons") == 0).alias("accepted"))


def _ready(s, d):
    clips = v.clips(s, d)
    counts = clips.agg(F.count("*").alias("kept_clips"), F.count_if(F.col("trust") == "gold").alias("capture_representative"), F.count_if(F.col("trust") == "silver").alias("real_representative"), F.count("*").alias("real_candidates"))
    return counts.withColumn("least", F.lit(20))


def _polished(s, d):
    clause = F.when(F.col("doc_id") % 11 == 0, " Company data cannot go to the cloud so it should be a solution because").otherwise("")
    text = F.concat("gold", F.when(F.col("doc_id") % 7 == 0, " solve for a cursor now").otherwise(""), clause)
    rows = v.clips(s, d).withColumn("x", R.work_polish(text))
    return reports.rule_counts(rows.select((F.col("doc_id") % 2 == 0).alias("accepted"), F.col("x.rules").alias("rules")))


def _first_times(s, d):
    stable = corpus.stable_drafts(v.drafts(s, d))
    number = F.col("doc_id")
    ends = v.clips(s, d).select("doc_id", "category", (number % 3000 + 9000).alias("speech_end"), F.when(number % 17 != 0, number % 2500 + 9500).alias("paste_done"), (number % 4000 + 10000).alias("final_visible"), F.when(number % 19 == 0, "late").alias("error"))
    return reports.first_times(stable, ends), ends


def _latency(s, d):
    times, ends = _first_times(s, d)
    return reports.latency_summary(times.join(ends.select("doc_id", "category", "error"), "doc_id"), "category")


def _streams(s, d):
    n = F.size("hyp")
    route = F.when(F.col("error").isNotNull(), "failed").when(F.col("seconds") < 2, "fast").otherwise("slow")
    rows = v.runs(s, d).select("backend", F.col("quality_flags").isNotNull().alias("risk"), (F.col("error").isNull() & (F.col("seconds") < 6)).alias("safe"), (n > 30).alias("value"), (n < F.size("toks")).alias("partial"), route.alias("route"), F.col("seconds").alias("tail"))
    return reports.stream_summary(rows, "backend")


def _tools(s, d):
    parts = v.table(s, d, "part")
    return reports.tool_statuses(parts.groupBy(F.col("p_brand").alias("tool")).agg((F.max("p_size") > 49).alias("measured")), parts.filter("p_size < 10").select(F.col("p_brand").alias("tool"), F.col("p_type").alias("status")))


def _ab(s, d):
    one = F.struct("error", F.col("meaning_coverage").alias("meaning"), "wer", "seconds", (~F.col("usable")).alias("triggered"))
    of = lambda b: F.max(F.when(F.col("backend") == b, one))
    return reports.ab_summary(_scored(s, d).groupBy("id").agg(of("fast").alias("current"), of("accurate").alias("proposed")))


def _captures(s, d):
    up = (F.col("doc_id") % 5).cast("double")
    return reports.capture_summary(v.runs(s, d).select("backend", "actual", "error", F.col("seconds").alias("e2e_seconds"), up.alias("hotkey_up"), (up + F.col("seconds") + 0.5).alias("paste_done")), "backend")


def _products(s, d):
    runs = v.runs(s, d).select("doc_id", "id", "backend", F.col("actual").alias("text"), "seconds", "error")
    polish = runs.filter("backend = 'accurate'").withColumn("accepted", F.col("doc_id") % 3 != 0)
    return choose.product_rows(runs.filter("backend = 'fast'").select("id", "text", "seconds"), polish)


def _selected(s, d):
    rows = _scored(s, d).select("id", "backend", "useful_score", "seconds")
    own = _products(s, d).select("id", "selected_from", F.col("seconds").alias("s"))
    wanted = F.when(F.col("selected_from") == "polish", "accurate").otherwise("fast")
    final = own.withColumn("backend", wanted).join(rows.drop("seconds"), ["id", "backend"]).select("id", F.lit("final").alias("backend"), "useful_score", F.col("s").alias("seconds"), "selected_from")
    return reports.selection_summary(rows.withColumn("selected_from", F.lit("first")).unionByName(final))


def _violations(s, d):
    some = F.when(F.size("toks") >= 10, F.slice("toks", 1, 3))
    checks = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("x")))
    clips = v.clips(s, d).select(F.concat_ws("_", "category", F.col("doc_id") % 5000).alias("id"), "gold", some.alias("facts"), R.polarity_guarded(F.col("gold")).alias("guarded"), checks.alias("checks"))
    return reports.corpus_violations(clips).groupBy("rule", "id").agg(F.count("*").alias("n"))


def _counts(column):
    return lambda s, d: v.clips(s, d).select(column().alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def _reviews(s, d):
    rows = v.utterances(s, d)
    status = R.review_status(X.effective_text(F.col("pasted_text"), F.col("corrected_text"), F.col("raw_text")), F.col("status"), F.col("seconds"), F.col("app"))
    return rows.select("ordinal", status.alias("review_status"))


def _work(s, d):
    rows = v.utterances(s, d)
    known = rows.filter("ordinal % 10 = 0").select(F.concat(F.lit("history_"), F.replace("run_id", F.lit("-"), F.lit("_"))).alias("candidate_id"))
    return intake_checks.work_candidates(rows, known).select("candidate_id", "run_id", F.array_join("words", ",").alias("words"))


def _learnable(s, d):
    return v.utterances(s, d).select("ordinal", R.learnable_text(F.col("status"), F.col("corrected_text"), F.col("pasted_text"), F.col("raw_text")).alias("text"))


def _marked(c):
    # some candidates speak Hindi
    return F.when(F.col("doc_id") % 5 < 2, F.concat(F.col(c), F.lit(" haan kya matlab"))).otherwise(F.col(c))


def _safe(s, d):
    runs = v.runs(s, d)
    first = runs.filter("backend = 'fast'").select("id", F.col("actual").alias("text"), "seconds")
    others = runs.filter("backend <> 'fast'").select("id", "backend", _marked("actual").alias("text"), "seconds")
    return choose.best_safe(first, others, 6.0, BONUS).select("id", "backend", "seconds", "reason", F.md5("text").alias("text_md5"))


def _derived(s, d):
    runs = v.runs(s, d).select("doc_id", "id", "backend", "actual")
    rewritten = F.struct(F.initcap("actual").alias("text"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("capitals"))).otherwise(F.array().cast("array<string>")).alias("rules"))
    out = choose.derived_backend(runs, "fast", "fast_written", rewritten)
    return out.groupBy("backend", F.coalesce("derived_from", F.lit("")).alias("derived_from")).agg(F.count("*").alias("n"), F.count_if(F.size("rules") > 0).alias("rewritten"))


def _actions(s, d):
    action = F.when(F.col("backend") == "fast", "finalizer").when(F.col("backend") == "accurate", "structure").otherwise("termPolish")
    rows = v.runs(s, d).select("id", action.alias("action"), (F.col("error").isNull() & (F.col("seconds") < 6)).alias("accepted"), F.col("actual").alias("text"))
    return choose.winning_action(rows).groupBy("action").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def _suggested(s, d):
    text = lambda b: F.max(F.when(F.col("backend") == b, F.col("actual")))
    rows = v.runs(s, d).groupBy("doc_id").agg(text("fast").alias("fast"), text("accurate").alias("current"), text("tiny").alias("raw"))
    reasons = F.when(F.col("doc_id") % 4 == 1, F.array(F.lit("late"))).otherwise(F.array().cast("array<string>"))
    current = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("current"))
    label = R.suggested_label(F.col("fast"), current, F.col("raw"), F.col("doc_id") % 5 == 0, F.col("doc_id") % 2 == 0, reasons)
    return rows.select(label.alias("x")).groupBy("x.source").agg(F.count("*").alias("n"), F.sum(F.length("x.text")).alias("chars"))


def _meaning(s, d):
    text = lambda b: F.max(F.when(F.col("backend") == b, F.col("actual")))
    rows = v.runs(s, d).groupBy("doc_id").agg(text("fast").alias("draft"), text("accurate").alias("final"))
    final = F.when(F.col("doc_id") % 13 == 0, F.concat("final", F.lit(" with"))).otherwise(F.col("final"))
    reason = F.coalesce(F.substring_index(F.get(R.meaning_reasons(F.col("draft"), final), F.lit(0)), ":", 1), F.lit("fits"))
    return rows.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _df(words):
    """How many documents hold each term."""
    return lambda s, d: v.spread(v.table(s, d, "documents").select("doc_id", "text")).select(F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("texts"))


def _seconds(s, d):
    tool = F.when(F.col("backend") == "tiny", "cloud").otherwise(F.col("backend"))
    ms = F.when(F.col("doc_id") % 2 == 0, F.col("seconds") * 1000)
    own = F.when(F.col("doc_id") % 3 != 0, F.col("seconds"))
    value = R.tool_seconds(tool, own, ms, F.lit(1.0), F.when(F.col("doc_id") % 5 != 0, F.col("seconds") + 1.5), "cloud")
    return v.runs(s, d).groupBy(tool.alias("tool")).agg(F.count(value).alias("n"), F.round(F.avg(value), 4).alias("seconds"))


def _later(s, d):
    rank = F.when(F.col("status") == "finalizer_replaced", 2).when(F.col("status") == "paste_attempted", 1).otherwise(0)
    return intake_checks.later_success(v.utterances(s, d), rank)


QUERIES = {
    "filled_results": _filled,
    "known_results": lambda s, d: reports.known_results(v.runs(s, d), v.clips(s, d).filter("trust <> 'needs_human_review'")).groupBy("backend").agg(F.count("*").alias("n")),
    "rescored_terms": _rescored,
    "variant_scores": _variants,
    "merged_corpora": _merged,
    "first_per_class": lambda s, d: reports.first_per_class(v.clips(s, d).select("category", "doc_id", "id"), "category", "doc_id", QUOTAS),
    "pool_summary": lambda s, d: reports.pool_summary(_scored(s, d), "category"),
    "split_metrics": lambda s, d: reports.split_metrics(_scored(s, d)),
    "measured_map": lambda s, d: reports.measured_map(reports.split_metrics(_scored(s, d))).select("backend", F.to_json("measured").alias("measured")),
    "strategy_flags": lambda s, d: reports.strategy_flags(reports.split_metrics(_scored(s, d)), "fast", "accurate", _accepted(s, d)),
    "goal_blockers": lambda s, d: reports.blockers(reports.split_metrics(_scored(s, d)), "accurate", _accepted(s, d), {"english_only": 0.9, "hindi_english": 0.5}, 4.5, False),
    "goal_status": lambda s, d: reports.goal_status(scoring.leaderboard(_scored(s, d)), _ready(s, d)),
    "release_gate": lambda s, d: reports.release_gate(_scored(s, d).withColumn("unsafe", F.col("critical")), FLOORS, SPLIT),
    "reject_histogram": lambda s, d: reports.reject_histogram(_decisions(s, d)),
    "polish_rules": _polished,
    "first_times": lambda s, d: _first_times(s, d)[0].fillna(-1),
    "stream_latency": _latency,
    "stream_updates": _streams,
    "tool_statuses": _tools,
    "ab_summary": _ab,
    "capture_summary": _captures,
    "product_rows": lambda s, d: _products(s, d).groupBy("route", "selected_from").agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 4).alias("seconds"), F.sum(F.length("text")).alias("chars")),
    "selection_summary": _selected,
    "corpus_violations": _violations,
    "term_checklist": lambda s, d: reports.term_checklist(v.table(s, d, "documents").select("doc_id", "text"), CHECKS, 3),
    "two_way_buckets": _counts(lambda: R.two_way_bucket(F.col("gold"), F.col("category"), MARKS)),
    "clip_categories": _counts(lambda: R.clip_category(F.when(F.col("doc_id") % 3 == 0, F.col("category")), F.concat("gold", F.when(F.col("doc_id") % 4 == 0, " kaise problem").when(F.col("doc_id") % 4 == 1, " नमस्ते").otherwise("")))),
    "release_trusted": _counts(lambda: R.release_trusted(F.col("doc_id") % 9 == 0, F.col("doc_id") % 7 == 0, F.col("trust"), F.col("gold"))),
    "length_fits": lambda s, d: v.table(s, d, "documents").groupBy("lang", R.length_fits(F.col("text")).alias("fits")).agg(F.count("*").alias("n")),
    "review_statuses": _reviews,
    "gold_candidates": lambda s, d: intake_checks.gold_candidates(v.utterances(s, d), 300).select("audio_path", "ordinal", F.md5("text").alias("text_md5")),
    "work_candidates": _work,
    "later_success": _later,
    "learnable_texts": _learnable,
    "safe_ids": lambda s, d: v.table(s, d, "pages").select("page_id", R.safe_id(F.col("url")).alias("safe")),
    "best_safe": _safe,
    "derived_backends": _derived,
    "winning_actions": _actions,
    "suggested_labels": _suggested,
    "meaning_reasons": _meaning,
    "candidate_terms": _df(terms.candidate_terms),
    "contextual_acronyms": lambda s, d: v.clips(s, d).select("doc_id", F.array_join(terms.contextual_acronyms(F.concat(F.lit("NASA term "), "gold", F.lit(" the API keyword"))), ",").alias("acronyms")),
    "named_terms": _df(terms.named_terms),
    "leading_terms": _df(terms.leading_terms),
    "learn_terms": lambda s, d: terms.learn_terms(v.utterances(s, d)),
    "keyword_hits": lambda s, d: v.utterances(s, d).select("ordinal", F.array_join(R.keyword_hits(F.col("corrected_text")), ",").alias("hits")),
    "tool_seconds": _seconds,
}

_CLIPS, _RUNS, _UTTERANCES = v.with_views("clips"), v.with_views("clips", "runs"), v.with_views("utterances")
_IN = lambda values: ", ".join(map(T.quoted, values))
_BUCKET = f"CASE WHEN regexp_matches(lower(category), 'hinglish|hindi|hi-en') OR len(list_intersect(list_distinct(regexp_extract_all(lower(gold), '[a-z]+')), {T.listed(MARKS)})) >= 2 THEN 'hindi_english' ELSE 'english_only' END"
_METRICS = _SCORED.replace("term_coverage, critical, seconds, error,", "term_coverage, critical, seconds, error, gold, actual,") + f""", b AS (SELECT *, {_BUCKET} AS bucket FROM scored),
metrics AS (SELECT backend, bucket, count(*) AS clips, round(avg(useful_score) + 1e-9, 4) AS useful, round(quantile_cont(useful_score, 0.5), 4) AS median_useful, round(avg(meaning_coverage) + 1e-9, 4) AS coverage, round(avg(coalesce(term_coverage, meaning_coverage)) + 1e-9, 4) AS term_coverage,
  round(avg(usable::INT), 4) AS usable_rate, round(avg(fast::INT), 4) AS fast_rate, round(avg(hang_risk::INT), 4) AS hang_risk_rate, round(quantile_cont(seconds::DOUBLE, 0.5), 4) AS p50_seconds,
  round(list_sort(list(seconds::DOUBLE))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1], 3) AS p95_seconds FROM b GROUP BY 1, 2)
"""
_UPDATES = f"upd AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'english_only' ELSE 'hindi_english' END AS bucket, list_filter(string_split(reasons, ';'), lambda r: r <> '') AS reasons FROM ({SELECTION['update_reasons']}))"
_OVER = f"{_UPDATES}, o AS (SELECT coalesce(sum((len(reasons) = 0)::INT) FILTER (WHERE bucket = 'english_only'), 0) AS n FROM upd)"
_EXCLUSIVE = "CASE WHEN n = 1 THEN x[1] ELSE x[j] * (1 - (0.95 * (n + 1) - j)) + x[j + 1] * (0.95 * (n + 1) - j) END"
_J = "CAST(least(greatest(floor(0.95 * (count(*) + 1) + 1e-9), 1), greatest(count(*) - 1, 1)) AS BIGINT)"
_EFFECTIVE = lambda *c: "coalesce(" + ", ".join(f"nullif({T.stripped(x)}, '')" for x in c) + ", '')"
_WORDS = lambda x: f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+'))"
_HITS = lambda x: f"list_sort(list_intersect({_WORDS(x)}, {T.listed(R.WORK_WORDS)}))"
_FAILED = lambda x: f"({x} = '' OR starts_with({x}, '{M.FAILED_START}') OR {x} IN ({_IN(M.FAILED_TEXTS)}))"
_EDGE = T.quoted(f"^{R.EDGES}|{R.EDGES}$")
_PLAIN_TERM = lambda x: f"regexp_replace(regexp_replace(coalesce({x}, ''), '{T.BLANKS}', ' ', 'g'), {_EDGE}, '', 'g')"
_NUM = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
_RULES = (
    f"list_filter([CASE WHEN regexp_matches(t, '(?i)\\b(solve|debug|fix)\\s+for\\s+(?:a\\s+)?(Cursor\\s+ChatGPT|ChatGPT|Cursor|Codex)\\b') THEN 'product_problem_phrase' END,"
    f" CASE WHEN regexp_matches(lower(t), {T.quoted(R.COMPANY_DATA)}) AND regexp_matches(lower(t), {T.quoted(R.NO_CLOUD)}) AND NOT (regexp_matches(lower(t), '\\btool\\b') AND regexp_matches(lower(t), '\\blocal\\b'))"
    f" AND (regexp_matches(t, {T.quoted(R.LOCAL_CLAUSE[0])}) OR regexp_matches(t, {T.quoted(R.LOCAL_CLAUSE[1])})) THEN 'local_tool_cloud_clause' END], lambda z: z IS NOT NULL)"
)


def _gate() -> str:
    own = lambda c: f"CASE WHEN audio_seconds {c} {SPLIT} AND error IS NULL THEN seconds::DOUBLE END"
    checks = [
        ("errors", "count(error)::DOUBLE", 0.0, "<="), ("blanks", "count(*) FILTER (WHERE trim(actual) = '')::DOUBLE", 0.0, "<="), ("short_p95", f"coalesce(quantile_cont({own('<=')}, 0.95), 0)", 3.0, "<="), ("short_max", f"coalesce(max({own('<=')}), 0)", 4.0, "<="),
        ("long_p95", f"quantile_cont({own('>')}, 0.95)", 6.0, "<="), ("long_max", f"max({own('>')})", 8.0, "<="), ("unsafe", "count(*) FILTER (WHERE critical)::DOUBLE", 0.0, "<="),
    ]
    for name, (t, m) in FLOORS.items():
        checks += [(f"{name}_terms", f"avg(term_coverage) FILTER (WHERE category = '{name}')", t, ">="), (f"{name}_meaning", f"avg(meaning_coverage) FILTER (WHERE category = '{name}')", m, ">=")]
    rows = " UNION ALL ".join(f"SELECT backend, '{n}' AS \"check\", {e} AS x, {t}::DOUBLE AS threshold, x {op} threshold AS passed FROM g GROUP BY backend" for n, e, t, op in checks)
    return f", g AS (SELECT *, length(gold) / 15.0 AS audio_seconds FROM scored) SELECT backend, \"check\", round(x, 4) AS value, threshold, passed FROM ({rows}) WHERE x IS NOT NULL"


def _safe_sql() -> str:
    known = T.listed(R.COMMON_ENGLISH + R.ROMAN_HINDI)
    vowels = "length(regexp_replace(w, '[^aeiou]', '', 'g'))::DOUBLE / length(w)"
    junk = f"len(list_filter(k, lambda w: length(w) >= 5 AND NOT list_contains(n, w) AND NOT list_contains({known}, w) AND (w IN ('kakareapata', 'vedik', 'yesap', 'khanya', 'sakuj', 'kuchar', 'lagala', 'hiya') OR {vowels} < 0.20 OR {vowels} > 0.76)))"
    keep = "CASE WHEN len(list_filter(n, lambda w: length(w) >= 4)) = 0 THEN 1.0 ELSE len(list_filter(n, lambda w: length(w) >= 4 AND list_contains(k, w)))::DOUBLE / len(list_filter(n, lambda w: length(w) >= 4)) END"
    signal = f"list_has_any(k, {T.listed(R.SIGNAL_MARKERS)})"
    fits = f"b <> '' AND a <> b AND {signal} AND (a = '' OR NOT ((len(n) >= 6 AND len(k) < greatest(3, len(n) // 2)) OR length(b) < greatest(20, length(a) // 2)))"
    return f"""{_RUNS}, f AS (SELECT id, actual AS draft, seconds::DOUBLE AS fs FROM runs WHERE backend = 'fast'),
c AS (SELECT id, backend, seconds::DOUBLE AS s, CASE WHEN doc_id % 5 < 2 THEN actual || ' haan kya matlab' ELSE actual END AS t FROM runs WHERE backend <> 'fast'),
m AS (SELECT f.id, draft, fs, backend, s, t, {T.stripped('draft')} AS a, {T.stripped('t')} AS b, {_NUM('draft')} AS n, {_NUM('t')} AS k FROM f JOIN c USING (id)),
q AS (SELECT *, {keep} AS kept, {junk} AS junk FROM m),
r AS (SELECT *, s <= 6 AND {signal} AND {fits} AND kept >= 0.35 AND junk = 0 AS ok,
  round(0.7 * least(len(list_intersect(list_distinct(k), {T.listed(R.SIGNAL_MARKERS)})), 4) + 0.6 * kept + CASE backend WHEN 'accurate' THEN 0.20 ELSE -0.10 END - greatest(0.0, s - 1.5) * 0.12, 6) AS score FROM q),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ok DESC, score DESC, backend) AS place FROM r)
SELECT id, CASE WHEN ok THEN backend ELSE 'server' END AS backend, CASE WHEN ok THEN greatest(fs, s) ELSE fs END AS seconds, CASE WHEN ok THEN 'best_safe_candidate' ELSE 'no_safe_candidate' END AS reason, md5(CASE WHEN ok THEN t ELSE draft END) AS text_md5 FROM w WHERE place = 1"""


def _narrowed(x: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({x}, ''), {T.quoted(terms.WIDE_LETTER)}, 'x', 'g'), {T.quoted(terms.WIDE)}, ';', 'g')"


def _trimmed(p: str) -> str:
    words, stop = f"string_split({_PLAIN_TERM(p)}, ' ')", _IN(terms.TERM_STOP_WORDS)
    places = f"list_filter(range(1, len({words}) + 1), lambda i: lower({words}[i]) NOT IN ({stop}))"
    return f"CASE WHEN len({places}) = 0 THEN '' ELSE array_to_string(list_slice({words}, list_min({places}), list_max({places})), ' ') END"


def _valid(t: str) -> str:
    words, stop = f"regexp_extract_all(lower({t}), '[a-z0-9]+')", _IN(terms.TERM_STOP_WORDS)
    return f"length({t}) BETWEEN 3 AND 80 AND len(list_filter({words}, lambda y: y NOT IN ({stop}))) > 0 AND NOT list_has_any({words}, {T.listed(terms.BLOCKED_WORDS)}) AND NOT (coalesce({words}[1] IN ({stop}), false) AND len({words}) <= 2)"


def _candidates(x: str) -> str:
    clean = f"regexp_replace({_narrowed(x)}, '(?i)\\[(?:BLANK_AUDIO|MUSIC|NOISE|SILENCE|INAUDIBLE)\\]', ' ', 'g')"
    every = lambda p, g=0: f"regexp_extract_all({clean}, {T.quoted(p)}, {g})"
    phrases = f"list_transform(list_filter({every(terms.ACRONYM_PHRASE)}, lambda p: regexp_matches(p, {T.quoted(terms.ACRONYM)})), lambda p: {_trimmed('p')})"
    found = f"list_concat({every(terms.ACRONYM)}, {every(terms.CAMEL)}, {phrases}, {every(terms.TITLE_PHRASE)}, {every(terms.CAPITALISED)}, {every(terms.INTRODUCED, 1)})"
    return f"list_distinct(list_filter(list_transform({found}, lambda p: {_PLAIN_TERM('p')}), lambda p: {_valid('p')}))"


def _telling(t: str) -> str:
    return f"(regexp_full_match({t}, '[A-Z]{{3,8}}') AND lower({t}) NOT IN ({_IN(terms.TERM_STOP_WORDS + terms.BLOCKED_WORDS)}))"


def _product(w: str) -> str:
    return f"({_telling(w)} OR regexp_full_match({w}, '[A-Z]{{2,8}}s') OR regexp_matches({w}, '[0-9.+#-]') OR (regexp_matches({w}, '[a-z]') AND regexp_matches({w}, '^.+[A-Z]')))"


def _contextual(x: str) -> str:
    words = f"regexp_extract_all({_narrowed(x)}, '[A-Za-z0-9.+#-]+')"
    return f"list_sort(list_distinct(list_filter(list_transform(range(1, len({words}) + 1), lambda i: CASE WHEN {_telling(_PLAIN_TERM(f'{words}[i]'))} AND len(list_filter(list_slice({words}, greatest(1, i - 12), i + 12), lambda y: lower(y) IN ({_IN(terms.CONTEXT_WORDS)}))) > 0 THEN {_PLAIN_TERM(f'{words}[i]')} END), lambda z: z IS NOT NULL)))"


def _learnable_sql() -> str:
    fields = "list_filter([corrected_text, pasted_text, raw_text], lambda f: f IS NOT NULL AND k(f) <> '')".replace("k(f)", _PLAIN_TERM("f"))
    keys = f"list_transform(fields, lambda f: lower({_PLAIN_TERM('f')}))"
    joined = "array_to_string(list_filter(fields, lambda f, i: list_position(keys, keys[i]) = i), chr(10))"
    return f"""l1 AS (SELECT *, {fields} AS fields FROM utterances), l2 AS (SELECT *, {keys} AS keys FROM l1), l3 AS (SELECT *, {joined} AS joined FROM l2),
learnable AS (SELECT ordinal, CASE WHEN status <> '' AND status NOT IN ({_IN(R.LEARNABLE)}) THEN '' WHEN contains(lower(joined), '{M.FAILED_START}') THEN '' ELSE joined END AS text FROM l3)"""


_NAMED = f"list_distinct(list_concat(list_filter(regexp_extract_all({_narrowed('x')}, '\\b[A-Z][A-Z0-9]{{1,9}}\\b|\\b[A-Za-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*\\b'), lambda w: lower(w) NOT IN ('ok', 'yes', 'no')), list_filter({T.listed(terms.NAMES)}, lambda n: list_contains({_WORDS('x')}, lower(n)))))"
_TEXTS = 'd AS (SELECT doc_id, "text" AS x FROM documents)'

_TIMES = f"""WITH c AS ({HISTORY['stable_prefix']}), f AS (SELECT doc_id, min(t_ms) FILTER (WHERE len(words) > 0) AS first_partial, min(t_ms) FILTER (WHERE len(words) > 0 AND stable) AS first_stable FROM ({v.with_views('clips', 'drafts')} SELECT * FROM drafts) JOIN c USING (doc_id, k) GROUP BY 1)
SELECT doc_id, first_partial, first_stable, CASE WHEN doc_id % 17 <> 0 THEN greatest(0, doc_id % 2500 + 9500 - (doc_id % 3000 + 9000)) END AS release_to_paste, greatest(0, doc_id % 4000 + 10000 - (doc_id % 3000 + 9000)) AS release_to_final FROM f"""

SQL = {
    "filled_results": _RUNS + "SELECT r.id, backend, coalesce(CASE WHEN r.doc_id % 3 <> 0 THEN r.source END, c.source) AS source, coalesce(CASE WHEN r.doc_id % 5 <> 0 THEN r.category END, c.category) AS category, c.trust FROM runs r LEFT JOIN clips c ON r.id = c.id",
    "known_results": _RUNS + "SELECT backend, count(*) AS n FROM runs WHERE id IN (SELECT id FROM clips WHERE trust <> 'needs_human_review') GROUP BY 1",
    "rescored_terms": _RUNS
    + f""", t AS (SELECT doc_id, backend, ' ' || {T.plain('actual')} || ' ' AS said, lower(actual) AS raw, gold, CASE WHEN doc_id % 2 = 1 THEN concat_ws(', ', toks[1], toks[5], 'Foo!') END AS named FROM runs),
g AS (SELECT *, list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce(named, ''), '[,;\n]+'), lambda z: {T.plain('z')}), lambda z: z <> '')) AS given FROM t),
e AS (SELECT *, CASE WHEN len(given) > 0 THEN given ELSE {T.anchors('gold')} END AS terms FROM g), h AS (SELECT *, len(list_filter(terms, lambda x: {T.hit('x')})) AS heard FROM e)
SELECT doc_id, backend, CASE WHEN len(terms) > 0 THEN round(heard::DOUBLE / len(terms), 3) END AS term_coverage, (len(terms) - heard)::INT AS misses FROM h""",
    "variant_scores": _RUNS
    + f""", q AS (SELECT id, backend, actual, list_transform(hyp, lambda x: lower(x)) AS h, unnest([{{'p': 0, 's': 'primary', 'w': toks}}, {{'p': 1, 's': 'half', 'w': list_slice(toks, 1, len(toks) // 2)}}]) AS x FROM runs),
t AS (SELECT id, backend, h, x.p AS p, x.s AS source, array_to_string(x.w, ' ') AS gold, list_transform(x.w, lambda z: lower(z)) AS r, ' ' || {T.plain('actual')} || ' ' AS said, lower(actual) AS raw FROM q),
c AS (SELECT *, list_distinct(list_concat(r, h)) AS k, {T.concepts('r')} AS cr, {T.concepts('h')} AS ch, {T.anchors('gold')} AS terms FROM t),
m AS (SELECT *, CASE WHEN gold = '' THEN 1.0 ELSE {_wer('k')} END AS wer, CASE WHEN gold = '' THEN 0.0 WHEN len(cr) = 0 THEN 1.0 ELSE round(len(list_intersect(cr, ch))::DOUBLE / len(cr), 3) END AS coverage, CASE WHEN len(terms) > 0 THEN round(len(list_filter(terms, lambda x: {T.hit('x')}))::DOUBLE / len(terms), 3) END AS tc FROM c),
z AS (SELECT *, 0.70::DOUBLE * coverage + 0.20::DOUBLE * coalesce(tc, coverage) + 0.10::DOUBLE * greatest(0.0, 1 - least(wer, 1.0)) AS score FROM m)
SELECT id, backend, source, round(score + 1e-9, 3) AS score, coverage, wer FROM (SELECT *, row_number() OVER (PARTITION BY id, backend ORDER BY score DESC, p) AS place FROM z) WHERE place = 1""",
    "merged_corpora": _CLIPS
    + """, c AS (SELECT id, category, 'trusted' AS source_corpus, NULL::VARCHAR AS trust, 0 AS p FROM clips WHERE trust = 'gold' UNION ALL SELECT id, category, 'all', trust, 1 FROM clips)
SELECT CASE WHEN n > 1 THEN id || '__dup' || n ELSE id END AS id, category, source_corpus, trust FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS n FROM c)""",
    "first_per_class": _CLIPS + "SELECT category, doc_id, id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS n FROM clips) WHERE n <= CASE category " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in QUOTAS.items()) + " ELSE 0 END",
    "pool_summary": _SCORED
    + """SELECT backend, category, count(*) AS clips, round(avg(wer) + 1e-9, 4) AS avg_wer, round(avg(meaning_coverage) + 1e-9, 4) AS avg_coverage, round(avg(term_coverage) + 1e-9, 4) AS avg_terms, round(avg(useful_score) + 1e-9, 4) AS avg_meaning, round(avg(verbatim_score) + 1e-9, 4) AS avg_verbatim,
  round(quantile_cont(seconds::DOUBLE, 0.5), 3) AS p50_seconds, round(avg((seconds > 6 OR error IS NOT NULL)::INT), 4) AS hang_rate FROM scored GROUP BY 1, 2""",
    "split_metrics": _METRICS + "SELECT * FROM metrics",
    "measured_map": _METRICS + """SELECT backend, '{' || string_agg('"' || bucket || '":{"clips":' || clips || ',"useful":' || useful || ',"p95_seconds":' || p95_seconds || '}', ',' ORDER BY bucket) || '}' AS measured FROM metrics GROUP BY 1""",
    "strategy_flags": _METRICS
    + f""", {_OVER}, c AS (SELECT max(useful) FILTER (WHERE backend = 'accurate' AND bucket = 'english_only') AS e, max(useful) FILTER (WHERE backend = 'accurate' AND bucket = 'hindi_english') AS h,
  max(p95_seconds) FILTER (WHERE backend = 'accurate' AND bucket = 'hindi_english') AS s, max(p95_seconds) FILTER (WHERE backend = 'fast' AND bucket = 'english_only') AS f FROM metrics)
SELECT coalesce(e >= 0.90, false) AS english_ok, coalesce(h >= 0.85, false) AS hindi_english_ok, coalesce(s <= 4.5, false) AS hindi_english_in_time, coalesce(f <= 2.0, false) AS english_fast, n = 0 AS no_blind_overwrite FROM c, o""",
    "goal_blockers": _METRICS
    + f""", {_OVER}, c AS (SELECT coalesce(max(useful) FILTER (WHERE backend = 'accurate' AND bucket = 'english_only'), 0) AS e, coalesce(max(useful) FILTER (WHERE backend = 'accurate' AND bucket = 'hindi_english'), 0) AS h, coalesce(max(p95_seconds) FILTER (WHERE backend = 'accurate' AND bucket = 'hindi_english'), 999) AS s FROM metrics),
f AS (SELECT concat_ws(',', CASE WHEN e < 0.9 THEN 'english_below_target' END, CASE WHEN h < 0.5 THEN 'hindi_english_below_target' END, CASE WHEN s > 4.5 THEN 'hindi_english_latency_over_budget' END, CASE WHEN n > 0 THEN 'blind_english_overwrite' END) AS blockers FROM c, o)
SELECT blockers = '' AS goal_met, blockers FROM f""",
    "goal_status": f"""WITH b AS ({HISTORY['leaderboard']}), r AS (SELECT (SELECT count(*) FROM ({_CLIPS} SELECT 1 FROM clips WHERE trust = 'gold')) AS c, (SELECT count(*) FROM ({_CLIPS} SELECT 1 FROM clips WHERE trust = 'silver')) AS u, (SELECT count(*) FROM ({_CLIPS} SELECT 1 FROM clips)) AS n),
p AS (SELECT *, avg_useful >= 0.75 AND usable_rate >= 0.80 AND p95_seconds <= 2.5 AND hang_risk_rate <= 0.02 AS ok FROM b, r)
SELECT backend, ok AS fixed_pass, CASE WHEN NOT ok THEN 'quality_or_latency_on_fixed_corpus' WHEN c < 20 AND u < 20 THEN CASE WHEN n = 0 THEN 'representative_audio_missing' WHEN c = 0 AND u = 0 THEN 'retained_audio_not_representative' ELSE 'representative_corpus_too_small' END
  WHEN c >= 20 AND u >= 20 THEN 'ready_for_strategy_bakeoff' WHEN u >= 20 THEN 'ready_for_real_use_strategy_bakeoff' ELSE 'ready_for_capture_sheet_strategy_bakeoff' END AS bottleneck FROM p""",
    "release_gate": _SCORED.replace("term_coverage, critical, seconds, error,", "term_coverage, critical, seconds, error, gold, actual,") + _gate(),
    "reject_histogram": f"WITH {_UPDATES} SELECT 'reason' AS kind, string_split(r, ':')[1] AS name, count(*) AS n FROM (SELECT unnest(reasons) AS r FROM upd) GROUP BY 1, 2 UNION ALL SELECT 'accepted', bucket, count(*) FROM upd WHERE len(reasons) = 0 GROUP BY 1, 2",
    "polish_rules": _CLIPS
    + f""", t AS (SELECT doc_id, gold || CASE WHEN doc_id % 7 = 0 THEN ' solve for a cursor now' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN ' Company data cannot go to the cloud so it should be a solution because' ELSE '' END AS t FROM clips)
SELECT rule, count(*) AS n FROM (SELECT unnest({_RULES}) AS rule FROM t WHERE doc_id % 2 = 0) GROUP BY 1""",
    "tool_statuses": """WITH p AS (SELECT p_brand AS tool, max(p_type) FILTER (WHERE p_size < 10) AS status, max(p_size) > 49 AS measured FROM part GROUP BY 1)
SELECT tool, CASE WHEN measured THEN 'measured_engine' ELSE coalesce(status, 'missing') END AS coverage, CASE WHEN measured THEN 'scorecard' WHEN status IS NOT NULL THEN 'status_probe' ELSE '' END AS evidence FROM p""",
    "ab_summary": _SCORED
    + """SELECT CASE backend WHEN 'fast' THEN 'current' ELSE 'proposed' END AS version, count(*) FILTER (WHERE error IS NULL) AS n, count(error) AS errors, round(avg(meaning_coverage) FILTER (WHERE error IS NULL) + 1e-9, 4) AS meaning, round(avg(wer) FILTER (WHERE error IS NULL) + 1e-9, 4) AS wer,
  round(quantile_cont(CASE WHEN error IS NULL THEN seconds::DOUBLE END, 0.5), 4) AS p50, round(quantile_cont(CASE WHEN error IS NULL THEN seconds::DOUBLE END, 0.95), 4) AS p95, count(*) FILTER (WHERE NOT usable) AS triggered FROM scored WHERE backend <> 'tiny' GROUP BY 1""",
    "capture_summary": _RUNS
    + """, c AS (SELECT backend, error IS NULL AND trim(actual) <> '' AS ok, seconds::DOUBLE AS e, (doc_id % 5)::DOUBLE + seconds::DOUBLE + 0.5 - (doc_id % 5)::DOUBLE AS r FROM runs)
SELECT backend, count(*) AS n, count(*) FILTER (WHERE ok) AS ok, """
    + ", ".join(f"round(quantile_cont(CASE WHEN ok THEN {c} END, {p}), 4) AS {n}_p{round(100 * p)}" for n, c in (("e2e", "e"), ("release", "r")) for p in (0.5, 0.95))
    + " FROM c GROUP BY 1",
    "product_rows": _RUNS
    + """, f AS (SELECT f.id, p.doc_id % 3 <> 0 AND p.error IS NULL AS ok, f.seconds::DOUBLE AS s, p.seconds::DOUBLE AS t, f.actual AS a, p.actual AS b FROM runs f JOIN runs p ON f.id = p.id AND f.backend = 'fast' AND p.backend = 'accurate')
SELECT CASE WHEN ok THEN 'hindi_polish_replaced' ELSE 'fast_kept' END AS route, CASE WHEN ok THEN 'polish' ELSE 'first' END AS selected_from, count(*) AS n, round(avg(CASE WHEN ok THEN s + t ELSE s END), 4) AS seconds, sum(length(CASE WHEN ok THEN b ELSE a END))::BIGINT AS chars FROM f GROUP BY 1, 2""",
    "selection_summary": _SCORED
    + """, f AS (SELECT f.id, p.doc_id % 3 <> 0 AND p.error IS NULL AS ok, f.seconds::DOUBLE AS s, p.seconds::DOUBLE AS t, f.useful_score AS a, p.useful_score AS b FROM scored f JOIN scored p ON f.id = p.id AND f.backend = 'fast' AND p.backend = 'accurate'),
a AS (SELECT backend, useful_score AS u, seconds::DOUBLE AS s, false AS p FROM scored UNION ALL SELECT 'final', CASE WHEN ok THEN b ELSE a END, CASE WHEN ok THEN s + t ELSE s END, ok FROM f)
SELECT backend, count(*) AS clips, round(avg(u) + 1e-9, 4) AS avg_score, count(*) FILTER (WHERE p) AS from_polish, round(list_sort(list(s))[CAST(round_even(0.5 * (count(*) - 1), 0) AS BIGINT) + 1], 3) AS p50_seconds, round(list_sort(list(s))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1], 3) AS p95_seconds FROM a GROUP BY 1""",
    "first_times": f"SELECT doc_id, coalesce(first_partial, -1) AS first_partial, coalesce(first_stable, -1) AS first_stable, coalesce(release_to_paste, -1) AS release_to_paste, release_to_final FROM ({_TIMES})",
    "stream_updates": _RUNS
    + f""", r AS (SELECT backend, quality_flags IS NOT NULL AS risk, error IS NULL AND seconds < 6 AS safe, len(hyp) > 30 AS value, len(hyp) < len(toks) AS part, CASE WHEN error IS NOT NULL THEN 'failed' WHEN seconds < 2 THEN 'fast' ELSE 'slow' END AS route, seconds::DOUBLE AS tail FROM runs),
k AS (SELECT backend, string_agg(route || '=' || c, ',' ORDER BY route || '=' || c) AS routes FROM (SELECT backend, route, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT backend, count(*) AS n, count(*) FILTER (WHERE risk) AS risks, count(*) FILTER (WHERE safe) AS safe, count(*) FILTER (WHERE value) AS valuable, count(*) FILTER (WHERE safe AND value) AS safe_valuable, count(*) FILTER (WHERE part) AS partial, round(quantile_cont(tail, 0.5), 3) AS p50_tail, list_sort(list(tail)) AS x, {_J} AS j FROM r GROUP BY 1)
SELECT s.* EXCLUDE (x, j), routes, round({_EXCLUSIVE} + 1e-9, 3) AS p95_tail FROM s JOIN k USING (backend)""",
    "corpus_violations": _CLIPS
    + f""", c AS (SELECT category || '_' || (doc_id % 5000) AS id, gold, len(toks) >= 10 AS facts, list_has_any(string_split({T.spoken('gold')}, ' '), {T.listed(R.POLARITY)}) AS guarded, doc_id % 2 = 0 AS checked FROM clips),
r AS (SELECT 'no_gold' AS rule, id FROM c WHERE trim(gold) = '' UNION ALL SELECT 'no_facts', id FROM c WHERE NOT facts UNION ALL SELECT 'no_polarity_check', id FROM c WHERE guarded AND NOT checked UNION ALL SELECT 'duplicate_id', id FROM c GROUP BY id HAVING count(*) > 1)
SELECT rule, id, count(*) AS n FROM r GROUP BY 1, 2""",
    "term_checklist": f"""WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(coalesce("text", '')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS s FROM documents),
p AS (SELECT doc_id, {' + '.join('(' + ' OR '.join(f"contains(s, ' {x} ')" for x in phrases) + ')::INT' for phrases in CHECKS.values())} AS passed FROM d) SELECT doc_id, passed, passed >= 3 AS enough FROM p""",
    "two_way_buckets": _CLIPS + f"SELECT {_BUCKET} AS value, count(*) AS n FROM clips GROUP BY 1",
    "clip_categories": _CLIPS
    + f""", c AS (SELECT CASE WHEN doc_id % 3 = 0 THEN lower(trim(category)) ELSE '' END AS given, regexp_matches(g, '[\\x{{0900}}-\\x{{097F}}]') AS indic, list_has_any({_WORDS('g')}, {T.listed(R.CATEGORY_HINDI)}) AS h, list_has_any({_WORDS('g')}, {T.listed(R.CATEGORY_ENGLISH)}) AS e
  FROM (SELECT *, gold || CASE doc_id % 4 WHEN 0 THEN ' kaise problem' WHEN 1 THEN ' नमस्ते' ELSE '' END AS g FROM clips))
SELECT CASE WHEN given <> '' THEN given WHEN indic AND NOT e THEN 'hindi' WHEN indic OR (h AND e) THEN 'hinglish' ELSE 'english' END AS value, count(*) AS n FROM c GROUP BY 1""",
    "release_trusted": _CLIPS + "SELECT doc_id % 9 <> 0 AND doc_id % 7 <> 0 AND NOT regexp_matches(lower(trust), 'needs_human_review|needs human review|needs_review') AND trim(gold) <> '' AS value, count(*) AS n FROM clips GROUP BY 1",
    "length_fits": f"""SELECT lang, len(regexp_extract_all(coalesce("text", ''), '[^\\x20\\x09-\\x0D]+')) BETWEEN 3 AND 220 AND length({T.spaced('"text"')}) BETWEEN 12 AND 1400 AS fits, count(*) AS n FROM documents GROUP BY 1, 2""",
    "review_statuses": _UTTERANCES
    + f""", t AS (SELECT *, {_EFFECTIVE('pasted_text', 'corrected_text', 'raw_text')} AS x FROM utterances), w AS (SELECT *, list_filter(regexp_extract_all(lower(x), '[a-z0-9+#.]+'), lambda z: length(z) > 1) AS w FROM t),
u AS (SELECT *, NOT (status IN ('too_short', 'no_speech') OR {_FAILED('lower(x)')} OR seconds < 0.8) AND NOT (len(w) > 0 AND len(list_filter(w, lambda z: z NOT IN ('yo', 'come', 'what', 'how', 'going'))) = 0) AND len(w) >= 5 AS usable,
  len({_HITS('x')}) > 0 OR (coalesce(lower(app), '') IN ('codex', 'claude') AND len(w) >= 12 AND seconds >= 5) AS work FROM w)
SELECT ordinal, CASE WHEN usable AND work THEN 'review_ready' WHEN usable THEN 'auto_candidate' ELSE 'skip' END AS review_status FROM u""",
    "gold_candidates": _UTTERANCES
    + f""", t AS (SELECT *, {T.spaced("coalesce(nullif(raw_text, ''), nullif(pasted_text, ''), nullif(corrected_text, ''))")} AS x FROM utterances),
g AS (SELECT audio_path, min(ordinal) AS ordinal, arg_min(x, ordinal) AS x FROM t WHERE status = 'paste_attempted' AND paste_success AND error_type IS NULL AND seconds >= 2 AND length(x) >= 20 AND NOT regexp_matches(x, '[\\x{{0900}}-\\x{{0DFF}}]') GROUP BY 1)
SELECT audio_path, ordinal, md5(x) AS text_md5 FROM g ORDER BY ordinal DESC LIMIT 300""",
    "work_candidates": _UTTERANCES
    + f""", t AS (SELECT *, 'history_' || replace(run_id, '-', '_') AS candidate_id, {T.spaced("regexp_replace(" + _EFFECTIVE('corrected_text', 'pasted_text', 'raw_text') + r", '(?i)\[(?:BLANK_AUDIO|NOISE|SILENCE|INAUDIBLE)\]', ' ', 'g')")} AS x FROM utterances WHERE status NOT IN ('too_short', 'no_speech') AND error_type IS NULL AND seconds >= 1.5),
h AS (SELECT candidate_id, run_id, {_HITS('x')} AS words FROM t WHERE ordinal % 10 <> 0 AND length(x) >= 25 AND NOT regexp_matches(lower(x), 'asr failure detected|transcript looks empty or repetitive|retry with language set'))
SELECT candidate_id, run_id, array_to_string(words, ',') AS words FROM h WHERE len(words) > 0""",
    "later_success": _UTTERANCES + "SELECT audio_path, run_id FROM (SELECT *, row_number() OVER (PARTITION BY audio_path ORDER BY CASE status WHEN 'finalizer_replaced' THEN 2 WHEN 'paste_attempted' THEN 1 ELSE 0 END DESC, ordinal DESC) AS k FROM utterances WHERE paste_success) WHERE k = 1",
    "learnable_texts": f"{_UTTERANCES}, {_learnable_sql()} SELECT ordinal, text FROM learnable",
    "safe_ids": f"""SELECT page_id, substring(regexp_replace(regexp_replace(regexp_replace({T.stripped('url')}, '[^A-Za-z0-9_.-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 140) AS safe FROM pages""",
    "best_safe": _safe_sql(),
    "derived_backends": _RUNS + "SELECT backend, '' AS derived_from, count(*) AS n, 0::BIGINT AS rewritten FROM runs GROUP BY 1 UNION ALL SELECT 'fast_written', 'fast', count(*), count(*) FILTER (WHERE doc_id % 3 = 0) FROM runs WHERE backend = 'fast'",
    "winning_actions": _RUNS
    + """, a AS (SELECT id, actual, CASE backend WHEN 'fast' THEN 'finalizer' WHEN 'accurate' THEN 'structure' ELSE 'termPolish' END AS action, CASE backend WHEN 'fast' THEN 3 WHEN 'accurate' THEN 1 ELSE 2 END AS p FROM runs WHERE error IS NULL AND seconds < 6)
SELECT action, count(*) AS n, sum(length(actual))::BIGINT AS chars FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS k FROM a) WHERE k = 1 GROUP BY 1""",
    "suggested_labels": _RUNS
    + """, p AS (SELECT doc_id, trim(max(actual) FILTER (WHERE backend = 'fast')) AS f, CASE WHEN doc_id % 3 = 0 THEN '' ELSE trim(max(actual) FILTER (WHERE backend = 'accurate')) END AS c, trim(max(actual) FILTER (WHERE backend = 'tiny')) AS r FROM runs GROUP BY 1),
s AS (SELECT CASE WHEN doc_id % 5 = 0 AND c <> '' THEN 'current_final_safe_update' WHEN doc_id % 4 = 1 THEN 'fast_text_rejected_hindi_candidate' WHEN doc_id % 2 = 0 AND r <> '' AND c = '' THEN 'fast_text_risk_no_safe_update' ELSE 'fast_or_current_no_hindi_risk' END AS source, f, c FROM p)
SELECT source, count(*) AS n, sum(length(CASE source WHEN 'current_final_safe_update' THEN c WHEN 'fast_text_rejected_hindi_candidate' THEN CASE WHEN f <> '' THEN f ELSE c END WHEN 'fast_text_risk_no_safe_update' THEN f ELSE CASE WHEN c <> '' THEN c ELSE f END END))::BIGINT AS chars FROM s GROUP BY 1""",
    "meaning_reasons": _RUNS
    + f""", p AS (SELECT doc_id, max(actual) FILTER (WHERE backend = 'fast') AS a, max(actual) FILTER (WHERE backend = 'accurate') || CASE WHEN doc_id % 13 = 0 THEN ' with' ELSE '' END AS b FROM runs GROUP BY 1),
c AS (SELECT *, list_filter({_NUM('a')}, lambda w: length(w) >= 4 AND w NOT IN ({_IN(R.COMMON_ENGLISH)})) AS dt, list_filter({_NUM('b')}, lambda w: length(w) >= 4 AND w NOT IN ({_IN(R.COMMON_ENGLISH)})) AS ft FROM p),
s AS (SELECT *, list_distinct(dt) AS d, list_distinct(ft) AS f, len(list_intersect(dt, ft)) AS common FROM c), k AS (SELECT *, common::DOUBLE / greatest(1, len(d)) AS kept, len(f) - common AS new, len(d) - common AS gone FROM s)
SELECT CASE WHEN len(dt) < 4 OR len(ft) < 4 THEN 'fits' WHEN {_NUM('b')}[-1] IN ({_IN(R.OPEN_ENDS)}) THEN 'incomplete-tail' WHEN kept < 0.78 AND new < 6 THEN 'default-meaning-drop' WHEN new < 3 THEN 'no-default-meaning-gain' WHEN kept < 0.85 AND gone >= 2 THEN 'default-meaning-tradeoff' ELSE 'fits' END AS reason, count(*) AS n FROM k GROUP BY 1""",
    "candidate_terms": f"WITH {_TEXTS} SELECT term, count(*) AS texts FROM (SELECT unnest({_candidates('x')}) AS term FROM d) GROUP BY 1",
    "contextual_acronyms": _CLIPS + f", d AS (SELECT doc_id, 'NASA term ' || gold || ' the API keyword' AS x FROM clips) SELECT doc_id, array_to_string({_contextual('x')}, ',') AS acronyms FROM d",
    "named_terms": f"WITH {_TEXTS} SELECT term, count(*) AS texts FROM (SELECT unnest({_NAMED}) AS term FROM d) GROUP BY 1",
    "leading_terms": f"""WITH {_TEXTS}, w AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, list_filter(regexp_extract_all({_narrowed('x')}, '[A-Za-z][A-Za-z0-9.+#-]{{2,}}'), lambda z: lower(z) NOT IN ({_IN(terms.LONG_STOP)}) AND (regexp_matches(z, '^[A-Z]|[0-9]') OR length(z) >= 7)) AS w FROM d)),
f AS (SELECT doc_id, t, min(i) AS i FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f) SELECT t AS term, count(*) AS texts FROM r WHERE k <= 12 GROUP BY 1""",
    "learn_terms": f"""{_UTTERANCES}, {_learnable_sql()}, n AS (SELECT * FROM (SELECT * FROM learnable ORDER BY ordinal DESC LIMIT 300) WHERE text <> ''),
c AS (SELECT term, count(*) AS count FROM (SELECT unnest({_candidates('text')}) AS term FROM n) GROUP BY 1), s AS (SELECT DISTINCT lower(unnest({_contextual('text')})) AS k FROM n)
SELECT term, count FROM c WHERE ({_telling('term')} OR len(list_filter(string_split(term, ' '), lambda w: {_product('w')})) > 0) AND (count >= 2 OR lower(term) IN (SELECT k FROM s))""",
    "keyword_hits": _UTTERANCES + f"SELECT ordinal, array_to_string({_HITS('corrected_text')}, ',') AS hits FROM utterances",
    "tool_seconds": _RUNS
    + """, t AS (SELECT CASE backend WHEN 'tiny' THEN 'cloud' ELSE backend END AS tool, CASE WHEN doc_id % 2 = 0 THEN seconds::DOUBLE * 1000 / 1000 END AS c, CASE WHEN doc_id % 3 <> 0 THEN seconds::DOUBLE END AS s, CASE WHEN doc_id % 5 <> 0 THEN seconds::DOUBLE + 0.5 END AS p FROM runs)
SELECT tool, count(x) AS n, round(avg(x), 4) AS seconds FROM (SELECT tool, CASE WHEN tool = 'cloud' THEN c ELSE coalesce(s, c, p) END AS x FROM t) GROUP BY 1""",
}
SQL["stream_latency"] = f"""WITH t AS ({_TIMES}), e AS (SELECT t.*, category, CASE WHEN t.doc_id % 19 = 0 THEN 'late' END AS error FROM t JOIN ({_CLIPS} SELECT doc_id, category FROM clips) USING (doc_id)),
g AS (SELECT category, count(*) AS n, round(quantile_cont(first_partial, 0.5), 1) AS p50_first_partial, round(quantile_cont(first_stable, 0.5), 1) AS p50_first_stable, round(quantile_cont(release_to_paste, 0.5), 1) AS p50_paste, round(quantile_cont(release_to_final, 0.5), 1) AS p50_final, count(error) AS error_rows,
  list_sort(list(release_to_paste) FILTER (WHERE release_to_paste IS NOT NULL)) AS x, list_sort(list(release_to_final)) AS y FROM e GROUP BY 1)
SELECT * EXCLUDE (x, y), x[CAST(floor(0.95 * (len(x) - 1) + 0.5) AS BIGINT) + 1]::DOUBLE AS p95_paste, y[CAST(floor(0.95 * (len(y) - 1) + 0.5) AS BIGINT) + 1]::DOUBLE AS p95_final FROM g"""
