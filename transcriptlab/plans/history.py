"""Registered queries that score, summarise and sample, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, history, scoring
from ..sources import views as v
from . import sqltext as T

LIMITS = {"p95_seconds": 8.0, "max_seconds": 9.0, "useful": 0.6, "usable_rate": 0.1}


def _scored(s, d):
    return scoring.score_runs(v.runs(s, d))


def _ratings(s, d):
    """Brands as tools and types as axes, with two weightings; one of them leaves axes out."""
    parts = v.table(s, d, "part")
    rated = parts.groupBy(F.col("p_brand").alias("tool"), F.col("p_type").alias("axis")).agg(F.avg(F.col("p_size") / 10.0).alias("rating"))
    uses = F.explode(F.array(*[F.struct(F.lit(u).alias("use"), w.alias("weight")) for u, w in (("dictation", F.length("axis") % 5 + 1), ("meetings", F.length("axis") % 3))]))
    weights = rated.select("axis").distinct().select("axis", uses.alias("x")).select("axis", "x.use", "x.weight").filter("weight > 0")
    return rated, weights


QUERIES = {
    "leaderboard": lambda s, d: scoring.leaderboard(_scored(s, d)),
    "category_backend_summary": lambda s, d: scoring.category_summary(_scored(s, d)),
    "bucket_rollup_with_all": lambda s, d: scoring.bucket_rollup(_scored(s, d)),
    "paired_delta_ci": lambda s, d: scoring.paired_delta(_scored(s, d), "accurate", "fast"),
    "quality_gate": lambda s, d: scoring.quality_gate(_scored(s, d), LIMITS),
    "worst_k_per_bucket": lambda s, d: scoring.worst_runs(_scored(s, d), 5),
    "trap_summary": lambda s, d: corpus.failure_traps(v.trapped_runs(s, d)),
    "attempt_health": lambda s, d: history.health(v.attempts(s, d)),
    "status_counts": lambda s, d: history.status_counts(v.attempts(s, d)),
    "percentile_family": lambda s, d: history.percentiles(v.attempts(s, d)),
    "rolling_health_tumbling": lambda s, d: history.rolling_health(v.attempts(s, d)),
    "rolling_health_sliding": lambda s, d: history.rolling_health(v.attempts(s, d), "1 hour", "10 minutes"),
    "session_funnel": lambda s, d: history.sessions(v.attempts(s, d)),
    "best_event_per_audio": lambda s, d: history.best_per_audio(v.attempts(s, d)),
    "asof_feedback": lambda s, d: history.feedback_asof(v.table(s, d, "events")),
    "resume_pending": lambda s, d: history.pending(v.attempts(s, d), v.attempts(s, d)),
    "newest_attempts": lambda s, d: history.newest(v.attempts(s, d), 300).select("run_id", "status"),
    "dedupe_by_trust": lambda s, d: corpus.dedupe_by_trust(v.clips(s, d)),
    "dup_suffix": lambda s, d: corpus.number_repeats(v.clips(s, d)),
    "first_wins_text": lambda s, d: corpus.first_wins(v.clips(s, d)),
    "even_sample": lambda s, d: corpus.even_sample(v.clips(s, d), 5),
    "best_match_prompt": lambda s, d: corpus.best_match(v.spread(v.table(s, d, "documents")), v.table(s, d, "benchmark")),
    "caption_window": lambda s, d: corpus.captions_in_window(v.captions(s, d)),
    "pipeline_tail": lambda s, d: corpus.pipeline_tail(v.segments(s, d)),
    "stable_prefix": lambda s, d: corpus.stable_prefix(v.drafts(s, d)),
    "silence_windows": lambda s, d: corpus.silence(v.table(s, d, "embeddings")),
    "language_mix": lambda s, d: corpus.language_mix(v.table(s, d, "documents")),
    "mine_terms": lambda s, d: corpus.mine_terms(v.spread(v.table(s, d, "documents"))),
    "vocabulary": lambda s, d: corpus.vocabulary(v.spread(v.table(s, d, "documents"))),
    "correction_context": lambda s, d: corpus.correction_context(v.corrected_turns(s, d)),
    "weighted_rank": lambda s, d: corpus.weighted_rank(*_ratings(s, d)),
}

#: Scores in SQL.  Tokens of a pair become characters from code 33 on, so that its bytewise distance counts tokens (at most 94 of them).
_SHARES = ", ".join(
    f"CASE WHEN n >= {3 * z} AND floor(coalesce(list_max(list_transform(string_split(array_to_string(list_transform(range(1, n - {z} + 1), lambda i: CASE WHEN h[i] = h[i + {z}] THEN '1' ELSE '0' END), ''), '0'), lambda x: length(x))), 0) / {z}) + 1 >= 3"
    f" THEN {z} * (floor(list_max(list_transform(string_split(array_to_string(list_transform(range(1, n - {z} + 1), lambda i: CASE WHEN h[i] = h[i + {z}] THEN '1' ELSE '0' END), ''), '0'), lambda x: length(x))) / {z}) + 1) / n ELSE 0 END"
    for z in range(2, 9)
)
_SCORED = (
    v.with_views("clips", "runs")
    + f""", t AS (SELECT *, list_transform(toks, lambda x: lower(x)) AS r, list_transform(hyp, lambda x: lower(x)) AS h, ' ' || {T.plain('actual')} || ' ' AS said, lower(actual) AS raw, {T.anchors('gold')} AS terms FROM runs),
u AS (SELECT *, list_distinct(list_concat(r, h)) AS k, len(h) AS n, {T.concepts('r')} AS cr, {T.concepts('h')} AS ch, len(list_filter(terms, lambda x: {T.hit('x')})) AS heard, {T.critical('actual', 'quality_flags')} AS critical FROM t),
w AS (SELECT *, CASE WHEN len(r) = 0 THEN CASE WHEN len(h) = 0 THEN 0.0 ELSE 1.0 END ELSE round(levenshtein(array_to_string(list_transform(r, lambda x: chr(CAST(32 + list_position(k, x) AS INTEGER))), ''), array_to_string(list_transform(h, lambda x: chr(CAST(32 + list_position(k, x) AS INTEGER))), ''))::DOUBLE / len(r), 3) END AS wer,
  CASE WHEN len(cr) = 0 THEN 1.0 ELSE round(len(list_intersect(cr, ch))::DOUBLE / len(cr), 3) END AS meaning_coverage, CASE WHEN len(terms) > 0 THEN round(heard::DOUBLE / len(terms), 3) END AS term_coverage,
  CASE WHEN n < 8 THEN 0.0 ELSE round(greatest({_SHARES})::DOUBLE, 3) END AS repeat FROM u),
x AS (SELECT *, CASE WHEN seconds <= 1 THEN 1.0 WHEN seconds <= 2 THEN 0.85 WHEN seconds <= 4 THEN 0.65 WHEN seconds <= 8 THEN 0.35 ELSE 0.0 END::DOUBLE AS speed,
  CASE WHEN error IS NOT NULL THEN 0.0 ELSE round(greatest(0.0, 1 - least(repeat, 1.0)), 3) END::DOUBLE AS reliable, error IS NULL AND repeat < 0.2 AS clean FROM w),
y AS (SELECT *, 0.45::DOUBLE * meaning_coverage + 0.20::DOUBLE * coalesce(term_coverage, meaning_coverage) + 0.15::DOUBLE * greatest(0.0, 1 - least(wer, 1.0)) + 0.10::DOUBLE * speed + 0.10::DOUBLE * reliable AS raw_score FROM x),
v AS (SELECT *, CASE WHEN {T.mixed('category', 'gold')} THEN raw_score * (0.65 + 0.35 * {T.language('gold', 'actual')}) ELSE raw_score END AS raw_verbatim FROM y),
z AS (SELECT *, CASE WHEN critical THEN least(raw_score, 0.5) ELSE raw_score END AS useful, CASE WHEN critical THEN least(raw_verbatim, 0.5) ELSE raw_verbatim END AS verbatim FROM v),
scored AS (SELECT doc_id, id, category, source, trust, backend, wer, meaning_coverage, term_coverage, critical, seconds, error, round(useful + 1e-9, 3) AS useful_score, round(verbatim + 1e-9, 3) AS verbatim_score, repeat, useful >= 0.75 AND seconds <= 2.5 AND clean AND NOT critical AS usable, seconds <= 1.5 AS fast, seconds > 6 OR NOT clean AS hang_risk FROM z)
"""
)
_INDEX = "CAST({} AS BIGINT)"

SQL = {
    "leaderboard": _SCORED
    + """SELECT backend, count(*) AS clips, round(avg(useful_score) + 1e-9, 4) AS avg_useful, round(quantile_cont(useful_score, 0.5), 4) AS median_useful, round(avg(wer) + 1e-9, 4) AS avg_wer, round(avg(meaning_coverage) + 1e-9, 4) AS avg_coverage,
  round(quantile_cont(seconds::DOUBLE, 0.5), 4) AS p50_seconds, round(list_sort(list(seconds::DOUBLE))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1], 4) AS p95_seconds,
  round(avg(usable::INT), 4) AS usable_rate, round(avg(fast::INT), 4) AS fast_rate, round(avg(hang_risk::INT), 4) AS hang_risk_rate FROM scored GROUP BY backend""",
    "category_backend_summary": _SCORED + "SELECT category, backend, count(*) AS n, round(avg(wer) + 1e-9, 4) AS wer, round(avg(1 - meaning_coverage), 4) AS meaning_loss, round(avg(seconds::DOUBLE), 4) AS seconds FROM scored GROUP BY ALL",
    "bucket_rollup_with_all": _SCORED + "SELECT backend, coalesce(category, 'all') AS bucket, count(*) AS n, round(avg(useful_score) + 1e-9, 4) AS useful, round(avg(wer) + 1e-9, 4) AS wer FROM scored GROUP BY GROUPING SETS ((backend, category), (backend))",
    "paired_delta_ci": _SCORED
    + """, d AS (SELECT a.category, a.useful_score - b.useful_score AS u, a.wer - b.wer AS w, a.seconds::DOUBLE - b.seconds::DOUBLE AS s FROM scored a JOIN scored b ON a.id = b.id AND a.backend = 'accurate' AND b.backend = 'fast')
SELECT category, count(*) AS n, round(avg(u), 4) AS useful_delta, round(avg(w), 4) AS wer_delta, round(avg(s), 4) AS seconds_delta, round(avg(u) - 1.96 * stddev_samp(u) / sqrt(count(u)), 4) AS low, round(avg(u) + 1.96 * stddev_samp(u) / sqrt(count(u)), 4) AS high FROM d GROUP BY category""",
    "quality_gate": _SCORED
    + """, f AS (SELECT backend, quantile_cont(seconds::DOUBLE, 0.95) AS p95_seconds, max(seconds)::DOUBLE AS max_seconds, avg(useful_score) AS useful, avg(usable::INT) AS usable_rate FROM scored GROUP BY backend),
l AS (SELECT backend, 'p95_seconds' AS metric, p95_seconds AS value, 8.0::DOUBLE AS threshold FROM f UNION ALL SELECT backend, 'max_seconds', max_seconds, 9.0 FROM f UNION ALL SELECT backend, 'useful', useful, 0.6 FROM f UNION ALL SELECT backend, 'usable_rate', usable_rate, 0.1 FROM f)
SELECT backend, metric, round(value, 4) AS value, threshold, CASE WHEN metric LIKE '%seconds' THEN value <= threshold ELSE value >= threshold END AS passed FROM l""",
    "worst_k_per_bucket": _SCORED + "SELECT backend, category, rank::INT AS rank, id, useful_score FROM (SELECT *, row_number() OVER (PARTITION BY backend, category ORDER BY useful_score, doc_id) AS rank FROM scored) WHERE rank <= 5",
    "trap_summary": v.with_views("clips", "runs") + """SELECT backend, trap, count(*) AS n, round(avg(seconds::DOUBLE), 4) AS seconds, count(error) AS errors FROM (SELECT backend, seconds, error, unnest(CASE doc_id % 4 WHEN 0 THEN ['noise'] WHEN 1 THEN ['terms', 'noise'] WHEN 2 THEN ['unknown'] ELSE ['negation'] END) AS trap FROM runs) GROUP BY ALL""",
    "attempt_health": v.with_views("attempts") + "SELECT CAST(created_at AS DATE) AS day, count(*) AS n, round(avg(paste_success::INT), 4) AS success_rate, round(avg((status = 'no_speech')::INT), 4) AS blank_rate, round(quantile_cont(release_to_paste, 0.5), 4) AS p50, round(quantile_cont(release_to_paste, 0.95), 4) AS p95 FROM attempts GROUP BY 1",
    "status_counts": v.with_views("attempts") + "SELECT status, count(*) AS n, count(*) FILTER (WHERE release_to_paste IS NULL) AS without_time FROM attempts GROUP BY 1",
    "percentile_family": v.with_views("attempts")
    + """, a AS (SELECT status, list_sort(list(release_to_paste)) AS x, count(*) AS n, quantile_cont(release_to_paste, 0.95) AS q, CAST(least(greatest(floor(0.95 * (count(*) + 1) + 1e-9), 1), greatest(count(*) - 1, 1)) AS BIGINT) AS j FROM attempts WHERE release_to_paste IS NOT NULL GROUP BY 1)
SELECT status, round(q, 4) AS linear, round(CASE WHEN n = 1 THEN x[1] ELSE x[j] * (1 - (0.95 * (n + 1) - j)) + x[j + 1] * (0.95 * (n + 1) - j) END, 4) AS exclusive, round(x[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1], 4) AS half_even, round(x[CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1], 4) AS floor, round(x[CAST(floor(0.95 * (n - 1) + 0.5) AS BIGINT) + 1], 4) AS half_up FROM a""",
    "rolling_health_tumbling": v.with_views("attempts") + "SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS start, count(*) AS n, count(*) FILTER (WHERE paste_success) AS successes FROM attempts GROUP BY 1",
    "rolling_health_sliding": v.with_views("attempts") + "SELECT time_bucket(INTERVAL 10 MINUTE, created_at) - o * INTERVAL 10 MINUTE AS start, count(*) AS n, count(*) FILTER (WHERE paste_success) AS successes FROM attempts, range(0, 6) r(o) GROUP BY 1",
    "session_funnel": v.with_views("attempts")
    + """, g AS (SELECT *, CASE WHEN created_at < lag(created_at) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM attempts WINDOW w AS (PARTITION BY user_id ORDER BY created_at, ordinal)),
h AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY created_at, ordinal ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(created_at) AS start, count(*) AS n, count(*) FILTER (WHERE paste_success) AS successes FROM h GROUP BY user_id, s""",
    "best_event_per_audio": v.with_views("attempts")
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY audio_path ORDER BY CASE status WHEN 'finalizer_replaced' THEN 4 WHEN 'paste_attempted' THEN 3 WHEN 'copy_fallback' THEN 2 WHEN 'no_speech' THEN 1 ELSE 0 END DESC, created_at DESC, ordinal DESC) AS k, count(*) OVER (PARTITION BY audio_path) AS n FROM attempts)
SELECT audio_path, run_id, status, n FROM r WHERE k = 1""",
    "asof_feedback": """SELECT event_id, user_id, coalesce(attempt_id, -1) AS attempt_id FROM (SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type <> 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS attempt_id FROM events) WHERE event_type = 'purchase'""",
    "resume_pending": v.with_views("attempts") + "SELECT audio_path FROM attempts GROUP BY audio_path HAVING arg_max(status, ordinal) = 'failed'",
    "newest_attempts": v.with_views("attempts") + "SELECT run_id, status FROM attempts ORDER BY ordinal DESC LIMIT 300",
    "dedupe_by_trust": v.with_views("clips") + ", r AS (SELECT *, row_number() OVER (PARTITION BY gold, category ORDER BY CASE trust WHEN 'gold' THEN 2 WHEN 'silver' THEN 1 ELSE 0 END DESC, doc_id) AS k, count(*) OVER (PARTITION BY gold, category) AS copies FROM clips) SELECT id, category, trust, copies FROM r WHERE k = 1",
    "dup_suffix": v.with_views("clips") + "SELECT doc_id, 't_' || substring(md5(gold), 1, 8) || CASE WHEN k > 1 THEN '__dup' || k ELSE '' END AS text_id FROM (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY doc_id) AS k FROM clips)",
    "first_wins_text": v.with_views("clips") + "SELECT min(doc_id) AS doc_id FROM clips GROUP BY lower(gold)",
    "even_sample": v.with_views("clips")
    + """, r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM clips)
SELECT source, doc_id, place::INT AS place FROM r WHERE place IN (0, round_even((n - 1) / 4.0, 0), round_even((n - 1) / 4.0 * 2, 0), round_even((n - 1) / 4.0 * 3, 0), n - 1)""",
    "best_match_prompt": """WITH p AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower("text"), '[A-Za-z0-9+#.]+'), lambda w: length(w) > 3)) AS w FROM benchmark),
q AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower("text"), '[A-Za-z0-9+#.]+'), lambda w: length(w) > 3)) AS w FROM documents),
i AS (SELECT item_id, len(w) AS m, unnest(w) AS token FROM p), a AS (SELECT doc_id, len(w) AS n, unnest(w) AS token FROM q),
s AS (SELECT doc_id, item_id, round(count(*) / greatest(1, least(any_value(n), any_value(m)))::DOUBLE, 4) AS score FROM a JOIN i USING (token) GROUP BY 1, 2)
SELECT doc_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS k FROM s WHERE score > 0) WHERE k = 1""",
    "caption_window": v.with_views("captions") + """SELECT a.conv_id, a.turn, count(*) AS captions, sum(length(b."text"))::BIGINT AS chars FROM captions a JOIN captions b ON a.conv_id = b.conv_id AND b.start <= a.start + 12.0 AND b.stop >= a.start GROUP BY 1, 2""",
    "pipeline_tail": v.with_views("segments")
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM segments),
l AS (SELECT conv_id, k, (stop + compute)::DOUBLE AS done FROM o WHERE k = 1 UNION ALL SELECT o.conv_id, o.k, (greatest(l.done, o.stop) + o.compute)::DOUBLE FROM l JOIN o ON o.conv_id = l.conv_id AND o.k = l.k + 1)
SELECT o.conv_id, count(*) AS chunks, round(max(l.done), 4) AS done, round(greatest(0.0, max(l.done) - max(o.stop)), 4) AS tail FROM o JOIN l ON o.conv_id = l.conv_id AND o.k = l.k GROUP BY o.conv_id""",
    "stable_prefix": v.with_views("clips", "drafts")
    + """, p AS (SELECT *, lag(words) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM drafts),
c AS (SELECT doc_id, k, CASE WHEN before IS NULL THEN 0 ELSE coalesce(list_position(list_transform(range(1, least(len(before), len(words)) + 1), lambda i: lower(before[i]) = lower(words[i])), false) - 1, least(len(before), len(words))) END::INT AS stable_words FROM p)
SELECT doc_id, k, stable_words, stable_words >= 3 AS stable FROM c""",
    "silence_windows": """WITH f AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
w AS (SELECT vec_id, pos // 8 AS w, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak FROM f GROUP BY 1, 2)
SELECT vec_id, round(max(peak), 4) AS peak, round(max(rms), 4) AS max_rms, round(avg((rms < 0.1)::INT), 4) AS silent_ratio FROM w GROUP BY 1""",
    "language_mix": """SELECT lang, CASE WHEN h AND l THEN 'chinese_english' WHEN h THEN 'chinese' WHEN l THEN 'english' ELSE 'other' END AS mix, count(*) AS n
FROM (SELECT lang, regexp_matches("text", '[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]') AS h, regexp_matches("text", '[A-Za-z]{2,}') AS l FROM documents) GROUP BY 1, 2""",
    "mine_terms": """SELECT term, count(*) AS texts FROM (SELECT unnest(list_distinct(list_filter(regexp_extract_all("text", '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z]{2,6}|[A-Z][a-z]{3,}([A-Z][a-z]+)*')))) AS term FROM documents) GROUP BY 1 HAVING count(*) >= 2""",
    "vocabulary": """SELECT token, count(*) AS texts FROM (SELECT unnest(list_distinct(list_filter(regexp_extract_all(lower("text"), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 5))) AS token FROM documents) GROUP BY 1 HAVING count(*) >= 5""",
    "correction_context": """WITH t AS (SELECT conv_id, turn, "text", lag(list_slice(regexp_extract_all("text", '[\\p{L}\\p{N}_]+'), 1, 2)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
c AS (SELECT *, coalesce(turn % 3 = 2 AND len(p) = 2, false) AS corrects FROM t),
a AS (SELECT *, last_value(CASE WHEN NOT corrects THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS about FROM c)
SELECT conv_id, turn, p[2] AS "right", p[1] AS wrong, about FROM a WHERE corrects AND lower(p[1]) <> lower(p[2])""",
    "weighted_rank": """WITH r AS (SELECT p_brand AS tool, p_type AS axis, avg(p_size / 10.0) AS rating FROM part GROUP BY 1, 2),
w AS (SELECT tool, rating, 'dictation' AS use, length(axis) % 5 + 1 AS weight FROM r UNION ALL SELECT tool, rating, 'meetings', length(axis) % 3 FROM r WHERE length(axis) % 3 > 0),
t AS (SELECT use, tool, round(sum(rating * weight) / sum(weight), 4) AS score FROM w GROUP BY 1, 2)
SELECT use, tool, score, row_number() OVER (PARTITION BY use ORDER BY score DESC, lower(tool), tool)::INT AS rank FROM t""",
}
