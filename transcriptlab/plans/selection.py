"""Registered queries that clean, choose, score and check texts, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import texts as X
from ..operators import scoring, selection
from ..sources import views as v
from . import sqltext as T
from .history import _SCORED
from .review import SQL as REVIEW_SQL
from .review import _plain

STARTS = (0.0, 6.0, 12.0, 18.0, 24.0)
PLACES = {"accurate": 0, "tiny": 1, "fast": 2}


def _scored(s, d):
    return scoring.score_runs(v.runs(s, d))


def _shouted(words, m):
    # some words in capitals, so that texts hold protected terms
    return F.array_join(F.transform(words, lambda w, i: F.when(((F.col("doc_id") + i + 1) % m == 0) & w.rlike("^[A-Za-z]+$"), F.upper(w)).otherwise(w)), " ")


def _updates(s, d):
    rows = v.runs(s, d).filter("backend <> 'tiny'").withColumn("text", F.when(F.col("backend") == "fast", _shouted(F.col("hyp"), 9)).otherwise(_shouted(F.col("hyp"), 13)))
    text = lambda b: F.max(F.when(F.col("backend") == b, F.col("text")))
    pairs = rows.groupBy("doc_id").agg(text("fast").alias("draft"), text("accurate").alias("final"), F.max("seconds").alias("tail"))
    return pairs.select("doc_id", F.array_join(X.update_reasons(F.col("draft"), F.col("final"), F.col("tail"), 8.0), ";").alias("reasons"))


def _pools(s, d):
    kinds = F.array(*map(F.lit, ("hinglish", "hindi", "fleurs_cmn", "Chinese English", "youtube", "talk")))
    kind = F.get(kinds, (F.col("doc_id") % 6).cast("int"))
    return v.clips(s, d).select(X.pool_bucket(kind, F.col("category"), F.col("source")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def _qualities(s, d):
    rows = v.runs(s, d)
    ref, hyp = C.tokens(F.col("gold")), C.tokens(F.col("actual"))
    rows = rows.select("doc_id", "backend", "actual", "seconds", ref.alias("r"), hyp.alias("h"))
    return rows.select("doc_id", "backend", F.round(X.top_token_share(F.col("h")), 4).alias("top_share"), X.runaway(F.col("h")).alias("runaway"), X.overlap(F.col("r"), F.col("h")).alias("overlap"), X.overlap(F.col("r"), F.col("h"), "min").alias("coefficient"), F.round(X.retention(F.col("r"), F.col("h")), 4).alias("retention"), F.array_join(X.odd_words(F.col("r"), F.col("h")), ",").alias("odd"), X.cut_short(F.col("actual"), F.col("seconds") * 10).alias("cut_short"))


def _spoken(s, d):
    tail = F.when(F.col("turn") % 3 == 0, " [MUSIC] They can't and DON'T").when(F.col("turn") % 3 == 1, " twenty one or thirty, cannot").otherwise(" <v A>is  not</v>")
    return v.table(s, d, "conversations").select("conv_id", "turn", X.spoken_form(X.plain_spacing(F.concat("text", tail))).alias("said"))


#: What recognisers write for silence, and blanks.
MARKS = ("[BLANK_AUDIO]", " (No  speech) ", " \n", "<|nospeech|>", "  no speech ", "")


def _blank(s, d):
    """Turns of conversations, some with what recognisers write for silence instead of or beside their text."""
    marks = F.array(*map(F.lit, MARKS))
    n = F.col("conv_id") + F.col("turn") * 3
    mark = F.get(marks, (n % 9).cast("int"))
    said = F.when(n % 9 >= len(MARKS), F.col("text")).when(n % 2 == 0, mark).otherwise(F.concat(mark, F.col("text")))
    return v.table(s, d, "conversations").select("conv_id", "turn", X.no_speech(said).alias("blank"))


def _candidates(s, d):
    place = F.create_map(*[F.lit(x) for kv in PLACES.items() for x in kv])[F.col("backend")]
    text = F.when(F.col("doc_id") % 5 == 0, F.lit("")).when((F.col("doc_id") % 7 == 0) & (F.col("backend") == "accurate"), F.lit("so so so")).otherwise(F.col("actual"))
    return v.runs(s, d).select("doc_id", F.col("doc_id").alias("id"), F.col("backend").alias("name"), place.alias("place"), text.alias("text"), "error")


def _two_phase(policy):
    def query(s, d):
        rows = _scored(s, d)
        return selection.two_phase(rows.filter("backend = 'fast'"), rows.filter("backend <> 'fast'"), policy)

    return query


def _results(s, d):
    """What tools gave back for clips, with facts and terms of the reference."""
    facts = F.filter(F.array(F.slice("toks", F.lit(1), F.lit(10)), F.slice("toks", F.lit(11), F.lit(10))), lambda f: F.size(f) > 0)
    terms = F.array_distinct(F.filter("toks", lambda w, i: i % 20 == 4))
    traps = F.element_at(F.array(F.array(F.lit("noise")), F.array(F.lit("terms"), F.lit("noise")), F.array().cast("array<string>"), F.array(F.lit("negation"))), (F.col("doc_id") % 4 + 1).cast("int"))
    human = F.when(F.col("doc_id") % 3 == 0, True).when(F.col("doc_id") % 3 == 1, False)
    return v.runs(s, d).select("doc_id", F.col("backend").alias("tool"), "actual", "seconds", "error", facts.alias("facts"), terms.alias("terms"), traps.alias("failure_traps"), human.alias("human_pasteable"))


def _violations(s, d):
    at = {"hotkey_down": F.lit(0.0), "playback_start": F.when(F.col("doc_id") % 7 != 0, 0.5), "speech_end": F.lit(5.0), "hotkey_up": F.when(F.col("doc_id") % 53 == 0, 4.0).otherwise(5.5), "final_visible": 5.5 + F.col("seconds"), "paste_done": 5.6 + F.col("seconds")}
    times = F.struct(*[c.alias(n) for n, c in at.items()])
    # a failed run gives no result, a slow one a second one; clips that need review aren't in the corpus
    runs = v.runs(s, d).filter("error IS NULL").select(F.col("backend").alias("tool"), F.col("id").alias("corpus_id"), times.alias("timestamps"), F.when(F.col("seconds") > 8, 2).otherwise(1).alias("times"))
    results = runs.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("times")))).select("tool", "corpus_id", "timestamps")
    return selection.result_violations(results, v.clips(s, d).filter("trust <> 'needs_human_review'"), list(PLACES))


def _confusion(s, d):
    docs = v.table(s, d, "documents").join(v.table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return selection.confusion(docs, F.col("quality") == 1, F.col("n_chars") >= 400, "lang")


def _retention(s, d):
    return selection.retention_of_audio(v.attempts(s, d).withColumn("audio_retained", F.col("ordinal") % 3 != 0))


def _fields(s, d):
    return selection.field_scorecard(v.wide_runs(s, d), list(PLACES))


def _stitched(s, d):
    """Chunks that begin with some of the words that end the chunk before."""
    words = X.split_words(F.col("text"))
    before = F.lag(words).over(Window.partitionBy("conv_id").orderBy("turn"))
    n = F.least(((F.col("conv_id") + F.col("turn")) % 4).cast("int"), F.size(before))
    seam = F.when(F.size(before) > 0, F.slice(before, F.size(before) - n + 1, n)).otherwise(F.array().cast("array<string>"))
    return selection.stitch(v.table(s, d, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("place"), F.array_join(F.concat(seam, words), " ").alias("text")))


def _labelled(s, d):
    rows = v.table(s, d, "conversations").groupBy("conv_id", "role").agg(F.min_by("text", "turn").alias("text"))
    return selection.labelled(rows.select(F.col("conv_id").alias("run"), F.col("role").alias("place"), F.col("role").alias("label"), "text"))


def _claims(s, d):
    parts = v.table(s, d, "part")
    values = parts.groupBy(F.col("p_brand").alias("selector")).agg(F.avg("p_size").alias("value"))
    evidence = values.select("selector", F.lit("size").alias("metric"), "value")
    evidence = evidence.unionByName(evidence.filter(F.col("selector").endswith("3")))  # reported twice
    brands = parts.select(F.col("p_brand").alias("selector")).distinct()
    claims = brands.join(values, "selector").select(F.col("selector").alias("claim_id"), F.lit("size").alias("metric"), "selector", (F.round("value", 1)).alias("expected"))
    other = claims.withColumn("claim_id", F.concat(F.lit("x"), "claim_id")).withColumn("metric", F.lit("price"))
    return selection.audit_claims(claims.unionByName(other), evidence)


QUERIES = {
    "update_reasons": _updates,
    "pool_buckets": _pools,
    "script_classes": lambda s, d: v.table(s, d, "documents").groupBy("lang", X.script_class(F.col("text")).alias("script")).agg(F.count("*").alias("n")),
    "text_quality": _qualities,
    "degenerate_runs": lambda s, d: v.runs(s, d).select("doc_id", "backend", X.repeated_substring_score(F.repeat("actual", F.lit(3))).alias("repeat"), X.degenerate(F.col("actual")).alias("degenerate")),
    "spoken_form": _spoken,
    "blank_texts": _blank,
    "first_usable": lambda s, d: selection.first_usable(_candidates(s, d)),
    "two_phase_any": _two_phase("oracle-any"),
    "two_phase_quick": _two_phase("oracle-under-limit"),
    "two_phase_failed": _two_phase("empty-only"),
    "app_scores": lambda s, d: selection.app_scores(_results(s, d)).select("doc_id", "tool", "fact_coverage", "app_score", "critical", "usable"),
    "tool_summary": lambda s, d: selection.tool_summary(selection.app_scores(_results(s, d))),
    "result_violations": _violations,
    "routing_confusion": _confusion,
    "audio_retention": _retention,
    "throttled": lambda s, d: selection.throttled(v.attempts(s, d), 3600).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("throttled").alias("throttled")),
    "prune_list": lambda s, d: selection.to_prune(v.attempts(s, d), 5).select("user_id", "run_id"),
    "chunk_grid": lambda s, d: selection.chunk_grid(v.clips(s, d)),
    "field_scorecard": _fields,
    "prefix_quality": lambda s, d: selection.prefix_quality(v.drafts(s, d), v.clips(s, d)),
    "stitched": _stitched,
    "labelled_sources": _labelled,
    "claims_audit": _claims,
    "best_or_unclear": lambda s, d: selection.best_or_unclear(_scored(s, d).select("id", F.col("backend").alias("name"), F.col("useful_score").alias("score"), "repeat"), 0.7),
    "review_candidates": lambda s, d: selection.review_candidates(v.attempts(s, d), 0.5, 500),
    "caption_choice": lambda s, d: selection.caption_choice(v.captions(s, d), STARTS, 12.0, 60),
}

_WORD = r"[^\x20\x09-\x0D]+"
_PLACE = "CASE backend WHEN 'accurate' THEN 0 WHEN 'tiny' THEN 1 ELSE 2 END"
_LISTS = "list_transform(toks, lambda x: lower(x)) AS r, list_transform(hyp, lambda x: lower(x)) AS h"
_CODED = "array_to_string(list_transform({}, lambda x: chr(CAST(32 + list_position(k, x) AS INTEGER))), '')"
_DISTANCE = f"levenshtein({_CODED.format('r')}, {_CODED.format('h')})"


def _wer(k: str = "list_distinct(list_concat(r, h))") -> str:
    return f"CASE WHEN len(r) = 0 THEN CASE WHEN len(h) = 0 THEN 0.0 ELSE 1.0 END ELSE round({_DISTANCE.replace('list_position(k,', f'list_position({k},')}::DOUBLE / len(r), 3) END"


def _terms(words: str) -> str:
    """Protected terms of a list of words."""
    kept = f"list_filter({words}, lambda w: regexp_full_match(w, '[A-Za-z][A-Za-z0-9]+'))"
    return f"""list_sort(list_distinct(list_filter(list_transform({kept}, lambda w: CASE WHEN regexp_full_match(w, '[A-Z0-9]{{2,}}s') THEN lower(left(w, -1)) WHEN regexp_full_match(w, '[A-Z0-9]+') THEN lower(w)
    WHEN regexp_matches(w, '^[A-Z].*[A-Z]') AND regexp_matches(w, '[a-z]') AND length(w) >= 4 THEN lower(w) END), lambda w: w IS NOT NULL)))"""


def _thrice(h: str) -> str:
    return " OR ".join(f"len(list_filter(range(1, greatest(1, len({h}) - {3 * z} + 2)), lambda i: {h}[i:i + {z - 1}] = {h}[i + {z}:i + {2 * z - 1}] AND {h}[i + {z}:i + {2 * z - 1}] = {h}[i + {2 * z}:i + {3 * z - 1}])) > 0" for z in (1, 2, 3, 4))


def _less(a: str, *others: str) -> str:
    return f"list_filter({a}, lambda w: " + " AND ".join(f"NOT list_contains({o}, w)" for o in others) + ")"


def _said() -> str:
    text = "regexp_replace(regexp_replace(x, '\\[MUSIC\\]', ' ', 'g'), '<v[^>]*>|</v>', '', 'g')"
    text = f"lower({text})"
    for verb, full in X.NEGATED.items():
        text = f"regexp_replace({text}, '\\b{verb} *n *[''’]? *t\\b', '{full} not', 'g')"
    text = f"regexp_replace({text}, '\\bcannot\\b', 'can not', 'g')"
    for word, digits in X.NUMBERS.items():
        text = f"replace({text}, '{word}', '{digits}')"
    return _plain(f"regexp_replace({text}, '[+#]', ' ', 'g')")


def _two_phase_sql(allowed: str) -> str:
    return _SCORED + f""", f AS (SELECT s.id, s.useful_score AS a, s.seconds::DOUBLE AS t, s.error IS NOT NULL OR trim(r.actual) = '' AS failed FROM scored s JOIN runs r ON s.id = r.id AND r.backend = 'fast' AND s.backend = 'fast'),
m AS (SELECT f.*, c.backend, c.useful_score AS b, c.seconds::DOUBLE AS u, row_number() OVER (PARTITION BY f.id ORDER BY CASE WHEN {allowed} THEN 0 ELSE 1 END, c.useful_score DESC, c.seconds, c.backend) AS k, coalesce({allowed}, false) AS ok FROM f JOIN scored c ON f.id = c.id AND c.backend <> 'fast')
SELECT id, a AS first_score, CASE WHEN ok THEN b ELSE a END AS score, CASE WHEN ok THEN u ELSE t END AS seconds, CASE WHEN ok THEN backend ELSE 'none' END AS polished_by FROM m WHERE k = 1"""


def _app_sql() -> str:
    covered = REVIEW_SQL["term_coverage"].replace("i % 7 = 5", "i % 20 = 5")
    concept = lambda x: T.concepts(f"list_transform({x}, lambda w: lower(w))")
    share = lambda x: f"CASE WHEN len({x}) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect({x}, ch))::DOUBLE / len({x}), 3) END"
    return v.with_views("clips", "runs") + f""", c AS ({covered}),
t AS (SELECT r.*, c.hits, c.misses, c.term_coverage IS NOT NULL AS termed, {concept('r.toks[1:10]')} AS f1, {concept('r.toks[11:20]')} AS f2, {concept('r.hyp')} AS ch,
  len(list_distinct(list_filter(r.toks, lambda w, i: i % 20 = 5))) AS n FROM runs r JOIN c USING (doc_id, backend)),
u AS (SELECT *, CASE WHEN len(toks) = 0 THEN 1.0::DOUBLE WHEN len(toks) <= 10 THEN {share('f1')} ELSE ({share('f1')} + {share('f2')}) / 2 END AS fc, CASE WHEN misses = '' THEN 0 ELSE len(string_split(misses, ',')) END AS m FROM t),
w AS (SELECT *, 0.40::DOUBLE * fc + 0.20::DOUBLE * CASE WHEN n > 0 THEN (n - m)::DOUBLE / n ELSE fc END + 0.15::DOUBLE * CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.5 END
  + 0.15::DOUBLE * CASE WHEN seconds <= 1 THEN 1.0 WHEN seconds <= 2 THEN 0.85 WHEN seconds <= 4 THEN 0.65 WHEN seconds <= 8 THEN 0.35 ELSE 0.0 END + 0.10::DOUBLE * (error IS NULL)::INT AS raw FROM u),
z AS (SELECT *, CASE WHEN m > 0 THEN least(raw, 0.5) ELSE raw END AS s FROM w),
app AS (SELECT doc_id, backend AS tool, seconds, error, round(fc, 3) AS fact_coverage, round(s, 3) AS app_score, m > 0 AS critical, s >= 0.75 AND error IS NULL AND m = 0 AS usable FROM z)
"""


_APP = _app_sql()

SQL = {
    "update_reasons": v.with_views("clips", "runs")
    + f""", p AS (SELECT doc_id, max(seconds) AS tail, list_transform(any_value(hyp) FILTER (WHERE backend = 'fast'), lambda x, i: CASE WHEN (doc_id + i) % 9 = 0 AND regexp_full_match(x, '[A-Za-z]+') THEN upper(x) ELSE x END) AS d,
  list_transform(any_value(hyp) FILTER (WHERE backend = 'accurate'), lambda x, i: CASE WHEN (doc_id + i) % 13 = 0 AND regexp_full_match(x, '[A-Za-z]+') THEN upper(x) ELSE x END) AS f FROM runs GROUP BY doc_id),
p2 AS (SELECT doc_id, max(seconds) AS tail FROM runs WHERE backend <> 'tiny' GROUP BY doc_id),
q AS (SELECT p.doc_id, p2.tail, d, f, list_transform(d, lambda x: lower(x)) AS dl, list_transform(f, lambda x: lower(x)) AS h, {_terms('d')} AS dt, {_terms('f')} AS ft FROM p JOIN p2 USING (doc_id)),
r AS (SELECT doc_id, CASE WHEN len(f) = 0 THEN 'empty-final' END AS a, CASE WHEN tail > 8 THEN 'tail>threshold' END AS b, CASE WHEN {_thrice('h')} THEN 'repetition' END AS c,
  {_less('dt', 'h', 'ft')} AS m, CASE WHEN len(dt) > 0 THEN {_less('ft', 'dl', 'dt')} ELSE [] END AS n FROM q)
SELECT doc_id, concat_ws(';', a, b, c, CASE WHEN len(m) > 0 THEN 'protected-term-missing:' || array_to_string(m[1:5], ',') END, CASE WHEN len(n) > 0 THEN 'protected-term-new:' || array_to_string(n[1:5], ',') END) AS reasons FROM r""",
    "pool_buckets": v.with_views("clips")
    + """, k AS (SELECT lower(['hinglish', 'hindi', 'fleurs_cmn', 'Chinese English', 'youtube', 'talk'][doc_id % 6 + 1]) AS c, lower(category) AS l, lower(source) AS r FROM clips)
SELECT CASE WHEN (regexp_matches(l, 'zh|cmn|mandarin|chinese') OR regexp_matches(c, 'fleurs_cmn|chinese')) THEN CASE WHEN contains(c, 'english') OR contains(l, 'en') THEN 'chinese_english_code_switch' ELSE 'chinese_public' END
  WHEN contains(c, 'hinglish') OR contains(l, 'hi-en') OR (contains(c, 'hindi') AND contains(c, 'english')) THEN 'hinglish_code_switch' WHEN contains(c, 'hindi') OR l IN ('hi', 'hi_in', 'hindi') THEN 'hindi_public'
  WHEN contains(c, 'youtube') AND r <> '' THEN 'english_youtube_' || replace(r, ' ', '_') ELSE 'english_public' END AS bucket, count(*) AS n FROM k GROUP BY 1""",
    "script_classes": """SELECT lang, CASE WHEN i AND l THEN 'mixed' WHEN i THEN 'devanagari' WHEN l THEN 'latin' ELSE 'other' END AS script, count(*) AS n FROM (SELECT lang, regexp_matches("text", '[\\x{0900}-\\x{097F}]') AS i, regexp_matches("text", '[A-Za-z]') AS l FROM documents) GROUP BY 1, 2""",
    "text_quality": v.with_views("clips", "runs")
    + f""", t AS (SELECT doc_id, backend, actual, seconds * 10 AS s, {_LISTS} FROM runs), u AS (SELECT *, length(actual) AS c, len(h) AS w, len(list_distinct(r)) AS a, len(list_distinct(h)) AS b, len(list_intersect(r, h)) AS x, list_filter(r, lambda w: length(w) >= 4) AS l FROM t)
SELECT doc_id, backend, CASE WHEN len(h) = 0 THEN 0.0 ELSE round(list_max(list_transform(list_distinct(h), lambda y: len(list_filter(h, lambda z: z = y))))::DOUBLE / len(h), 4) END AS top_share, {_thrice('h')} AS runaway,
  CASE WHEN a > 0 AND b > 0 THEN round(x::DOUBLE / greatest(a, b), 3) END AS overlap, CASE WHEN a > 0 AND b > 0 THEN round(x::DOUBLE / least(a, b), 3) END AS coefficient,
  CASE WHEN len(l) = 0 THEN 1.0 ELSE round(len(list_filter(l, lambda y: list_contains(h, y)))::DOUBLE / len(l), 4) END AS retention,
  array_to_string(list_filter(r, lambda y: length(y) >= 5 AND NOT list_contains(h, y) AND (length(regexp_replace(y, '[^aeiou]', '', 'g'))::DOUBLE / length(y) < 0.20 OR length(regexp_replace(y, '[^aeiou]', '', 'g'))::DOUBLE / length(y) > 0.76)), ',') AS odd,
  c > 0 AND s >= 18 AND (c < greatest(120, floor(s * 4)) OR w < greatest(20, floor(s * 0.45)) OR (c < floor(s * 8) AND w < 55)) AS cut_short FROM u""",
    "spoken_form": f"""SELECT conv_id, turn, {_said()} AS said FROM (SELECT conv_id, turn, "text" || CASE turn % 3 WHEN 0 THEN ' [MUSIC] They can''t and DON''T' WHEN 1 THEN ' twenty one or thirty, cannot' ELSE ' <v A>is  not</v>' END AS x FROM conversations)""",
    "blank_texts": r"""WITH t AS (SELECT conv_id, turn, (conv_id + turn * 3) AS n, "text",
  ['[BLANK_AUDIO]', ' (No  speech) ', ' ' || chr(10), '<|nospeech|>', '  no speech ', ''][(conv_id + turn * 3) % 9 + 1] AS mark FROM conversations),
u AS (SELECT conv_id, turn, lower(trim(CASE WHEN n % 9 >= 6 THEN "text" WHEN n % 2 = 0 THEN mark ELSE mark || "text" END, ' ' || chr(9) || chr(10) || chr(13))) AS x FROM t)
SELECT conv_id, turn, x = '' OR x = '<|nospeech|>' OR trim(regexp_replace(regexp_replace(x, '^[\[\](){}<>._\- ]+|[\[\](){}<>._\- ]+$', '', 'g'), '[_ ]+', ' ', 'g')) IN
  ('blank', 'blank audio', 'silence', 'silent audio', 'no speech', 'no speech detected', 'inaudible', 'music', 'noise') AS blank FROM u""",
    "first_usable": v.with_views("clips", "runs")
    + f""", c AS (SELECT doc_id AS id, backend AS name, {_PLACE} AS place, error, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 AND backend = 'accurate' THEN 'so so so' ELSE actual END AS text, {_LISTS} FROM runs),
e AS (SELECT *, error IS NULL AND text <> '' AND text <> 'so so so' AND NOT ({_thrice('h')}) AS good FROM c),
g AS (SELECT id, bool_or(good) AS any_good, arg_min(name, place) FILTER (WHERE good) AS gn, arg_min(text, place) FILTER (WHERE good) AS gt, arg_min(name, place) FILTER (WHERE text <> '') AS an, arg_min(text, place) FILTER (WHERE text <> '') AS fallback FROM e GROUP BY id)
SELECT id, coalesce(gn, an, 'none') AS name, coalesce(gt, fallback, '') AS text, NOT any_good AS fell_back FROM g""",
    "two_phase_any": _two_phase_sql("c.useful_score > f.a"),
    "two_phase_quick": _two_phase_sql("c.useful_score > f.a AND c.seconds <= 2.5"),
    "two_phase_failed": _two_phase_sql("f.failed"),
    "app_scores": _APP + "SELECT doc_id, tool, fact_coverage, app_score, critical, usable FROM app",
    "tool_summary": _APP
    + """, y AS (SELECT tool, avg(app_score) AS m FROM (SELECT tool, app_score, unnest(CASE doc_id % 4 WHEN 0 THEN ['noise'] WHEN 1 THEN ['terms', 'noise'] WHEN 2 THEN ['unknown'] ELSE ['negation'] END) AS trap FROM app) GROUP BY tool, trap)
SELECT tool, count(*) AS clips, round(avg(app_score) + 1e-9, 3) AS avg_score, round(avg(usable::INT), 4) AS usable_rate, round(avg(critical::INT), 4) AS critical_rate, round(avg((error IS NOT NULL)::INT), 4) AS error_rate, round(quantile_cont(seconds::DOUBLE, 0.5), 4) AS p50_seconds,
  (SELECT round(min(m) + 1e-9, 3) FROM y WHERE y.tool = app.tool) AS worst_trap FROM app GROUP BY tool""",
    "result_violations": v.with_views("clips", "runs")
    + """, r AS (SELECT doc_id, backend AS tool, id AS corpus_id, unnest(range(CASE WHEN seconds > 8 THEN 2 ELSE 1 END)) AS n,
  doc_id % 53 = 0 AS late FROM runs WHERE error IS NULL), k AS (SELECT id FROM clips WHERE trust <> 'needs_human_review')
SELECT 'steps_out_of_order' AS rule, tool, corpus_id FROM r WHERE late UNION ALL SELECT 'unknown_clip', tool, corpus_id FROM r WHERE corpus_id NOT IN (SELECT id FROM k)
UNION ALL SELECT 'given_twice', tool, corpus_id FROM r GROUP BY tool, corpus_id HAVING count(*) > 1 UNION ALL SELECT 'no_result', tool, id FROM (SELECT tool, id FROM k, (SELECT DISTINCT tool FROM r)) k ANTI JOIN r ON k.tool = r.tool AND k.id = r.corpus_id""",
    "routing_confusion": "SELECT lang, count(*) FILTER (WHERE quality = 1 AND n_chars >= 400) AS tp, count(*) FILTER (WHERE quality = 1 AND n_chars < 400) AS fn, count(*) FILTER (WHERE quality <> 1 AND n_chars >= 400) AS fp, count(*) FILTER (WHERE quality <> 1 AND n_chars < 400) AS tn FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY lang",
    "audio_retention": "SELECT CAST(ts AS DATE) AS day, count(*) AS successes, count(*) FILTER (WHERE event_id % 3 <> 0) AS retained, count(*) FILTER (WHERE event_id % 3 = 0) AS missing FROM events WHERE event_type IN ('view', 'click') GROUP BY 1",
    "throttled": "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE ts - b < INTERVAL 1 HOUR) AS throttled FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY 1",
    "prune_list": "SELECT user_id, 'r' || event_id AS run_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, 'r' || event_id DESC) AS k FROM events) WHERE k > 5",
    "chunk_grid": v.with_views("clips") + """SELECT id, chunk, round(chunk * 5.0::DOUBLE, 3) AS start, round(least(chunk * 5.0::DOUBLE + 6, s), 3) AS stop FROM (SELECT id, audio_seconds::DOUBLE AS s, unnest(range(CAST(ceil(audio_seconds::DOUBLE / 5) AS BIGINT))) AS chunk FROM clips WHERE audio_seconds > 0)
WHERE chunk = 0 OR least(chunk * 5.0::DOUBLE + 6, s) - chunk * 5.0::DOUBLE >= 1""",
    "field_scorecard": v.with_views("clips", "runs")
    + f""", t AS (SELECT backend AS field, list_transform(toks, lambda x: lower(x)) AS r, CASE WHEN error IS NULL THEN list_transform(hyp, lambda x: lower(x)) ELSE [] END AS h FROM runs), u AS (SELECT *, {_wer('k')} AS wer FROM (SELECT *, list_distinct(list_concat(r, h)) AS k FROM t))
SELECT field, count(*) AS n, count(*) FILTER (WHERE len(h) = 0) AS blank, count(*) FILTER (WHERE wer = 0) AS perfect, count(*) FILTER (WHERE wer > 0.5) AS poor, count(*) FILTER (WHERE len(list_filter(range(1, len(h)), lambda i: h[i] = h[i + 1])) * 1000.0 / greatest(len(h), 1) >= 0.5) AS repeated FROM u GROUP BY 1""",
    "prefix_quality": v.with_views("clips", "drafts")
    + f""", t AS (SELECT t_ms, list_transform(c.toks[1:len(d.words)], lambda x: lower(x)) AS r, list_transform(d.words, lambda x: lower(x)) AS h FROM drafts d JOIN clips c USING (doc_id))
SELECT t_ms, count(*) AS n, round(avg({_wer('k')}) + 1e-9, 4) AS wer FROM (SELECT *, list_distinct(list_concat(r, h)) AS k FROM t) GROUP BY 1""",
    "stitched": f"""WITH RECURSIVE w AS (SELECT conv_id, turn, regexp_extract_all("text", '{_WORD}') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
b AS (SELECT a.conv_id, a.k, CASE WHEN len(p.x) > 0 THEN list_concat(list_slice(p.x, len(p.x) - CAST(least((a.conv_id + a.turn) % 4, len(p.x)) AS BIGINT) + 1, len(p.x)), a.x) ELSE a.x END AS x FROM w a LEFT JOIN w p ON a.conv_id = p.conv_id AND a.k = p.k + 1),
l AS (SELECT conv_id, k, x AS said FROM b WHERE k = 1 UNION ALL SELECT b.conv_id, b.k, list_concat(l.said, list_slice(b.x, CAST(coalesce(list_max(list_filter(range(1, least(12, len(l.said), len(b.x)) + 1),
  lambda w: list_transform(list_slice(l.said, len(l.said) - w + 1, len(l.said)), lambda y: lower(y)) = list_transform(list_slice(b.x, 1, w), lambda y: lower(y)))), 0) AS BIGINT) + 1, len(b.x))) FROM l JOIN b ON b.conv_id = l.conv_id AND b.k = l.k + 1)
SELECT conv_id AS run, max(k)::INT AS chunks, array_to_string(arg_max(said, k), ' ') AS text FROM l GROUP BY 1""",
    "labelled_sources": """SELECT conv_id AS run, string_agg('[' || role || ']' || chr(10) || x, chr(10) || chr(10) ORDER BY role) AS text FROM (SELECT conv_id, role, regexp_replace(arg_min("text", turn), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS x FROM conversations GROUP BY 1, 2) WHERE x <> '' GROUP BY 1""",
    "claims_audit": """WITH v AS (SELECT p_brand AS b, avg(p_size) AS a FROM part GROUP BY 1)
SELECT b AS claim_id, 'size' AS metric, CASE WHEN b LIKE '%3' THEN 'ambiguous' WHEN abs(a - round(a, 1)) <= 0.0005 THEN 'ok' ELSE 'off' END AS verdict FROM v UNION ALL SELECT 'x' || b, 'price', 'missing' FROM v""",
    "best_or_unclear": _SCORED
    + """SELECT id, CASE WHEN useful_score < 0.7 OR repeat >= 0.3 THEN 'unclear' ELSE backend END AS name, useful_score AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY useful_score DESC, backend DESC) AS k FROM scored) WHERE k = 1""",
    "review_candidates": v.with_views("attempts")
    + "SELECT audio_path, run_id FROM (SELECT audio_path, arg_max(run_id, ordinal) AS run_id, max(ordinal) AS o FROM attempts WHERE paste_success AND release_to_paste >= 0.5 GROUP BY 1) ORDER BY o DESC LIMIT 500",
    "caption_choice": v.with_views("captions")
    + f""", w AS (SELECT conv_id, s.a AS began, sum(len(regexp_extract_all("text", '{_WORD}')))::BIGINT AS words FROM captions, (VALUES {', '.join(f'({x})' for x in STARTS)}) s(a) WHERE stop >= s.a AND start <= s.a + 12 GROUP BY 1, 2)
SELECT conv_id, began::DOUBLE AS start, words FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY words < 60, CASE WHEN words >= 60 THEN began END, words DESC, began) AS k FROM w) WHERE k = 1""",
}
