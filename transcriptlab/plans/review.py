"""Registered review queries over the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consensus, corpus, review
from ..sources import views as v
from . import sqltext as T

BUCKETS = (("failed", "error IS NOT NULL", 10), ("slow", "seconds >= 6", 6), ("short", "size(hyp) < 20", 12))
TOTAL = 40


def _terms(s, d):
    # every seventh token of the reference is a term to be heard
    terms = F.array_distinct(F.filter("toks", lambda w, i: i % 7 == 4))
    rows = review.term_coverage(v.runs(s, d).withColumn("terms", terms))
    return rows.select("doc_id", "backend", F.array_join("term_hits", ",").alias("hits"), F.array_join("term_misses", ",").alias("misses"), "term_coverage")


def _quota(s, d):
    rows = v.runs(s, d).filter("backend = 'fast'")
    return review.quota_sample(rows, [(n, F.expr(c), q) for n, c, q in BUCKETS], TOTAL).select("doc_id", "review_bucket")


def _ordered(s, d):
    return review.ordered_checks(v.runs(s, d).withColumn("first", F.get("toks", F.lit(0))).withColumn("second", F.get("toks", F.lit(2))))


def _merged(s, d):
    docs = v.table(s, d, "documents")
    known = corpus.mine_terms(docs.filter("doc_id % 2 = 0")).groupBy(F.lower("term").alias("k")).agg(F.max("term").alias("canonical"), F.sum("texts").alias("count"))
    known = known.select("canonical", F.array(F.upper("canonical")).alias("aliases"), "count", F.when(F.col("count") >= 20, "approved").otherwise("candidate").alias("status"), F.create_map(F.lit("import"), "count").alias("source_counts"))
    out = review.merge_terms(known, corpus.mine_terms(docs.filter("doc_id % 2 = 1")), "history", "observed")
    return out.select("canonical", "status", "count", F.array_join("aliases", ",").alias("aliases"), F.coalesce(F.col("source_counts")["history"], F.lit(0)).alias("from_history"))


#: Systems in their order, with the weight of each one's voice.
WEIGHTS = {"accurate": 1.4, "tiny": 1.1, "fast": 0.7}


def _candidates(s, d):
    return v.runs(s, d).select("id", F.col("backend").alias("name"), F.col("actual").alias("text"), "error")


def _crosscheck(s, d):
    return consensus.crosscheck(v.clips(s, d), _candidates(s, d).filter("name <> 'fast'"))


QUERIES = {
    "draft_gold": lambda s, d: consensus.draft_gold(_candidates(s, d), WEIGHTS, ("accurate",)),
    "crosscheck": _crosscheck,
    "term_coverage": _terms,
    "ordered_checks": _ordered,
    "quota_sample": _quota,
    "action_items": lambda s, d: review.action_items(v.table(s, d, "documents")),
    "merge_terms": _merged,
    "close_chunks": lambda s, d: review.close_chunks(v.table(s, d, "embeddings")),
}


_plain = T.plain


def _quota_sql() -> str:
    out, taken = ["r AS (SELECT doc_id, error, seconds, hyp FROM runs WHERE backend = 'fast')"], []
    for name, condition, quota in [*BUCKETS, ("filler", "true", None)]:
        free = " AND ".join([condition.replace("size(", "len("), *(f"doc_id NOT IN (SELECT doc_id FROM {t})" for t in taken)])
        k = quota or f"({TOTAL} - {' - '.join(f'(SELECT count(*) FROM {t})' for t in taken)})"
        out.append(f"c_{name} AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n, {k} AS k FROM r WHERE {free})")
        out.append(f"b_{name} AS (SELECT doc_id FROM c_{name} WHERE n <= k OR p IN (SELECT round_even(any_value(n - 1) * i / any_value(k - 1), 0) FROM c_{name}, range(0, {TOTAL}) q(i) WHERE i < k GROUP BY i))")
        taken.append(f"b_{name}")
    return v.with_views("clips", "runs") + ", " + ", ".join(out) + " " + " UNION ALL ".join(f"SELECT doc_id, '{t[2:]}' AS review_bucket FROM {t}" for t in taken)


def _clean_sql() -> str:
    text = "coalesce(\"text\", '')"
    for wrong, right in review.REPAIRS.items():
        text = f"regexp_replace({text}, '{wrong.replace(chr(39), chr(39) * 2)}', '{right}', 'gi')"
    return rf"trim(regexp_replace(regexp_replace({text}, '\b({'|'.join(review.FILLERS)})\b[, ]*', '', 'gi'), '{review.SPACE}', ' ', 'g'))"


_TERM = r"""regexp_full_match(w, '[A-Z]{2,6}|[A-Z][a-z]{3,}([A-Z][a-z]+)*')"""
_MINED = """SELECT term, count(*) AS texts FROM (SELECT unnest(list_distinct(list_filter(regexp_extract_all("text", '[\\p{L}\\p{N}_]+'), lambda w: """ + _TERM + """))) AS term FROM documents WHERE doc_id % 2 = {}) GROUP BY 1 HAVING count(*) >= 2"""

SQL = {
    "term_coverage": v.with_views("clips", "runs")
    + f""", t AS (SELECT doc_id, backend, ' ' || {_plain('actual')} || ' ' AS said, lower(actual) AS raw, list_filter(toks, lambda w, i: i % 7 = 5) AS terms FROM runs),
e AS (SELECT doc_id, backend, said, raw, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM t),
d AS (SELECT doc_id, backend, said, raw, term, min(i) AS i FROM e GROUP BY ALL),
h AS (SELECT *, {T.hit('term')} AS hit FROM d),
g AS (SELECT doc_id, backend, string_agg(term, ',' ORDER BY i) FILTER (WHERE hit) AS hits, string_agg(term, ',' ORDER BY i) FILTER (WHERE NOT hit) AS misses, round(avg(hit::INT), 3) AS c FROM h GROUP BY 1, 2)
SELECT t.doc_id, t.backend, coalesce(hits, '') AS hits, coalesce(misses, '') AS misses, c AS term_coverage FROM t LEFT JOIN g USING (doc_id, backend)""",
    "ordered_checks": v.with_views("clips", "runs")
    + f""", t AS (SELECT doc_id, backend, ' ' || {_plain('actual')} || ' ' AS said, {_plain('toks[1]')} AS a, {_plain("coalesce(toks[3], '')")} AS b FROM runs)
SELECT doc_id, backend, NOT contains(said, a) OR NOT contains(said, b) OR contains(said, b || ' before ' || a) OR contains(said, a || ' after ' || b) AS order_failed,
  contains(said, b || ' to ' || a) OR NOT contains(said, a || ' to ' || b) AS change_failed FROM t""",
    "quota_sample": _quota_sql(),
    "action_items": f"""WITH c AS (SELECT doc_id, {_clean_sql()} AS c FROM documents),
s AS (SELECT doc_id, c, array_to_string(list_slice(list_filter(string_split(regexp_replace(c, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(lower(x), '{"|".join(review.ACTION_WORDS)}')), 1, 12), ' ') AS kept FROM c)
SELECT doc_id, CASE WHEN kept <> '' THEN kept ELSE substring(c, 1, 1200) END AS prompt FROM s""",
    "merge_terms": f"""WITH o AS (SELECT lower(term) AS key, max(term) AS canonical, sum(texts)::BIGINT AS n FROM ({_MINED.replace("= {}", "= 0")}) GROUP BY 1),
w AS (SELECT lower(term) AS key, max(term) AS term, sum(texts)::BIGINT AS m FROM ({_MINED.replace("= {}", "= 1")}) GROUP BY 1)
SELECT coalesce(term, canonical) AS canonical, CASE WHEN n >= 20 THEN 'approved' WHEN m IS NOT NULL THEN 'observed' ELSE 'candidate' END AS status, coalesce(n, 0) + coalesce(m, 0) AS count,
  CASE WHEN n IS NULL THEN key WHEN m IS NULL THEN upper(canonical) ELSE upper(canonical) || ',' || key END AS aliases, coalesce(m, 0) AS from_history FROM o FULL JOIN w USING (key)
ORDER BY coalesce(n >= 20, false) DESC, count DESC, key LIMIT 200""",
    "close_chunks": """WITH RECURSIVE f AS (SELECT vec_id, embedding AS x, len(embedding) AS n FROM embeddings),
s AS (SELECT vec_id, 0 AS pos, 0 AS first, false AS ends, 0 AS began FROM f UNION ALL
  SELECT vec_id, pos, CASE WHEN e THEN pos ELSE first END, e OR pos = n, first FROM (SELECT s.vec_id, s.pos + 1 AS pos, s.first, f.n,
    coalesce((s.pos + 1 - s.first) * 0.5 >= 10 OR ((s.pos + 1 - s.first) * 0.5 >= 3 AND abs(f.x[s.pos + 1])::DOUBLE <= 0.05::DOUBLE), false) AS e FROM s JOIN f USING (vec_id) WHERE s.pos < f.n))
SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY pos) - 1)::INT AS chunk, began AS first, pos - began AS length FROM s WHERE ends""",
}
