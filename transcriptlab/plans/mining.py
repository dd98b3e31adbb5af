"""Registered queries that learn corrections, meet rows by place and continue drafts, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import tokens
from ..operators import mining
from ..sources import views as v

KINDS = ("signup", "purchase", "error")
SIGNALS, OTHERS = ("the", "der", "les"), ("and", "und", "que", "with")


def _lines(s, d):
    """Conversations in which every third turn corrects a word of the one before it."""
    two = F.lag(F.slice(tokens(F.col("text"), lower=False), F.lit(1), F.lit(2))).over(Window.partitionBy("conv_id").orderBy("turn"))
    corrects = (F.col("turn") % 3 == 2) & (F.size(two) == 2)
    line = F.when(corrects, F.concat(F.lit("I said "), two[1], F.lit(", not "), two[0], F.lit(" please."))).otherwise(F.col("text"))
    return v.table(s, d, "conversations").select("conv_id", "turn", line.alias("line"))


def _roles(s, d):
    turns = v.table(s, d, "conversations").select("conv_id", "turn", "role")
    return mining.positional_join(turns.filter("role = 'user'"), turns.filter("role = 'assistant'"), "conv_id", "turn")


def _tails(s, d):
    """Drafts of the first words of clips, and second decodings of other stretches that may overlap them."""
    rows = v.clips(s, d).select("doc_id", F.transform("toks", F.lower).alias("t"))
    return rows.select("doc_id", F.slice("t", F.lit(1), F.lit(20)).alias("draft"), F.slice("t", (F.col("doc_id") % 22 + 1).cast("int"), (F.col("doc_id") % 5 * 6 + 8).cast("int")).alias("tail"))


QUERIES = {
    "correction_pairs": lambda s, d: mining.correction_pairs(_lines(s, d)).select("conv_id", "turn", "wrong", "right"),
    "learn_pairs": lambda s, d: mining.learn_pairs(_lines(s, d)),
    "positional_join": _roles,
    "newest_of_kinds": lambda s, d: mining.newest_of_kinds(v.table(s, d, "events"), KINDS),
    "chunk_totals": lambda s, d: mining.chunk_totals(v.segments(s, d)),
    "corpus_stats": lambda s, d: mining.corpus_stats(v.clips(s, d)),
    "ranked_by_keywords": lambda s, d: mining.ranked_by_keywords(v.clips(s, d), SIGNALS, OTHERS, 10),
    "continue_drafts": lambda s, d: mining.continue_drafts(_tails(s, d)),
}

_EDGES = mining.EDGES.replace("'", "''")
_TRAIL, _LEAD = mining.TRAIL, mining.LEAD


def _in(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _edges_off(x: str) -> str:
    return f"regexp_replace({x}, '^{_EDGES}|{_EDGES}$', '', 'g')"


def _valid(x: str) -> str:
    words = f"string_split(lower({x}), ' ')"
    return f"{x} <> '' AND length({x}) <= 50 AND len({words}) <= 3 AND NOT list_has_any({words}, {_in(mining.FILLERS + mining.BLOCKED)}) AND len(list_filter({words}, lambda w: NOT list_contains({_in(mining.TERM_STOP_WORDS)}, w))) > 0"


_PAIRS = rf"""WITH t AS (SELECT conv_id, turn, "text", lag(list_slice(regexp_extract_all("text", '[\p{{L}}\p{{N}}_]+'), 1, 2)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations),
l AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 AND len(p) = 2 THEN 'I said ' || p[2] || ', not ' || p[1] || ' please.' ELSE "text" END AS line FROM t),
n AS (SELECT *, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_edges_off('line')}, '[ \t\r\n]+', ' ', 'g'), '\bit[''’]?s\b', 'it is', 'gi'), '[,;:]+', ' ', 'g'), ' +', ' ', 'g')), '{_LEAD}', '', 'i') AS c FROM l),
m AS (SELECT *, {_edges_off(f"regexp_extract(c, '{mining.PAIR}', 1, 'i')")} AS a, {_edges_off(f"regexp_extract(c, '{mining.PAIR}', 2, 'i')")} AS b FROM n WHERE length(c) <= 90 AND length(c) - length(replace(c, ' not ', '')) = 5),
x AS (SELECT *, regexp_replace(regexp_replace(a, '{_LEAD}', '', 'i'), '{_TRAIL}', '', 'i') AS r, regexp_replace(b, '{_TRAIL}', '', 'i') AS w FROM m),
pairs AS (SELECT conv_id, turn, w AS wrong, CASE WHEN regexp_full_match(r, '[A-Z][a-z]+') AND NOT contains(w, ' ') THEN lower(r) ELSE r END AS "right" FROM x WHERE lower(r) <> lower(w) AND {_valid('r')} AND {_valid('w')})
"""
_NAME = "regexp_matches({}, '[0-9.+#-]|[A-Z].*[A-Z]')"

SQL = {
    "correction_pairs": _PAIRS + 'SELECT conv_id, turn, wrong, "right" FROM pairs',
    "learn_pairs": _PAIRS
    + f""", s AS (SELECT l.conv_id, l.turn, wrong, "right", last_value(CASE WHEN wrong IS NULL THEN line END IGNORE NULLS) OVER (PARTITION BY l.conv_id ORDER BY l.turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said FROM l LEFT JOIN pairs USING (conv_id, turn)),
k AS (SELECT *, regexp_extract_all(coalesce(said, ''), '{mining.TERM}') AS ws, contains(wrong, ' ') OR contains("right", ' ') OR {_NAME.format('wrong')} OR {_NAME.format('"right"')} OR levenshtein(lower(wrong), lower("right")) <= 2 AS safe FROM s WHERE wrong IS NOT NULL),
q AS (SELECT *, coalesce(list_position(list_transform(ws, lambda z: lower(z)), lower(wrong)), 0) AS p FROM k)
SELECT conv_id, turn, CASE WHEN safe THEN wrong ELSE array_to_string(list_slice(ws, greatest(1, p - 2), p + 3), ' ') END AS source,
  CASE WHEN safe THEN "right" ELSE array_to_string(list_concat(list_concat(CASE WHEN p > 1 THEN list_slice(ws, greatest(1, p - 2), p - 1) ELSE [] END, ["right"]), list_slice(ws, p + 1, p + 3)), ' ') END AS replacement FROM q WHERE safe OR p > 0""",
    "positional_join": """WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS place FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS place FROM conversations WHERE role = 'assistant')
SELECT conv_id, place, coalesce(u.turn, -1) AS "left", coalesce(a.turn, -1) AS "right" FROM u FULL JOIN a USING (conv_id, place)""",
    "newest_of_kinds": "SELECT *, " + " AND ".join(f"{k} >= 0" for k in KINDS) + " AS complete FROM (SELECT user_id, " + ", ".join(f"coalesce(arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type = '{k}'), -1) AS {k}" for k in KINDS) + " FROM events GROUP BY 1)",
    "chunk_totals": v.with_views("segments") + "SELECT conv_id, count(*) AS chunks, max(compute)::DOUBLE AS longest, bool_and(compute <= duration) AS keeps_up FROM segments GROUP BY 1",
    "corpus_stats": v.with_views("clips") + "SELECT category, count(*) AS n, count(*) FILTER (WHERE trust = 'gold') AS gold, count(*) FILTER (WHERE trust = 'needs_human_review') AS to_review, round(max(audio_seconds)::DOUBLE, 3) AS longest, count(DISTINCT source) AS sources FROM clips GROUP BY 1",
    "ranked_by_keywords": v.with_views("clips")
    + f""", s AS (SELECT category, doc_id, audio_seconds, (5 * len(list_intersect(list_distinct(list_transform(toks, lambda w: lower(w))), {_in(SIGNALS)})) + len(list_intersect(list_distinct(list_transform(toks, lambda w: lower(w))), {_in(OTHERS)})))::INT AS score FROM clips)
SELECT category, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, audio_seconds DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "continue_drafts": v.with_views("clips")
    + """, r AS (SELECT doc_id, list_transform(toks, lambda w: lower(w)) AS t FROM clips), b AS (SELECT doc_id, list_slice(t, 1, 20) AS d, list_slice(t, doc_id % 22 + 1, doc_id % 22 + doc_id % 5 * 6 + 8) AS e FROM r),
g AS (SELECT doc_id, d, e, w FROM b, range(4, 10) q(w)), h AS (SELECT doc_id, d, e, w, unnest(range(1, greatest(1, len(e) - w + 2))) AS i FROM g), j AS (SELECT *, unnest(range(1, greatest(1, len(d) - w + 2))) AS p FROM h),
k AS (SELECT doc_id, max(row(w, p, i + w - 1)) AS best, arg_max(i + w - 1, row(w, p, i + w - 1)) AS stop FROM j WHERE list_slice(d, p, p + w - 1) = list_slice(e, i, i + w - 1) GROUP BY 1),
o AS (SELECT b.doc_id, stop, len(e) - stop AS n, list_slice(e, stop + 1, len(e)) AS x FROM b LEFT JOIN k USING (doc_id))
SELECT doc_id, CASE WHEN stop IS NULL THEN 'no-overlap' WHEN n < 4 THEN 'no-new-tail' WHEN n > 22 THEN 'append-too-long' ELSE 'merged' END AS outcome, CASE WHEN n BETWEEN 4 AND 22 THEN array_to_string(x, ' ') ELSE '' END AS appended FROM o""",
}
