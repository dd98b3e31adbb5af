"""Registered queries about second passes over drafts and cuts of recordings, and the same in SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import newwords as N
from ..functions import policies, roman, spelled, structure
from ..functions.columns import tokens
from ..operators import agreement, cutting, merging, staged, stems
from ..sources import views as v
from .sqltext import listed, quoted

MOST, GLOSSARY = 3.0, ("mcp", "gpu")
#: Samples a second, and the wanted, least and greatest length of a chunk and its leeway in seconds.
RATE, SECONDS = 1000, (1.2, 0.6, 1.5, 0.4)


def _text(words):
    return F.array_join(words, ",")


def _romanized(s, d):
    c = F.col("candidate")
    return v.second_decodings(s, d).select("id", roman.romanized(c).alias("roman"), roman.one_spelling(c).alias("spelled"))


def _new_words(s, d):
    a, b = F.col("draft"), F.col("candidate")
    return v.second_decodings(s, d).select("id", N.new_english(a, b, True, True, GLOSSARY).alias("strict"), N.new_english(a, b, False, False, GLOSSARY).alias("loose"), _text(N.new_roman(a, b)).alias("new_roman"))


def _witness_terms(s, d):
    x = N.witness_support(F.col("draft"), F.col("candidate"), F.col("witness"))
    return v.second_decodings(s, d).select("id", x.alias("x")).select("id", _text("x.supported").alias("supported"), _text("x.unsupported").alias("unsupported"))


def _witness_verdicts(s, d):
    rows = v.second_decodings(s, d).withColumn("reasons", N.reject_reasons(F.col("draft"), F.col("candidate"), F.col("seconds"), MOST, glossary=GLOSSARY))
    return N.witness_verdict(rows).select("id", "verdict.accepted", _text("verdict.named").alias("named"), _text("verdict.unsupported_named").alias("alone"))


def _near_words(s, d):
    rows = v.second_decodings(s, d).select("id", "draft", F.array_distinct(N.words_of(F.col("candidate"))).alias("tokens"))
    return staged.near_words(rows, "id", "draft", "tokens")


def _staged(s, d):
    out = staged.staged(v.second_decodings(s, d).drop("witness"), MOST, GLOSSARY)
    return out.select("id", "outcome", "accepted", "text", _text("reasons").alias("reasons"), _text("removed").alias("removed"), _text("rules").alias("rules"))


def _merged_tails(s, d):
    """A second decoding that is still behind its draft, with faults, for utterances of which some have chunks pending."""
    n = F.col("doc_id")
    rows = v.clips(s, d).select("doc_id", F.col("gold").alias("draft"), F.filter(F.slice("toks", F.lit(1), (n % 30 + 3).cast("int")), lambda w, i: (n + i) % 9 > 0).alias("w"), (n % 2).cast("int").alias("pending"))
    return merging.merge_tails(rows.withColumn("text", F.concat(F.array_join("w", " "), F.when(n % 3 == 0, ",").otherwise("")))).select("doc_id", "pending", "merged", (F.size(tokens(F.col("merged"))) - F.size("w")).alias("added"))


def _quiet_chunks(s, d):
    frames = v.recordings(s, d)
    return cutting.quiet_chunks(frames, frames.groupBy("clip").agg((F.count("*") * 10 + 10).alias("total")), RATE, *SECONDS)


SAID = tuple("okay so|yeah yeah|i|like like|and then|but|you know you know|for example|the API|gpt4|, but|so the question is that|um|right. But|readme.md|matlab".split("|"))


def _dictated(s, d):
    """Utterances with what dictation puts between their words."""
    n = F.col("doc_id")
    said = F.transform("toks", lambda w, i: F.when((n * 7 + i * i * 3) % 11 < n % 4, F.concat(F.get(F.array(*map(F.lit, SAID)), ((n + i * 5) % len(SAID)).cast("int")), F.lit(" "), F.lower(w))).otherwise(F.lower(w)))
    return v.clips(s, d).select("doc_id", F.array_join(F.slice(said, F.lit(1), (n % 36 + 4).cast("int")), " ").alias("t")).withColumn("x", structure.structured(F.col("t")))


def _structured(s, d):
    return _dictated(s, d).select("doc_id", "x.text", "x.changed", _text("x.rules").alias("rules"))


def _structure_rules(s, d):
    """How often each rule fired among texts that were rewritten, and how many texts stayed as they were."""
    rows = _dictated(s, d).select(F.when(F.col("x.changed"), F.col("x.rules")).otherwise(F.array(F.lit("unchanged"))).alias("rules"))
    # outer, as else Spark would test whether there are rules beforehand, and rewrite each text for it several times
    return rows.select(F.explode_outer("rules").alias("rule")).filter("rule IS NOT NULL").groupBy("rule").agg(F.count("*").alias("n"))


def _confirmed(s, d):
    """Three backends as models, whose classes of language mostly agree."""
    runs = v.runs(s, d).withColumn("place", F.when(F.col("backend") == "fast", 0).when(F.col("backend") == "accurate", 1).otherwise(2)).withColumn("near", F.pmod(F.col("doc_id") * 5 + F.col("place") * 3, F.lit(7)))
    kind = F.when(F.col("near") == 0, "uncertain").when((F.col("category") == "en") != (F.col("near") == 1), "english_only").otherwise("hindi_english")
    text = F.when(F.col("doc_id") % 4 == 0, F.col("actual")).otherwise(F.col("gold"))
    votes = runs.select("id", "place", F.col("backend").alias("model"), F.col("error").isNull().alias("ok"), text.alias("transcript"), kind.alias("language_class"), (F.col("near") / 10).alias("confidence"))
    return agreement.confirmed(v.clips(s, d).select("id", "gold", F.col("category").alias("bucket")), votes)


LANGUAGES = ("hi", "en", "fr", "en", "ur", None)


def _detector_risks(s, d):
    """Chunks of conversations as a detector may have heard them."""
    n = F.col("conv_id") * 7 + F.col("turn") * 5
    rows = v.table(s, d, "conversations").select("conv_id", "turn", F.get(F.array(*map(F.lit, LANGUAGES)), (n % len(LANGUAGES)).cast("int")).alias("language"), F.when(n % 13 > 0, n % 11 / 10.0).alias("probability"))
    return rows.select("conv_id", "turn", policies.detector_reason(F.col("turn"), F.col("language"), F.col("probability"), 0.5, 0.8).alias("reason"))


def _update_policies(s, d):
    a, b = F.col("draft"), F.col("candidate")
    return v.second_decodings(s, d).select("id", policies.update_policies(a, b).alias("p")).select("id", "p.*")


def _replacement_audits(s, d):
    """How often an audit decides what, and what is kept on the mean."""
    n = F.col("id")
    audit = policies.replacement_audit(F.col("draft"), F.col("candidate"), n % 5 != 0, F.when(n % 2 == 0, policies.SURE_ROUTES[0]))
    rows = v.second_decodings(s, d).select(audit.alias("a"))
    return rows.groupBy("a.decision", "a.confidence").agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("a.retained") * 1000).cast("long")) / (F.count("*") * 1000) + 1e-9, 4).alias("retained"), F.sum("a.new").alias("new"))


def _utterance_files(s, d):
    """Page addresses as stems of files, some cut or lengthened, for the pages they are of."""
    pages = v.table(s, d, "pages").select("page_id", F.concat(F.lit("utt-"), "page_id", F.lit("-"), F.regexp_replace("url", "[^a-z0-9]+", "-")).alias("id"))
    n, whole = F.col("page_id"), F.col("id")
    stem = F.when(n % 4 == 0, whole).when(n % 4 == 1, F.substring(whole, 3, 9)).when(n % 4 == 2, F.concat(whole, F.lit("-take"), n % 3))
    return stems.files_of(pages, pages.select(stem.alias("stem"), F.concat(F.lit("/audio/"), n, F.lit(".wav")).alias("path"), n.alias("place"))).select("page_id", "path")


def _spelled_terms(s, d):
    """Utterances with letters spelled out, and second texts that have the terms."""
    n = F.col("doc_id")
    of = lambda words, i: F.get(F.array(*map(F.lit, words)), (i % len(words)).cast("int"))
    said = F.concat_ws(" ", F.slice("toks", F.lit(1), F.lit(4)), of(("A P I", "a, p, i", "G P U A P I", "A S X", "T T S , A S R"), n), F.slice("toks", F.lit(5), F.lit(4)))
    other = F.concat_ws(" ", of(("API", "GPU and API", "ASR", "TTS ASR", "none"), n * 3 + F.floor(n / 5)), F.slice("toks", F.lit(1), F.lit(3)))
    return v.clips(s, d).select("doc_id", spelled.spelled_terms(said, other).alias("x")).select("doc_id", "x.text", _text("x.rules").alias("rules"))


QUERIES = {
    "detector_risks": _detector_risks,
    "update_policies": _update_policies,
    "replacement_audits": _replacement_audits,
    "utterance_files": _utterance_files,
    "spelled_terms": _spelled_terms,
    "structured_texts": _structured,
    "structure_rules": _structure_rules,
    "confirmed_transcripts": _confirmed,
    "romanized_texts": _romanized,
    "new_word_reasons": _new_words,
    "witness_terms": _witness_terms,
    "witness_verdicts": _witness_verdicts,
    "near_words": _near_words,
    "staged_passes": _staged,
    "merged_tails": _merged_tails,
    "quiet_chunks": _quiet_chunks,
}


def _pick(words, n: str) -> str:
    return f"{listed(words)}[({n}) % {len(words)} + 1]"


_NONE = "[]::VARCHAR[]"
def _content(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[A-Za-z0-9]+'), lambda w: length(w) >= 4 AND w NOT IN ({', '.join(map(quoted, policies.CONTENT_STOP))})))"


def _terms(x: str) -> str:
    """Words stand between blanks here."""
    return f"list_distinct(list_transform(list_filter(string_split({x}, ' '), lambda w: regexp_matches(w, '^([A-Z0-9]*[A-Z][A-Z0-9]+|[A-Z][A-Z0-9]*[0-9]|[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*)$') AND (upper(w) = w OR length(w) >= 4)), lambda w: lower(w)))"


_SECOND = f"""second AS (
  SELECT doc_id AS id, array_to_string(list_concat(name, w), ' ') AS draft,
    CASE WHEN doc_id % 53 = 0 THEN '  ' WHEN doc_id % 43 = 0 THEN said || ' �' WHEN doc_id % 23 = 0 THEN said || ' and' ELSE said END AS candidate,
    array_to_string(list_transform(w, lambda x, i: CASE WHEN (doc_id + i - 1) % 2 = 0 THEN x || 's' WHEN (doc_id * 5 + i - 1) % 31 = 0 THEN reverse(x) ELSE x END), ' ') AS witness
  FROM (SELECT *, array_to_string(flatten([CASE WHEN doc_id % 13 = 0 THEN {_NONE} ELSE name END, heard,
      CASE WHEN doc_id % 5 = 0 THEN [{_pick(v.INDIC, 'doc_id')}, {_pick(v.INDIC, 'doc_id * 3 + 1')}] ELSE {_NONE} END,
      CASE WHEN doc_id % 4 > 1 THEN list_transform(range(1, doc_id % 7 + 2), lambda i: {_pick(v.ROMAN, 'doc_id + i')}) ELSE {_NONE} END,
      CASE WHEN doc_id % 41 = 0 THEN ['ok', 'ok', 'ok', 'ok', 'ok', 'ok'] ELSE {_NONE} END]), ' ') AS said
    FROM (SELECT *, CASE WHEN doc_id % 11 < 2 THEN [{_pick(v.NAMES, 'doc_id')}] ELSE {_NONE} END AS name,
        list_filter(list_transform(w, lambda x, j: CASE WHEN (doc_id + (j - 1) * 3) % 19 < doc_id % 3 + doc_id % 2 THEN x || 'e' WHEN (doc_id * 5 + j - 1) % 31 < doc_id % 3 + doc_id % 2 THEN reverse(x)
          WHEN (doc_id + j - 1) % 29 = 0 THEN NULL WHEN doc_id % 4 > 0 AND (doc_id + (j - 1) * 2) % 5 = 0 THEN {_pick(v.ROMAN, 'doc_id + j - 1')} ELSE x END), lambda x: x IS NOT NULL) AS heard
      FROM (SELECT doc_id, list_transform(list_slice(toks, 1, doc_id % 17 + 6), lambda x: lower(x)) AS w FROM clips WHERE len(toks) >= 6))))"""


def _romanized_sql(x: str) -> str:
    """Words stand between blanks here, so that each is looked up whole."""
    text = x
    for word, kept in roman.WORDS_FIRST.items():
        text = f"replace({text}, {quoted(word)}, {quoted(kept)})"
    for single, dotted in roman.DOTTED.items():
        text = f"replace({text}, {quoted(dotted)}, {quoted(single)})"
    text = f"regexp_replace(regexp_replace(regexp_replace({text}, '([{roman.ASPIRATED}])', '\\1h', 'g'), '([{roman.LETTER}]h?)', '\\1a', 'g'), 'a([{roman.SIGN}])', '\\1', 'g')"
    for sign, letters in roman.TWO.items():
        text = f"replace({text}, {quoted(sign)}, {quoted(letters)})"
    spoken = "MAP{" + ", ".join(f"{quoted(w)}: {quoted(k.replace('_', ' '))}" for w, k in roman.SPOKEN.items()) + "}"
    words = f"list_transform(string_split(translate({text}, {quoted(roman.FROM)}, {quoted(roman.TO)}), ' '), lambda w: coalesce({spoken}[lower(w)], w))"
    return f"CASE WHEN regexp_matches({x}, '[\\x{{0900}}-\\x{{097F}}]') THEN trim(regexp_replace(array_to_string({words}, ' '), '\\s+', ' ', 'g')) ELSE {x} END"


_SPELLED = "MAP{" + ", ".join(f"{quoted(w)}: {quoted(k)}" for w, k in roman.SPELLINGS.items()) + "}"


def _words(x: str, least: int = 0) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[A-Za-z0-9]+'), lambda w: length(w) >= {least})"


def _plural(known: str, w: str = "w") -> str:
    return f"(list_contains({known}, {w} || 's') OR ({w} LIKE '%s' AND list_contains({known}, left({w}, length({w}) - 1))))"


def _flags(strict: bool) -> str:
    least, allowed = (3, (*N.ROMAN, *GLOSSARY, *N.STRICT)) if strict else (4, (*GLOSSARY, *N.COMMON))
    known = f"list_contains({_words('draft', least)}, w) OR (length(w) >= 6 AND contains(array_to_string({_words('draft')}, ''), w)) OR {_plural(_words('draft', least))} OR list_contains({listed(allowed)}, w)"
    return f"list_transform({_words('candidate', least)}, lambda w: {{'word': w, 'new': NOT ({known})}})"


def _named(label: str, words: str) -> str:
    return f"'{label}' || array_to_string(list_slice({words}, 1, 5), ',')"


def _new_of(x: str) -> str:
    return f"list_transform(list_filter({x}, lambda z: z.new), lambda z: z.word)"


def _roman_of(x: str) -> str:
    return f"list_distinct(list_filter(list_concat({_words(x)}, {_words('roman')}), lambda w: list_contains({listed(N.ROMAN)}, w) AND NOT list_contains({_words('draft')}, w) AND NOT list_contains({listed(N.IDLE)}, w)))"


_BACKED = f"(list_contains(have, w) OR {_plural('have')} OR (length(w) >= 5 AND len(list_filter(have, lambda z: length(z) >= 5 AND (contains(z, w) OR contains(w, z)))) > 0))"
_TARGET, _LEAST, _GREATEST, _AROUND = (int(x * RATE) for x in SECONDS)


def _stop(start: str) -> str:
    ideal = f"({start} + {_TARGET})"
    lower, upper = f"greatest({start} + {_LEAST}, {ideal} - {_AROUND})", f"least({start} + {_GREATEST}, {ideal} + {_AROUND}, total - {_LEAST})"
    quiet = f"(SELECT arg_min(place, {{'s': energy / (middle + 1e-9) + 0.10 * (abs(place - {ideal}) / {RATE}.0), 'p': place}}) FROM frames f WHERE f.clip = c.clip AND place > {lower} AND place < {upper})"
    return f"CASE WHEN total - {start} <= {_GREATEST} THEN total WHEN {upper} <= {lower} THEN least({ideal}, total) ELSE coalesce({quiet}, {ideal}) END"


SQL = {
    "romanized_texts": f"""{v.with_views("clips")}, {_SECOND}
SELECT id, {_romanized_sql("candidate")} AS roman, array_to_string(list_transform(string_split(candidate, ' '), lambda w: coalesce({_SPELLED}[w], w)), ' ') AS spelled FROM second""",
    "new_word_reasons": f"""{v.with_views("clips")}, {_SECOND}, judged AS (SELECT id, draft, candidate, {_romanized_sql("candidate")} AS roman, {_flags(True)} AS s, {_flags(False)} AS l FROM second),
runs AS (SELECT *, list_min(list_filter(range(2, len(l) + 1), lambda i: l[i].new AND l[i - 1].new)) AS run FROM judged)
SELECT id, CASE WHEN len({_new_of("s")}) > 0 THEN {_named(N.NEW[0], _new_of("s"))} END AS strict,
  CASE WHEN run IS NOT NULL THEN {_named(N.NEW[1], _new_of("list_slice(l, 1, run)"))} WHEN len(list_distinct({_new_of("l")})) >= 2 THEN {_named(N.NEW[2], _new_of("l"))} END AS loose,
  array_to_string(list_sort({_roman_of('candidate')}), ',') AS new_roman FROM runs""",
    "witness_terms": f"""{v.with_views("clips")}, {_SECOND}, new AS (
  SELECT id, {_words("witness", 3)} AS have, list_filter(list_transform(list_filter(list_zip(c, range(1, len(c) + 1)), lambda z: list_position(c, z[1]) = z[2]), lambda z: z[1]),
    lambda w: NOT list_contains(d, w) AND NOT {_plural("d")} AND NOT list_contains({listed((*N.WITNESS_STOP, *N.ROMAN))}, w)) AS new
  FROM (SELECT *, {_words("draft", 3)} AS d, {_words("candidate", 4)} AS c FROM second))
SELECT id, array_to_string(list_filter(new, lambda w: {_BACKED}), ',') AS supported, array_to_string(list_filter(new, lambda w: NOT {_BACKED}), ',') AS unsupported FROM new""",
    "quiet_chunks": f"""WITH RECURSIVE frames AS MATERIALIZED (
  SELECT clip, energy, (v // 64 * 64 + pos - 1) * 10 + 10 AS place FROM (SELECT 'rec_' || vec_id % 64 AS clip, vec_id AS v, unnest(range(1, len(embedding) + 1)) AS pos, abs(CAST(unnest(embedding) AS DOUBLE)) AS energy FROM embeddings)
), known AS MATERIALIZED (SELECT clip, count(*) * 10 + 10 AS total, median(energy) AS middle FROM frames GROUP BY clip),
cuts AS (
  SELECT clip, 0 AS chunk, 0::BIGINT AS start, {_stop("0")} AS stop FROM known c
  UNION ALL SELECT clip, chunk + 1, stop, {_stop("stop")} FROM (SELECT cuts.*, total, middle FROM cuts JOIN known USING (clip) WHERE stop < total) c
) SELECT clip, chunk, start, stop FROM cuts""",
    "detector_risks": f"""SELECT conv_id, turn, CASE WHEN language IN ('hi', 'ur') THEN 'language:' || language WHEN language = 'en' AND probability < 0.5 THEN 'english_low_confidence'
    WHEN language = 'en' AND turn = 0 AND probability < 0.8 THEN 'english_early_low_confidence' WHEN language <> '' AND probability < 0.5 THEN 'non_english_low_confidence:' || language END AS reason
  FROM (SELECT conv_id, turn, [{", ".join(quoted(x) if x else "NULL" for x in LANGUAGES)}][(conv_id * 7 + turn * 5) % {len(LANGUAGES)} + 1] AS language,
    CASE WHEN (conv_id * 7 + turn * 5) % 13 > 0 THEN (conv_id * 7 + turn * 5) % 11 / 10.0 END AS probability FROM conversations)""",
    "replacement_audits": f"""{v.with_views("clips")}, {_SECOND},
texts AS (SELECT *, id % 5 <> 0 AS safe, CASE WHEN id % 5 <> 0 THEN candidate ELSE draft END AS text FROM second),
facts AS (SELECT *, {_content("draft")} AS d, {_content("text")} AS f, len(list_filter({_terms("draft")}, lambda w: NOT list_contains({_terms("text")}, w))) AS lost,
  len({_roman_of("text")}) AS value FROM (SELECT *, {_romanized_sql("text")} AS roman FROM texts)),
kept AS (SELECT *, CASE WHEN len(d) = 0 THEN 1.0 ELSE len(list_intersect(d, f)) / len(d) END AS r, list_filter(f, lambda w: NOT list_contains(d, w)) AS fresh FROM facts),
audit AS (SELECT r, len(fresh) AS new, CASE WHEN NOT safe AND id % 2 = 0 THEN ['keep_fast', 'high'] WHEN NOT safe THEN ['keep_fast', 'medium'] WHEN lost > 0 THEN ['reject_drop', 'high']
  WHEN r < 0.78 AND r >= 0.65 AND value >= 5 THEN ['replace_candidate', 'medium'] WHEN r < 0.78 THEN ['reject_drop', 'medium'] WHEN len(fresh) = 0 AND r >= 0.95 THEN ['save_alternate', 'high']
  WHEN len(fresh) <= 2 AND r >= 0.90 AND len(list_filter(fresh, lambda w: length(w) > 4)) = 0 THEN ['save_alternate', 'medium'] WHEN r >= 0.82 THEN ['replace_candidate', 'medium'] ELSE ['needs_review', 'low'] END AS a FROM kept)
SELECT a[1] AS decision, a[2] AS confidence, count(*) AS n, round(sum(CAST(round(round(r, 3) * 1000) AS BIGINT)) / (count(*) * 1000.0) + 1e-9, 4) AS retained, CAST(sum(new) AS BIGINT) AS new FROM audit GROUP BY ALL""",
    "utterance_files": """WITH ids AS (SELECT page_id, 'utt-' || page_id || '-' || regexp_replace(url, '[^a-z0-9]+', '-', 'g') AS id FROM pages),
files AS (SELECT stem, min(page_id) AS place, arg_max(page_id, page_id) AS page FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN id WHEN 1 THEN substr(id, 3, 9) WHEN 2 THEN id || '-take' || page_id % 3 END AS stem FROM ids) WHERE stem <> '' GROUP BY stem),
held AS (SELECT page_id, arg_min(page, place) AS page FROM ids JOIN files ON contains(id, stem) OR contains(stem, id) GROUP BY page_id)
SELECT ids.page_id, '/audio/' || coalesce(e.page, h.page) || '.wav' AS path FROM ids LEFT JOIN files e ON e.stem = ids.id LEFT JOIN held h ON h.page_id = ids.page_id""",
}
