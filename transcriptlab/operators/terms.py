"""Jobs that mine terms from texts and rewrite texts by a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts as X
from ..functions.columns import let, tokens
from ..functions.meaning import listed
from ..functions.rules import learnable_text, plain_term
from .mining import TERM_STOP_WORDS, correction_pairs

# What terms look like, words that are in none, and words that introduce one.
ACRONYM = r"\b[A-Z]{2,8}\b"
CAMEL = r"\b[A-Za-z]*[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*\b"
ACRONYM_PHRASE = r"\b(?:[A-Z]{2,8}|[A-Z][A-Za-z0-9.+#-]+)(?:\s+(?:[A-Z]{2,8}|[A-Z][A-Za-z0-9.+#-]+|[a-z][a-z0-9.+#-]+)){1,3}\b"
TITLE_PHRASE = r"\b(?:[A-Z][a-z0-9]+|[A-Z]{2,8})(?:\s+(?:[A-Z][a-z0-9]+|[A-Z]{2,8})){1,5}\b"
CAPITALISED = r"\b[A-Z][a-zA-Z0-9.+#-]{2,}\b"
INTRODUCED = r"(?i)\b(?:term|terms|tool|tools|model|models|app|apps|project|projects|report|reports|library|libraries|framework|stack|skill|skills)\s+(?:called\s+|named\s+|like\s+)?([A-Za-z][A-Za-z0-9.+#-]{2,})\b"
BLOCKED_WORDS = ("background", "bro", "detected", "failure", "noise", "retry", "shit", "term", "terms")
CONTEXT_WORDS = ("acronym", "acronyms", "keyword", "keywords", "term", "terms", "transcript", "transcription")
NAMES = ("MCP", "UX", "ASR", "STT", "Codex", "Gemini", "OpenAI")
LONG_STOP = ("the", "and", "that", "this", "with", "from", "have", "were", "will", "your", "they", "been")
#: Letters and digits beyond ASCII, which are parts of words, and everything else beyond it, which isn't.
WIDE_LETTER, WIDE = r"[^\P{L}A-Za-z]|[^\P{N}0-9]|\p{M}", r"[^\x00-\x7F]"


def narrowed(text: Column) -> Column:
    """A text where other letters than a-z are x and other signs than those of ASCII are semicolons: the ends of words stay where they are."""
    return F.regexp_replace(F.regexp_replace(X.filled(text), WIDE_LETTER, "x"), WIDE, ";")


def _trimmed(phrase: Column) -> Column:
    """A phrase without stop words at its ends."""
    words = F.split(plain_term(phrase), " ")

    def kept(w: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: ~F.lower(F.get(w, i - 1)).isin(*TERM_STOP_WORDS))
        return F.when(F.size(places) == 0, "").otherwise(F.array_join(F.slice(w, F.array_min(places), F.array_max(places) - F.array_min(places) + 1), " "))

    return let(words, kept)


def valid_term(term: Column) -> Column:
    """3 to 80 characters, with words, not all of them stop words, none blocked, and no one or two words that begin with a stop word."""
    words = F.regexp_extract_all(F.lower(term), F.lit("[a-z0-9]+"), F.lit(0))
    stop = listed(TERM_STOP_WORDS)
    return let(words, lambda w: F.length(term).between(3, 80) & (F.size(F.array_except(w, stop)) > 0) & ~F.arrays_overlap(w, listed(BLOCKED_WORDS)) & ~(F.array_contains(stop, F.get(w, F.lit(0))) & (F.size(w) <= 2)))


def candidate_terms(text: Column) -> Column:
    """Acronyms, camel case, phrases with an acronym, title phrases, capitalised words and words that are introduced as names, each once, sorted."""
    clean = F.regexp_replace(narrowed(text), r"(?i)\[(?:BLANK_AUDIO|MUSIC|NOISE|SILENCE|INAUDIBLE)\]", " ")

    def found(t: Column) -> Column:
        every = lambda p, g=0: F.regexp_extract_all(t, F.lit(p), F.lit(g))
        phrases = F.transform(F.filter(every(ACRONYM_PHRASE), lambda p: p.rlike(ACRONYM)), _trimmed)
        return F.concat(every(ACRONYM), every(CAMEL), phrases, every(TITLE_PHRASE), every(CAPITALISED), every(INTRODUCED, 1))

    return F.array_sort(F.array_distinct(F.filter(F.transform(let(clean, found), plain_term), valid_term)))


def telling_acronym(term: Column) -> Column:
    return term.rlike("^[A-Z]{3,8}$") & ~F.lower(term).isin(*TERM_STOP_WORDS, *BLOCKED_WORDS)


def product_word(word: Column) -> Column:
    """Whether a word looks like a product's: an acronym or its plural, with digits or signs, or with a capital inside."""
    return telling_acronym(word) | word.rlike("^[A-Z]{2,8}s$") | word.rlike("[0-9.+#-]") | (word.rlike("[a-z]") & word.rlike("^.+[A-Z]"))


def passive_safe(term: Column) -> Column:
    """Whether a term may be learnt without being asked: an acronym, or with a word that looks like a product's."""
    return telling_acronym(term) | F.exists(F.split(term, " "), product_word)


def contextual_acronyms(text: Column, reach: int = 12) -> Column:
    """Acronyms with a word that speaks of terms among the 12 words on either side, each once, sorted."""
    words = F.regexp_extract_all(narrowed(text), F.lit("[A-Za-z0-9.+#-]+"), F.lit(0))

    def near(w: Column) -> Column:
        window = lambda i: F.slice(w, F.greatest(F.lit(1), i + 1 - reach), F.least(i, F.lit(reach)) + reach + 1)
        return F.filter(w, lambda x, i: telling_acronym(plain_term(x)) & F.exists(window(i), lambda y: F.lower(y).isin(*CONTEXT_WORDS)))

    return F.array_sort(F.array_distinct(F.transform(let(words, near), plain_term)))


def named_terms(text: Column, names: tuple[str, ...] = NAMES) -> Column:
    """Words in capitals and with a capital inside, and known names whatever their case, sorted whatever their case."""
    words = F.regexp_extract_all(narrowed(text), F.lit(r"\b[A-Z][A-Z0-9]{1,9}\b|\b[A-Za-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*\b"), F.lit(0))
    known = let(tokens(text), lambda w: F.filter(listed(names), lambda n: F.array_contains(w, F.lower(n))))
    every = F.array_distinct(F.concat(F.filter(words, lambda w: ~F.lower(w).isin("ok", "yes", "no")), known))
    return F.transform(F.array_sort(F.transform(every, lambda w: F.struct(F.lower(w).alias("k"), w.alias("w")))), lambda x: x["w"])


def leading_terms(text: Column, most: int = 12) -> Column:
    """The first words that are capitalised, have digits or 7 letters, each once."""
    words = F.regexp_extract_all(narrowed(text), F.lit("[A-Za-z][A-Za-z0-9.+#-]{2,}"), F.lit(0))
    telling = lambda w: ~F.lower(w).isin(*LONG_STOP) & (w.rlike("^[A-Z]|[0-9]") | (F.length(w) >= 7))
    return F.slice(F.array_distinct(F.filter(words, telling)), 1, most)


def learn_terms(attempts: DataFrame, newest: int = 300, least: int = 2) -> DataFrame:
    """(term, count): what the newest attempts teach: safe terms of two attempts or more, or of one that speaks of them as a term.

    attempts: ordinal, status, corrected_text, pasted_text, raw_text.  A term counts once for each attempt; what a correction calls wrong is never learnt.
    """
    last = attempts.orderBy(F.col("ordinal").desc()).limit(newest)
    said = last.select("ordinal", learnable_text(F.col("status"), F.col("corrected_text"), F.col("pasted_text"), F.col("raw_text")).alias("text")).filter("text <> ''")
    counts = said.select(F.explode(candidate_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("count"))
    spoken_of = said.select(F.explode(contextual_acronyms(F.col("text"))).alias("t")).select(F.lower("t").alias("_k")).distinct().withColumn("_c", F.lit(True))
    wrong = correction_pairs(said.select(F.explode(F.split("text", "\n")).alias("line"))).select(F.lower(plain_term(F.col("wrong"))).alias("_k")).distinct()
    keyed = counts.withColumn("_k", F.lower("term")).join(wrong, "_k", "left_anti").join(spoken_of, "_k", "left")
    return keyed.filter(passive_safe(F.col("term")) & ((F.col("count") >= least) | F.coalesce("_c", F.lit(False)))).select("term", "count")


def rewrite(texts: DataFrame, fixes: DataFrame, aliases: DataFrame) -> DataFrame:
    """texts (doc_id unique, text) with known wrong phrases written right: approved fixes (wrong, right) first, then aliases, longest first.

    Whole words whatever their case.  A text meets the entries whose first word it has, by a join, so a dictionary of any size will do.
    """
    first = lambda c: F.coalesce(F.get(tokens(F.col(c)), F.lit(0)), F.lit(""))
    entry = F.struct("kind", (-F.length("wrong")).alias("size"), "wrong", "right").alias("entry")
    known = fixes.select("wrong", "right", F.lit(0).alias("kind")).unionByName(aliases.select("wrong", "right", F.lit(1).alias("kind"))).filter("wrong <> ''")
    known = known.select(first("wrong").alias("token"), entry)
    words = texts.select("doc_id", F.explode(F.array_distinct(F.concat(tokens(F.col("text")), F.array(F.lit(""))))).alias("token"))
    met = words.join(known, "token").groupBy("doc_id").agg(F.array_sort(F.collect_set("entry")).alias("_entries"))  # entries whose first word the text has
    edge = r"[\p{L}\p{N}_]"
    quoted = lambda w: F.concat(F.lit(rf"(?i)(?<!{edge})\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(rf"\E(?!{edge})"))
    literal = lambda r: F.replace(F.replace(r, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    folded = F.aggregate(F.col("_entries"), X.filled(F.col("text")), lambda t, e: F.regexp_replace(t, quoted(e["wrong"]), literal(e["right"])))
    return texts.join(met, "doc_id", "left").withColumn("text", F.when(F.col("_entries").isNull(), X.filled(F.col("text"))).otherwise(folded)).drop("_entries")


SPELLED = r"(?<![A-Za-z])(?:[A-Z](?:\s*,\s*|\s+)){1,7}[A-Z](?![A-Za-z])"


def spelled_acronyms(text: Column, acronyms: tuple[str, ...]) -> Column:
    """A text whose letters said one by one are written as the acronyms they spell.

    The whole run if it is one; else acronyms that cover it from the left, each exact or, from 3 letters on with the first two right, one letter off: the nearest, then the
    longest.  A run that two or more of them don't cover stays.
    """
    known = sorted({a for a in acronyms if a.isascii() and a.isalnum() and a.isupper() and 2 <= len(a) <= 8 and a[0].isalpha() and a != "OK"}, key=lambda a: (-len(a), a))
    if not known:
        return X.filled(text)
    every = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(a).alias("term"), F.lit(len(a)).alias("n")) for i, a in enumerate(known)])

    def best(spelled: Column, at: Column) -> Column:
        near = F.transform(every, lambda a: F.struct(F.levenshtein(F.substr(spelled, at, a["n"]), a["term"]).alias("off"), (-a["n"]).alias("size"), a["place"].alias("place"), a["term"].alias("term"), (F.length(F.substr(spelled, at, a["n"])) == a["n"]).alias("fits"), (F.substr(spelled, at, F.lit(2)) == F.substring(a["term"], 1, 2)).alias("starts")))
        return F.array_min(F.filter(near, lambda c: c["fits"] & ((c["off"] == 0) | ((c["off"] == 1) & (c["size"] <= -3) & c["starts"]))))

    def covered(run: Column) -> Column:
        spelled = F.regexp_replace(run, "[^A-Z]", "")
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("terms"), F.lit(True).alias("ok"))

        def step(s: Column, _: Column) -> Column:
            found = best(spelled, s["at"])
            ends = ~s["ok"] | (s["at"] > F.length(spelled))
            return F.when(ends, s).when(found.isNull(), F.struct(s["at"].alias("at"), s["terms"].alias("terms"), F.lit(False).alias("ok"))).otherwise(F.struct((s["at"] - found["size"]).alias("at"), F.concat(s["terms"], F.array(found["term"])).alias("terms"), F.lit(True).alias("ok")))

        cover = F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step)
        return F.when(spelled.isin(*known), spelled).otherwise(let(cover, lambda s: F.when(s["ok"] & (F.size(s["terms"]) >= 2), F.array_join(s["terms"], ", ")).otherwise(run)))

    runs = F.regexp_extract_all(X.filled(text), F.lit(SPELLED), F.lit(0))
    between = F.split(X.filled(text), SPELLED, -1)
    return let(F.struct(runs.alias("r"), between.alias("b")), lambda x: F.array_join(F.transform(x["b"], lambda piece, i: F.concat(piece, F.coalesce(covered(F.get(x["r"], i)), F.lit("")))), ""))
