"""Second passes that may replace a draft, with repairs for those that only their new words keep from it.

Words that a second pass got nearly right are set to the draft's: words of both are joined by row and first letter, those of like lengths are
compared, and each takes its best.  Then words that no rule knows are taken out, what the draft shows to be lost is put back, and the
text is judged anew, once more after a second removal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import newwords as N
from ..functions.alignment import likeness
from ..functions.columns import let
from ..functions.roman import one_spelling, romanized
from ..functions.texts import filled, stripped
from ..sources.io import settled
from .merging import plain_word, plain_words

# Words that aren't content, how near a word must be, and after how many new words nothing is repaired.
TAIL_STOP = ("the", "and", "for", "that", "this", "with", "from", "should", "would", "could", "there", "right", "like")
NEAR, PREFIX, PREFIX_SCORE, MOST = 0.72, 4, 0.76, 6
PIECES = r"(?U)\b[A-Za-z][A-Za-z']*\b|[\s\S]"


def squeezed(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"([a-z0-9])\1+", "$1")


def near_words(rows: DataFrame, key: str, draft: str, tokens: str) -> DataFrame:
    """(key, token, word): for tokens (an array, lower case) of a row the draft's word that each stands for, if one is near.

    A token, without a plural s, and without doubled letters, is equal to such a form of the word; else it has its first letter, at most
    two letters more or less, and a likeness of NEAR; four equal letters at the start count as PREFIX_SCORE.  Ties go to the draft's first.
    """
    said = rows.select(key, F.posexplode(F.regexp_extract_all(filled(F.col(draft)), F.lit(r"(?U)\b[A-Za-z][A-Za-z0-9']*\b"), F.lit(0))).alias("place", "word"))
    forms = lambda w: F.array(plain_word(w), squeezed(plain_word(w)))
    keys = said.select(key, "place", "word", F.posexplode(forms(F.col("word"))).alias("step", "form")).filter((F.length(plain_word(F.col("word"))) >= 3) & (F.length("form") >= 3))
    keys = keys.groupBy(key, "form").agg(F.min(F.struct("place", "step", "word")).alias("first")).select(key, "form", "first.place", "first.step", "first.word")
    own = rows.select(key, F.explode(F.array_distinct(F.filter(tokens, lambda t: F.length(t) >= 4))).alias("token"))
    asked = own.select(key, "token", F.posexplode(F.array_distinct(F.concat(F.array("token"), forms(F.col("token"))))).alias("order", "variant")).filter(F.length("variant") >= 3)
    equal = asked.join(keys.withColumnRenamed("form", "variant"), [key, "variant"]).select(key, "token", "order", "place", "step", "word", F.lit(2.0).alias("score"))
    initial = lambda c: F.substring(c, 1, 1)
    close = asked.withColumn("initial", initial(F.col("variant"))).join(keys.filter(F.length("form") >= 4).withColumn("initial", initial(F.col("form"))), [key, "initial"])
    close = close.filter(F.abs(F.length("variant") - F.length("form")) <= 2).filter("variant <> form")
    start = F.when(F.substring("variant", 1, PREFIX) == F.substring("form", 1, PREFIX), PREFIX_SCORE).otherwise(0.0)
    scored = close.withColumn("score", F.greatest(likeness(F.col("variant"), F.col("form")), start)).filter(F.col("score") >= NEAR)
    found = equal.unionByName(scored.select(key, "token", "order", "place", "step", "word", "score"))
    best = found.groupBy(key, "token").agg(F.max_by("word", F.struct("score", -F.col("order"), -F.col("place"), -F.col("step"))).alias("word"))
    return best.filter(F.lower("word") != F.col("token"))


def replaced(text: Column, words: Column) -> Column:
    """struct(text, rules): a text with words replaced by a map from lower case, and what was replaced in order."""

    def done(p: Column) -> Column:
        to = lambda w: F.try_element_at(words, F.lower(w))
        rules = F.transform(F.filter(p, lambda w: to(w).isNotNull()), lambda w: F.concat(F.lit("draft-near-match:"), w, F.lit("->"), to(w)))
        return F.struct(F.array_join(F.transform(p, lambda w: F.coalesce(to(w), w)), "").alias("text"), rules.alias("rules"))

    return let(F.regexp_extract_all(filled(text), F.lit(PIECES), F.lit(0)), done)


def without(text: Column, words: Column) -> Column:
    """struct(text, removed): a text without words (an array, lower case), and those as they stood."""

    def done(p: Column) -> Column:
        gone = lambda w: F.array_contains(words, F.lower(w))
        left = F.array_join(F.filter(p, lambda w: ~gone(w)), "")
        tidy = stripped(F.regexp_replace(F.regexp_replace(left, r"(?U)\s+([,.!?;:])", "$1"), r"(?U)\s{2,}", " "))
        return F.struct(tidy.alias("text"), F.filter(p, gone).alias("removed"))

    return let(F.regexp_extract_all(filled(text), F.lit(PIECES), F.lit(0)), done)


def completed(draft: Column, text: Column) -> Column:
    """A text whose last two to six words the draft has before its last one to three, with these; the fewest missing, then the longest match."""
    raw = F.filter(F.regexp_extract_all(filled(draft), F.lit("[A-Za-z0-9']+"), F.lit(0)), lambda w: plain_word(w) != "")
    sides = F.struct(raw.alias("raw"), plain_words(filled(draft)).alias("d"), plain_words(filled(text)).alias("t"))

    def done(s: Column) -> Column:
        n, m = F.size(s["d"]), F.size(s["t"])
        fits = lambda gone, shared: (n > gone + 1) & (shared <= m) & (shared <= n - gone) & (F.slice(s["t"], F.greatest(m - shared + 1, F.lit(1)), F.lit(shared)) == F.slice(s["d"], F.greatest(n - gone - shared + 1, F.lit(1)), F.lit(shared)))
        tries = [F.when(fits(gone, shared), gone) for gone in (1, 2, 3) for shared in range(6, 1, -1)]
        base = F.regexp_replace(filled(text), r"(?U)\s+$", "")
        mark = F.regexp_extract(base, r"([.!?])$", 1)
        bare = F.regexp_replace(F.regexp_replace(base, r"[.!?]$", ""), r"(?U)\s+$", "")
        lost = lambda gone: F.array_join(F.slice(s["raw"], n - gone + 1, gone), " ")
        whole = lambda gone: F.concat(F.when(mark == "", base).otherwise(bare), F.lit(" "), lost(gone), F.when(mark == "", ".").otherwise(mark))
        return let(F.coalesce(*tries), lambda gone: F.when((n >= 4) & (m >= 3) & gone.isNotNull(), whole(gone)).otherwise(filled(text)))

    return let(sides, done)


def backed_repairs(draft: Column, text: Column) -> Column:
    """struct(text, rules): a text with what its draft shows to have been lost put back."""
    said = F.array_join(plain_words(filled(draft)), " ")
    well = F.contains(F.lower(filled(draft)), F.lit("api layer functions well")) | F.contains(said, F.lit("api layer function well"))

    def step(x: Column, on: Column, to: Column, rule: str) -> Column:
        after = F.when(on, to).otherwise(x["text"])
        return let(after, lambda t: F.struct(t.alias("text"), F.when(t != x["text"], F.concat(x["rules"], F.array(F.lit(rule)))).otherwise(x["rules"]).alias("rules")))

    first = F.struct(filled(text).alias("text"), F.array().cast("array<string>").alias("rules"))
    out = let(first, lambda x: step(x, well, F.regexp_replace(x["text"], r"(?iU)\b(API layer functions)\s+(?:ve|we|mein)\b", "$1 well"), "draft-backed-api-functions-well"))
    out = let(out, lambda x: step(x, F.contains(said, F.lit("agent will")), F.regexp_replace(x["text"], r"(?iU)\b(one|doosra|dusra|dusara|teesra|tisra|tisara)\s+will\b", "$1 agent will"), "draft-backed-agent-will"))
    out = let(out, lambda x: step(x, F.lit(True), completed(draft, x["text"]), "draft-backed-tail-completion"))
    return let(out, lambda x: F.struct(stripped(F.regexp_replace(x["text"], r"(?U)\s{2,}", " ")).alias("text"), x["rules"].alias("rules")))


def dangling(text: Column) -> Column:
    said = F.trim(F.regexp_replace(F.lower(filled(text)), r"(?U)\s+", " "))
    return said.rlike(r"\band so on and so(?:\s+forth)?\s+(?:the|a|an|this|that)\b") | said.rlike(r"\b(?:and|or|so|but)\s*[,.!?;:]*$")


def _content(text: Column) -> Column:
    return F.filter(plain_words(filled(text)), lambda w: (F.length(w) >= 4) & ~w.isin(*TAIL_STOP))


def staged(rows: DataFrame, most_seconds: float, glossary: tuple[str, ...] = (), key: str = "id") -> DataFrame:
    """rows (key, draft, candidate, seconds, ...) with accepted, text, reasons, outcome, removed and rules.

    outcome: "accepted" as it is; "repaired" and then accepted; "no-removable", "too-many" or "unchanged" if no repair was tried or
    had anything to do, with the reasons it was rejected for; else "rejected" with those of the repaired text.  key must be unique.
    """
    draft, no = F.col("draft"), F.array().cast("array<string>")
    reject = lambda text: N.reject_reasons(draft, text, F.col("seconds"), most_seconds, glossary=glossary)
    held = rows.withColumn("_c", one_spelling(stripped(F.col("candidate")))).withColumn("_r", one_spelling(romanized(F.col("_c"))))
    held = settled(held.withColumn("_why", reject(F.col("_c"))))
    held = settled(held.withColumn("_why", F.when((F.size("_why") == 0) & (F.col("_r") != F.col("_c")), reject(F.col("_r"))).otherwise(F.col("_why"))))
    judged = lambda text: F.when(F.size(N.new_roman(draft, text)) == 0, F.array(F.lit("no-hindi-value"))).otherwise(N.meaning_kept(draft, text))
    held = settled(held.withColumn("_why", F.when(F.size("_why") == 0, judged(F.col("_c"))).otherwise(F.col("_why"))))
    held = held.withColumn("_new", N.named_words(F.col("_why")))
    blocked = lambda why, but: F.exists(why, lambda r: ~r.rlike("^(" + "|".join((*N.NEW, *but)) + ")"))
    kind = (
        F.when(F.size("_why") == 0, "accepted")
        .when((F.size("_new") == 0) | blocked(F.col("_why"), ("protected-term-missing:", "protected-term-new:")), "no-removable")
        .when(F.size("_new") > MOST, "too-many")
    )
    # a row's stages are written between, as each looks at the text of the one before many times
    held = settled(held.withColumn("_kind", kind))

    open_ = held.filter("_kind IS NULL")
    near = near_words(open_, key, "draft", "_new").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "word"))).alias("_words"))
    open_ = open_.join(near, key, "left").withColumn("_set", replaced(F.col("_r"), F.coalesce("_words", F.create_map().cast("map<string,string>"))))
    open_ = settled(open_.withColumn("_cut", without(F.col("_set.text"), F.col("_new"))).withColumn("_fix", backed_repairs(draft, F.col("_cut.text"))))
    open_ = open_.withColumn("_rules", F.concat("_set.rules", "_fix.rules")).withColumn("_out", F.col("_cut.removed")).withColumn("_text", F.col("_fix.text"))
    same = (F.size("_out") == 0) & (F.size("_rules") == 0) & (stripped(F.col("_text")) == stripped(F.col("_r")))
    open_ = open_.withColumn("_kind", F.when(same, "unchanged"))
    # judged anew, and once more without the words that this brings up
    open_ = settled(open_.withColumn("_again", reject(F.col("_text"))))
    more = N.named_words(F.col("_again"))
    tries = (F.size("_more") > 0) & ~blocked(F.col("_again"), ()) & (F.size("_out") + F.size("_more") <= MOST)
    open_ = open_.withColumn("_more", more).withColumn("_cut", F.when(tries, without(F.col("_text"), F.col("_more"))))
    open_ = settled(open_.withColumn("_other", F.coalesce((F.size("_cut.removed") > 0) & (stripped(F.col("_cut.text")) != stripped(F.col("_text"))), F.lit(False))))
    open_ = open_.withColumn("_out", F.concat("_out", F.coalesce("_cut.removed", no))).withColumn("_text", F.when(F.col("_other"), F.col("_cut.text")).otherwise(F.col("_text")))
    open_ = settled(open_.withColumn("_again", F.when(F.col("_other"), reject(F.col("_text"))).otherwise(F.col("_again"))))
    bare = (F.size("_out") >= 3) & ~F.exists("_rules", lambda r: r.rlike("^(draft-backed-|draft-near-match:)"))
    few = ~((F.size("_out") == 0) & (F.size("_rules") > 0)) & (F.size(_content(F.col("_text"))) < 4) & (F.size(F.array_intersect(_content(F.col("_text")), _content(draft))) < 3)
    last = (
        F.when(F.size("_again") > 0, F.col("_again"))
        .when(dangling(F.col("_text")), F.array(F.lit("dangling-transition")))
        .when(bare, F.array(F.lit("unsupervised-multi-token-removal")))
        .when(F.size(N.new_roman(draft, F.col("_text"))) == 0, F.array(F.lit("no-hindi-value")))
        .when(few, F.array(F.lit("over-sanitized-low-content")))
        .otherwise(N.meaning_kept(draft, F.col("_text")))
    )
    open_ = settled(open_.withColumn("_last", last)).withColumn("outcome", F.coalesce("_kind", F.when(F.size("_last") == 0, "repaired").otherwise("rejected")))

    good, tried = F.col("outcome").isin("accepted", "repaired"), F.col("outcome").isin("repaired", "rejected")
    why = F.when(good, no).when(F.col("outcome") == "rejected", F.col("_last")).otherwise(F.col("_why"))
    text = F.when(F.col("outcome") == "repaired", F.col("_text")).otherwise("")
    repaired = open_.select(*rows.columns, good.alias("accepted"), text.alias("text"), why.alias("reasons"), "outcome", F.when(tried, F.col("_out")).otherwise(no).alias("removed"), F.when(tried, F.col("_rules")).otherwise(no).alias("rules"))
    done = held.filter("_kind IS NOT NULL").withColumn("outcome", F.col("_kind"))
    plain = done.select(*rows.columns, good.alias("accepted"), F.when(good, F.col("_r")).otherwise("").alias("text"), F.col("_why").alias("reasons"), "outcome", no.alias("removed"), no.alias("rules"))
    return plain.unionByName(repaired)
