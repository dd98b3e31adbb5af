"""Letters spelled out one by one, as the terms that a second text of the same speech has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let
from .texts import filled

#: Two to eight single letters with blanks or commas between them, in any case.
LETTERS = r"(?i)(?<![A-Za-z])(?:[A-Z](?:\s*,\s*|\s+)){1,7}[A-Z](?![A-Za-z])"
TERMS = r"\b[A-Z][A-Z0-9]{1,8}\b|\b[A-Z][a-z]+[A-Z][A-Za-z0-9]*\b"
LEAST, MOST = 2, 8


def plain_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def ordered_terms(text: Column, glossary: tuple[str, ...] = ()) -> Column:
    """Acronyms and camel-case names of a text in order, then the glossary's terms that it says, each once; OK is none."""
    found = F.filter(F.regexp_extract_all(filled(text), F.lit(TERMS), F.lit(0)), lambda w: F.upper(w) != "OK")
    said = F.concat(F.lit(" "), plain_key(filled(text)), F.lit(" "))
    known = [(t, " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split())) for t in sorted(set(glossary), key=str.lower)]
    more = F.array_compact(F.array(*[F.when(F.contains(said, F.lit(f" {key} ")), t) for t, key in known if key])) if known else F.array().cast("array<string>")
    return F.array_distinct(F.concat(found, more))


def term_for(letters: Column, terms: Column) -> Column:
    """The term that is spelled by letters (one upper-case word), or several that are one behind the other, or null.

    A term of the same letters goes first.  Else terms are taken from left to right, each at most once, with at most one wrong letter: the
    one with fewest wrong, then the longest, then the first.  All letters must be used, by two terms or more.
    """
    fits = F.filter(terms, lambda t: (F.upper(t) == t) & (F.lower(t) != t) & F.length(t).between(LEAST, MOST))

    def found(c: Column) -> Column:
        exact = F.get(F.filter(c, lambda t: t == letters), F.lit(0))

        def step(s: Column, _: Column) -> Column:
            tried = F.transform(c, lambda t, i: F.when(~F.array_contains(s["used"], i) & (F.length(letters) - s["at"] >= F.length(t)), F.struct(F.levenshtein(t, F.substring(letters, s["at"] + 1, F.length(t))).alias("d"), (-F.length(t)).alias("n"), i.alias("i"))))
            best = F.array_min(F.filter(tried, lambda x: x["d"] <= 1))
            grown = let(best, lambda b: F.struct((s["at"] - b["n"]).alias("at"), F.concat(s["used"], F.array(b["i"])).alias("used")))
            lost = F.struct(F.lit(-1).alias("at"), s["used"].alias("used"))
            return F.when((s["at"] < 0) | (s["at"] >= F.length(letters)), s).otherwise(F.when(F.exists(tried, lambda x: x["d"] <= 1), grown).otherwise(lost))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("used"))
        taken = F.aggregate(F.sequence(F.lit(1), F.lit(MOST // LEAST)), start, step)
        joined = let(taken, lambda s: F.when((s["at"] >= F.length(letters)) & (F.size(s["used"]) >= 2), F.array_join(F.transform(s["used"], lambda i: F.get(c, i)), ", ")))
        return F.when(F.size(c) > 0, F.coalesce(exact, joined))

    return let(fits, found)


def spelled_terms(text: Column, other: Column, glossary: tuple[str, ...] = ()) -> Column:
    """struct(text, rules): a text whose spelled letters are terms of another text, and what was replaced, the last first."""
    pieces = F.regexp_extract_all(filled(text), F.lit(LETTERS + r"|[\s\S]"), F.lit(0))

    def replaced(p: Column) -> Column:
        def judged(x: Column, terms: Column) -> Column:
            letters = F.upper(F.regexp_replace(x, "[^A-Za-z]", ""))
            to = F.when(F.length(x) > 1, let(letters, lambda w: term_for(w, terms)))
            return let(to, lambda t: F.struct(F.coalesce(t, x).alias("text"), F.when(t.isNotNull(), F.concat(F.lit("spelled:"), letters, F.lit("->"), t)).alias("rule")))

        each = let(ordered_terms(other, glossary), lambda terms: F.transform(p, lambda x: judged(x, terms)))
        return let(each, lambda e: F.struct(F.array_join(F.transform(e, lambda x: x["text"]), "").alias("text"), F.reverse(F.array_compact(F.transform(e, lambda x: x["rule"]))).alias("rules")))

    return let(pieces, replaced)
