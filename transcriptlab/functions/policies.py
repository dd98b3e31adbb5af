"""Column builders that decide about an update of a draft: by a detector, by policies of length and language, and in an audit afterwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let
from .newwords import new_roman, words_of
from .rules import INDIC
from .texts import filled, runaway, stripped

# Languages that are a risk by themselves; words that are content, style or neither, by use.
LANGUAGES = ("hi", "ur")
CONTENT_STOP = tuple(
    """
    aap aapko agar aisa aur bhai bhi dekh haan hai hain hoga humein kaam karna karne kuch kya matlab mein nahi par right sab saath that
    theek this thik uske vagairah what when which will with woh yaar yeh
    """.split()
)
SIGNALS = tuple("aap agar bhai haan hai hain kaise kya matlab nahi nahin theek toh yaar yeh".split())
COMMON = tuple(
    """
    about after again also because before being could does done from have into like maybe need okay only right same should some that then
    there thing this through what when where which will with work would your forth
    """.split()
)
ROMAN = tuple(
    """
    aap aapko agar aisa alag aur baat baatein bhai chaahie chahiye dekh doosra dusra haan hai hain hamara hamaara hamein hamen har hoga honi
    hota humein ismein ismen kaam kaise karega karenge karna karne karke karen kuch kuchh kya matlab mein nahi nahin paega payega payengi par
    saath sakta samajho teesra theek thik tisra uske vagairah vahi vah vo woh yaar yah yeh
    """.split()
)
STYLE = tuple("bhai dekh haan matlab na theek thik toh vah vahi vo woh ya yaar ye yeh".split())
SUBSTANCE = (*(w for w in ROMAN if w not in STYLE), *"bata hamein hamen havaavaaji hawabaazi paengi samjhaun".split())
SURE_ROUTES = ("hindi_stream_no_risk", "hindi_stream_rejected")


def plain_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(filled(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def detector_reason(chunk: Column, language: Column, probability: Column, low: float, early_low: float | None = None) -> Column:
    """Why a language detector's word on a chunk is a risk, or null: a language of risk, a weak guess, or weak English in the first chunk."""
    weak = F.coalesce(probability < low, F.lit(False))
    early = (chunk == 0) & F.coalesce(probability < early_low, F.lit(False)) if early_low is not None else F.lit(False)
    return (
        F.when(language.isin(*LANGUAGES), F.concat(F.lit("language:"), language))
        .when((language == "en") & weak, "english_low_confidence")
        .when((language == "en") & early, "english_early_low_confidence")
        .when((F.coalesce(language, F.lit("")) != "") & weak, F.concat(F.lit("non_english_low_confidence:"), language))
    )


def fits_length(draft: Column, final: Column) -> Column:
    n, m, a, b = F.size(plain_tokens(draft)), F.size(plain_tokens(final)), F.length(draft), F.length(final)
    short = (n >= 6) & (m < F.greatest(F.lit(3), F.floor(n / 3)))
    long = (n >= 6) & (m > F.greatest(n + 45, F.floor(n * 2.4)))
    return ~short & ~long & ~((a >= 40) & (b < F.floor(a / 3)))


def corrupted(text: Column) -> Column:
    return F.contains(text, F.lit("�")) | runaway(plain_tokens(text))


def style_only(draft: Column, final: Column) -> Column:
    """Whether a text is its draft with nothing but words of style put in, both of four words or more."""
    d, f = plain_tokens(draft), F.filter(plain_tokens(final), lambda w: ~w.isin(*STYLE))
    return (F.size(d) >= 4) & (F.size(f) >= 4) & (d == f)


def new_phrases(draft: Column, final: Column) -> Column:
    """Whether two different long English words of a text are new, or one that is new follows another."""
    content = lambda t: F.filter(plain_tokens(t), lambda w: w.rlike("^[a-z]{4,}$"))

    def judged(d: Column) -> Column:
        flags = F.transform(content(final), lambda w: F.struct(w.alias("w"), (~F.array_contains(d, w) & ~w.isin(*COMMON, *ROMAN)).alias("new")))
        run = lambda s: F.exists(F.transform(s, lambda x, i: x["new"] & F.coalesce(F.get(s, i + 1)["new"], F.lit(False))), lambda x: x)
        return let(flags, lambda s: run(s) | (F.size(F.array_distinct(F.transform(F.filter(s, lambda x: x["new"]), lambda x: x["w"]))) >= 2))

    return let(content(draft), judged)


def substance(text: Column) -> Column:
    """Number of different roman Hindi words that carry something."""
    return F.size(F.array_distinct(F.filter(plain_tokens(text), lambda w: w.isin(*SUBSTANCE))))


def update_policies(draft: Column, final: Column) -> Column:
    """struct(polish, server_safe, audio_risk): whether each policy lets a text replace a draft; none does for empty or equal texts."""
    sides = F.struct(stripped(draft).alias("a"), stripped(final).alias("b"))

    def judged(s: Column) -> Column:
        a, b = s["a"], s["b"]
        there = (a != "") & (b != "") & (a != b) & ~corrupted(b) & fits_length(a, b)
        signal = b.rlike(INDIC) | F.lower(b).rlike(r"(?U)\b(" + "|".join(SIGNALS) + r")\b")
        least = F.when(substance(b) >= 4, 0.35).otherwise(0.55)
        long = lambda t: F.array_distinct(F.filter(plain_tokens(t), lambda w: F.length(w) >= 3))
        kept = let(long(a), lambda d: F.when(F.size(d) == 0, 1.0).otherwise(F.size(F.array_intersect(d, long(b))) / F.greatest(F.size(d), F.lit(1))))
        style = style_only(a, b)
        return F.struct(
            (there & signal & ~style & ~new_phrases(a, b)).alias("polish"),
            there.alias("server_safe"),
            (there & (b.rlike(INDIC) | (substance(b) >= 2)) & ~style & (kept >= least)).alias("audio_risk"),
        )

    return let(sides, judged)


def named_terms(text: Column) -> Column:
    """Acronyms and camel-case names of a text in lower case, sorted; a possessive ending doesn't count."""
    raw = F.transform(F.regexp_extract_all(filled(text), F.lit(r"(?U)\b[A-Za-z][A-Za-z0-9]*(?:'[A-Za-z]+)?\b"), F.lit(0)), lambda w: F.substring_index(w, "'", 1))
    good = lambda w: w.rlike("^[A-Z0-9]{2,}$") | w.rlike("^(?=.{4})[A-Z].*[A-Z]")
    return F.array_sort(F.array_distinct(F.transform(F.filter(raw, good), F.lower)))


def replacement_audit(draft: Column, final: Column, safe: Column, route: Column) -> Column:
    """struct(decision, confidence, retained, new, missing): what an audit says of an update that was taken (safe) or not.

    keep_fast if it wasn't.  reject_drop if a named term went or too much content, unless five new words of Hindi stand for it;
    save_alternate if hardly anything is new; replace_candidate if enough is kept; else needs_review.
    """
    content = lambda t: F.array_distinct(F.filter(words_of(t), lambda w: (F.length(w) >= 4) & ~w.isin(*CONTENT_STOP)))
    taken = F.coalesce(safe, F.lit(False))
    text = F.when(taken, filled(final)).otherwise(filled(draft))
    facts = F.struct(content(draft).alias("d"), content(text).alias("f"), F.size(F.array_except(named_terms(draft), named_terms(text))).alias("lost"), F.size(new_roman(draft, text)).alias("value"))

    def judged(x: Column) -> Column:
        kept = F.when(F.size(x["d"]) == 0, 1.0).otherwise(F.size(F.array_intersect(x["d"], x["f"])) / F.greatest(F.size(x["d"]), F.lit(1)))
        new, missing = F.array_except(x["f"], x["d"]), F.size(F.array_except(x["d"], x["f"]))
        minor = F.forall(new, lambda w: w.isin(*CONTENT_STOP) | (F.length(w) <= 4))

        def decided(r: Column) -> Column:
            n = F.size(new)
            pair = lambda a, b: F.struct(F.lit(a).alias("decision"), F.lit(b).alias("confidence"))
            known = route.isin(*SURE_ROUTES)
            verdict = (
                F.when(~taken & F.coalesce(known, F.lit(False)), pair("keep_fast", "high"))
                .when(~taken, pair("keep_fast", "medium"))
                .when(x["lost"] > 0, pair("reject_drop", "high"))
                .when((r < 0.78) & (r >= 0.65) & (x["value"] >= 5), pair("replace_candidate", "medium"))
                .when(r < 0.78, pair("reject_drop", "medium"))
                .when((n == 0) & (r >= 0.95), pair("save_alternate", "high"))
                .when((n <= 2) & (r >= 0.90) & minor, pair("save_alternate", "medium"))
                .when(r >= 0.82, pair("replace_candidate", "medium"))
                .otherwise(pair("needs_review", "low"))
            )
            return let(verdict, lambda v: F.struct(v["decision"].alias("decision"), v["confidence"].alias("confidence"), F.round(r, 3).alias("retained"), n.alias("new"), missing.alias("missing")))

        return let(kept, decided)

    return let(facts, judged)
