"""Dictated text made readable by ordered rules, each recorded if it changed something, and all taken back if the result isn't safe."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let
from .meaning import listed
from .rules import MIXED_MARKERS
from .texts import filled

# Words that dictation is full of, and boundaries at which a sentence ends.
FILLERS = ("okay", "ok", "so", "uh", "um", "basically")
REPEATED = ("okay", "ok", "yeah", "yes", "right", "like", "basically")
PHRASES = (("you", "know"), ("i", "mean"))
KEPT_PHRASES = ("you know", "I mean")
STOP = ("and", "the", "for", "with", "that", "this", "then", "but")
SOFT = "(like|right|okay|ok|yeah)"
BOUNDARIES = {
    "but": "But",
    r"so\s+the\s+question\s+is(?:\s+that)?": "So the question is",
    r"the\s+first\s+thing\s+is(?:\s+that)?": "The first thing is",
    r"the\s+second\s+thing\s+is(?:\s+that)?": "The second thing is",
    r"another\s+thing\s+is(?:\s+that)?": "Another thing is",
    r"for\s+example": "For example",
}
CASED = (r"\b[A-Za-z0-9][A-Za-z0-9-]*\.[A-Za-z]{2,}\b", r"\b[A-Za-z]+[0-9][A-Za-z0-9]*\b", r"\b[A-Za-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*\b", r"\b[A-Z][A-Z0-9]{1,9}s?\b")
FOREIGN = r"[\x{0900}-\x{097F}\x{0600}-\x{06FF}\x{4E00}-\x{9FFF}]"
#: How much longer and shorter a rewritten text may be: letters more, or a share of the text.
MORE, LONGEST, SHORTEST = 24, 1.18, 0.75


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))


def plain_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def mixed_language(text: Column) -> Column:
    return text.rlike(FOREIGN) | F.arrays_overlap(plain_tokens(text), listed(MIXED_MARKERS))


def _replace(*steps: tuple[str, str]) -> Callable[[Column], Column]:
    return lambda t: reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, t)


_soft_but = _replace((rf"(?iU)\b{SOFT}\.\s+But\s+", "$1, but "), (rf"(?iU)\b{SOFT}[,.]?\s+but\s+", "$1, but "))


def _without_leading_fillers(text: Column) -> Column:
    return spaced(F.regexp_replace(text, r"(?iU)^(?:\s*(?:" + "|".join(sorted(FILLERS, key=len, reverse=True)) + r")[\s,]+)+", ""))


def _without_repeats(text: Column) -> Column:
    return spaced(_replace(*[(rf"(?iU)\b{said}(?:[\s,]+{said}\b)+", said) for said in (*KEPT_PHRASES, *REPEATED)])(text))


def _split_and_then(text: Column) -> Column:
    return F.when(word_count(text) >= 5, F.regexp_replace(text, r"(?iU)(?<![.?!:]),?\s+and then\s+", ". Then ")).otherwise(text)


def _split_discourse(text: Column) -> Column:
    split = _replace(*[(rf"(?iU)(?<![.?!:]),?\s+({said})\s+", f". {to} ") for said, to in BOUNDARIES.items()])
    return let(_soft_but(text), lambda t: F.when(word_count(text) < 10, spaced(t)).otherwise(spaced(_soft_but(split(t)))))


def _capitals(text: Column) -> Column:
    """A letter at the start, or with nothing but white space between it and the end of a sentence, as a capital."""
    pieces = F.regexp_extract_all(F.concat(F.lit("."), text), F.lit(r"[.?!](?U:\s*)\p{L}|[\s\S]"), F.lit(0))
    return F.substring(F.array_join(F.transform(pieces, lambda p: F.when(F.length(p) > 1, F.upper(p)).otherwise(p)), ""), F.lit(2), F.lit(2**31 - 1))


def _ended(text: Column) -> Column:
    bare = F.trim(text)
    return F.when(bare.rlike(r"[.?!:]$") | (bare == ""), text).when(bare.endswith(","), F.concat(F.regexp_replace(bare, ",$", ""), F.lit("."))).otherwise(F.concat(text, F.lit(".")))


def cased_tokens(text: Column) -> Column:
    """Names, file names and acronyms of a text, each once whatever its case, by kind and then in order."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in CASED]))
    return let(found, lambda f: F.filter(f, lambda w, i: F.array_position(F.transform(f, F.lower), F.lower(w)) == i + 1))


def _cases_of(original: Column) -> Callable[[Column], Column]:
    def restored(text: Column) -> Column:
        found = lambda w: F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])\Q"), w, F.lit(r"\E(?![A-Za-z0-9])"))
        return F.aggregate(cased_tokens(original), text, lambda t, w: F.regexp_replace(t, found(w), w))

    return restored


def structure_tokens(text: Column, leading: bool) -> Column:
    """A text's words without what the rules may take: fillers at the start, the and before then, a filler or phrase said again."""
    words = plain_tokens(text)
    if leading:
        own = lambda w: F.coalesce(F.array_min(F.filter(F.transform(w, lambda x, i: F.when(~x.isin(*FILLERS), i)), lambda i: i.isNotNull())), F.size(w))
        words = let(words, lambda w: F.slice(w, own(w) + 1, F.greatest(F.size(w), F.lit(1))))
    words = let(words, lambda w: F.filter(w, lambda x, i: ~((x == "and") & F.coalesce(F.get(w, i + 1) == "then", F.lit(False)))))

    def taken(w: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            word, out = F.element_at(w, i), s["out"]
            n = F.size(out)
            last = lambda k: F.try_element_at(out, F.when(n >= k, n - k + 1))
            again = reduce(lambda a, b: a | b, [(word == p[0]) & F.coalesce(F.try_element_at(w, i + 1) == p[1], F.lit(False)) & F.coalesce((last(2) == p[0]) & (last(1) == p[1]), F.lit(False)) for p in PHRASES])
            repeat = word.isin(*REPEATED) & F.coalesce(last(1) == word, F.lit(False))
            kept = F.when(again | repeat, out).otherwise(F.concat(out, F.array(word)))
            return F.when(i < s["next"], s).otherwise(F.struct(kept.alias("out"), F.when(again, i + 2).otherwise(i + 1).alias("next")))

        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(1).alias("next"))
        return F.when(F.size(w) == 0, w).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), start, step, lambda s: s["out"]))

    return let(words, taken)


def structure_safe(draft: Column, final: Column) -> Column:
    """Whether a rewritten text may stand for a draft: neither empty nor the same, of like length, the same words, no sentence split badly."""
    a, b = spaced(filled(draft)), spaced(filled(final))
    n, m = F.length(a), F.length(b)
    content = lambda t: F.filter(plain_tokens(t), lambda w: (F.length(w) >= 3) & ~w.isin(*FILLERS, *STOP))
    fits = (m <= F.greatest(n + MORE, F.floor(n * LONGEST))) & (m >= F.greatest(F.lit(2), F.floor(n * SHORTEST)))
    awkward = b.rlike(rf"(?iU)\b{SOFT}\.\s+But\b") | b.rlike(r"(?iU)\bnot\s+only\b.*\.\s+But\b")
    enough = word_count(b) >= F.greatest(F.lit(2), F.least(F.lit(4), word_count(a)))
    same = structure_tokens(a, True) == structure_tokens(b, False)
    return (a != "") & (b != "") & (a != b) & fits & same & (F.size(F.array_except(content(a), content(b))) == 0) & enough & ~awkward


def structured(text: Column) -> Column:
    """struct(text, changed, rules): a text by the rules, in order; as it is, white space apart, in several languages or if the result isn't safe."""
    original = spaced(filled(text))
    rules: dict[str, Callable[[Column], Column]] = {
        "trim_leading_filler": _without_leading_fillers,
        "capitalize_i": _replace((r"(?iU)\bi\b", "I")),
        "collapse_repeated_fillers": _without_repeats,
        "split_and_then": _split_and_then,
        "split_discourse_boundary": _split_discourse,
        "punctuation_spacing": _replace((r"(?U)\s+([,?.!])", "$1")),
        "punctuation_artifacts": _replace((",([?.!])", "$1"), ("([?.!]),", "$1")),
        "capitalize_sentence": _capitals,
        "terminal_punctuation": _ended,
    }
    none = F.array().cast("array<string>")

    def step(x: Column, name: str, work: Callable[[Column], Column]) -> Column:
        return let(x, lambda s: let(work(s["text"]), lambda t: F.struct(t.alias("text"), F.when(t != s["text"], F.concat(s["rules"], F.array(F.lit(name)))).otherwise(s["rules"]).alias("rules"))))

    def rewritten(first: Column) -> Column:
        x = F.struct(first.alias("text"), none.alias("rules"))
        for name, work in (rules | {"preserve_case_sensitive_tokens": _cases_of(first)}).items():
            x = step(x, name, work)
        plain = F.struct(first.alias("text"), F.lit(False).alias("changed"), none.alias("rules"))
        done = lambda s: let(spaced(s["text"]), lambda t: F.when(structure_safe(first, t), F.struct(t.alias("text"), (t != first).alias("changed"), s["rules"].alias("rules"))).otherwise(plain))
        return F.when((first == "") | mixed_language(first), plain).otherwise(let(x, done))

    return let(original, rewritten)
