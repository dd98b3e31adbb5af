"""Column builders that clean, classify and compare texts.  Null texts count as empty; everything but repeats stays in JVM expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import TOKEN, _coded, let, longest_copies, stretches, tokens

#: White space that both Java's and other regular expressions know by these codes.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

# Markers of a recording without speech, once brackets and case are gone.
NO_SPEECH = ("blank", "blank audio", "silence", "silent audio", "no speech", "no speech detected", "inaudible", "music", "noise")
# Verbs whose short negation is written out, and number words with their digits, in order.
NEGATED = {"do": "do", "does": "does", "is": "is", "was": "was", "are": "are", "were": "were", "ca": "can", "could": "could", "would": "would", "should": "should", "must": "must", "wo": "will", "ai": "is"}
NUMBERS = {"thirty": "30", "ten": "10", "three": "3", "twenty one": "21", "twenty four": "24"}


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def stripped(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(filled(text), rf"^{BLANK}|{BLANK}$", "")


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(filled(text), F.lit(WORD), F.lit(0))


def plain_spacing(text: Column) -> Column:
    """Noise markers, caption tags and cue times out; runs of blanks become one, runs of newlines two at most."""
    text = F.regexp_replace(filled(text), r"(?i)\[(BLANK_AUDIO|MUSIC|NOISE|SILENCE|INAUDIBLE)\]", " ")
    text = F.regexp_replace(text, "<v[^>]*>|</v>", "")
    text = F.regexp_replace(text, r"[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]+ +--> +[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"\bWEBVTT\b", " "), r"[ \t]+", " ")
    return stripped(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def caption_text(text: Column) -> Column:
    """Tags, bracketed sounds and sung passages out, white space joined."""
    return stripped(F.regexp_replace(F.regexp_replace(filled(text), r"<[^>]+>|\[[^\]]*\]|♪[^♪]*♪", " "), BLANK, " "))


def without_markers(text: Column) -> Column:
    """Control markers of recognisers, ``<|...|>``, out."""
    return stripped(F.regexp_replace(filled(text), r"<\|[^|]*\|>", ""))


def effective_text(*choices: Column) -> Column:
    """The first of the texts that isn't blank, else an empty one."""
    return F.coalesce(*[F.nullif(stripped(c), F.lit("")) for c in choices], F.lit(""))


def spoken_form(text: Column) -> Column:
    """Lower case; short negations written out, number words as digits, everything else than a-z and 0-9 a blank."""
    text = F.lower(filled(text))
    for verb, full in NEGATED.items():
        text = F.regexp_replace(text, rf"\b{verb} *n *['’]? *t\b", f"{full} not")
    text = F.regexp_replace(text, r"\bcannot\b", "can not")
    for word, digits in NUMBERS.items():
        text = F.replace(text, F.lit(word), F.lit(digits))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def script_class(text: Column) -> Column:
    """latin, devanagari, mixed or other."""
    indic, latin = filled(text).rlike(r"[\x{0900}-\x{097F}]"), filled(text).rlike("[A-Za-z]")
    return F.when(indic & latin, "mixed").when(indic, "devanagari").when(latin, "latin").otherwise("other")


def pool_bucket(category: Column, language: Column, region: Column) -> Column:
    """The pool of a clip by its language and kind; for clips of videos by region, too."""
    category, language, region = F.lower(filled(category)), F.lower(filled(language)), F.lower(filled(region))
    chinese = language.rlike("zh|cmn|mandarin|chinese") | category.rlike("fleurs_cmn|chinese")
    hinglish = category.contains("hinglish") | language.contains("hi-en") | (category.contains("hindi") & category.contains("english"))
    hindi = category.contains("hindi") | language.isin("hi", "hi_in", "hindi")
    return (
        F.when(chinese & (category.contains("english") | language.contains("en")), "chinese_english_code_switch")
        .when(chinese, "chinese_public")
        .when(hinglish, "hinglish_code_switch")
        .when(hindi, "hindi_public")
        .when(category.contains("youtube") & (region != ""), F.concat(F.lit("english_youtube_"), F.replace(region, F.lit(" "), F.lit("_"))))
        .otherwise("english_public")
    )


def no_speech(text: Column) -> Column:
    """Whether a text is blank or only a marker of silence."""
    low = F.lower(stripped(text))
    bare = F.regexp_replace(F.regexp_replace(low, r"^[\[\](){}<>._\- ]+|[\[\](){}<>._\- ]+$", ""), r"[_\x20\x09-\x0D]+", " ")
    return (low == "") | (low == "<|nospeech|>") | F.trim(bare).isin(*NO_SPEECH)


def blank(text: Column) -> Column:
    """Whether a text has nothing but white space; the first other letter tells."""
    return ~filled(text).rlike(r"[^\x20\x09-\x0D]")


SCORES = T.StructType([T.StructField(n, T.IntegerType()) for n in ("words", "copied_words", "letters", "copied_letters")])


@F.arrow_udf(SCORES)
def _copies(words: pa.Array, low: pa.Array) -> pa.Array:
    out = []
    size = pc.fill_null(pc.binary_length(low), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for some in stretches(size, 8_000_000):
        ((codes, sizes),) = _coded(words[some])
        raw, n = np.frombuffer("".join(low[some].to_pylist()).encode(), np.uint8), size[some]
        plain = (raw >= 97) & (raw <= 122)
        letters = np.diff(np.append(0, np.cumsum(plain))[np.append(0, np.cumsum(n))])
        figures = (sizes, longest_copies(codes, sizes, range(2, 9)), letters, longest_copies(raw[plain], letters, range(3, 16)))
        out.append(pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in figures], SCORES.names))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([(n, pa.int32()) for n in SCORES.names]))


def repeated_substring_score(text: Column) -> Column:
    """The repeated n-gram score, or the largest share of letters in three or more copies of a block of 3 to 15 letters."""

    def score(x: Column) -> Column:
        words = F.when(x["words"] < 8, 0.0).otherwise(F.round(x["copied_words"] / x["words"], 3))
        return F.round(F.greatest(words, F.when(x["letters"] < 24, 0.0).otherwise(x["copied_letters"] / x["letters"])), 3)

    return score(_copies(tokens(text), F.lower(filled(text))))


def degenerate(text: Column, most: float = 0.25) -> Column:
    return blank(text) | (repeated_substring_score(text) >= most)


def top_token_share(words: Column) -> Column:
    """Share of the most frequent word; 0 without words."""
    def longest_run(ordered: Column) -> Column:
        # equal words stand together once sorted
        start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("n"), F.lit(0).alias("best"))

        def step(s: Column, w: Column) -> Column:
            n = F.when(s["word"] == w, s["n"] + 1).otherwise(1)
            return F.struct(w.alias("word"), n.alias("n"), F.greatest(s["best"], n).alias("best"))

        return F.when(F.size(ordered) == 0, 0.0).otherwise(F.aggregate(ordered, start, step, lambda s: s["best"]) / F.size(ordered))

    return let(F.array_sort(words), longest_run)


def runaway(words: Column, widths: tuple[int, ...] = (1, 2, 3, 4)) -> Column:
    """Whether a block of 1 to 4 words stands three times in a row."""

    def thrice(words: Column, z: int) -> Column:
        n = F.size(words)
        starts = F.when(n >= 3 * z, F.sequence(F.lit(1), n - 3 * z + 1)).otherwise(F.array().cast("array<int>"))
        block = lambda i, k: F.slice(words, i + k * z, F.lit(z))
        # the first words tell nearly always, without blocks being made
        first = lambda i, k: F.get(words, i + k * z - 1)
        return F.exists(starts, lambda i: first(i, 0).eqNullSafe(first(i, 1)) & first(i, 1).eqNullSafe(first(i, 2)) & (block(i, 0) == block(i, 1)) & (block(i, 1) == block(i, 2)))

    return let(words, lambda w: reduce(or_, [thrice(w, z) for z in widths]))


def looped(words: Column, widths: tuple[int, ...] = (1, 2, 3, 4)) -> Column:
    """The same by Arrow batches, for use outside of lambdas: each word is compared with the next by numbers, once for each width."""

    @F.arrow_udf("boolean")
    def thrice(lists: pa.Array) -> pa.Array:
        ((codes, sizes),) = _coded(lists)
        return pa.array(longest_copies(codes, sizes, widths) > 0)

    return thrice(words)


def overlap(a: Column, b: Column, of: str = "max") -> Column:
    """Distinct words that two arrays share, by the larger (max) or smaller (min) set, to 3 digits; null if one is empty."""

    def share(a: Column, b: Column) -> Column:
        n, m = F.size(a), F.size(b)
        return F.when((n > 0) & (m > 0), F.round(F.size(F.array_intersect(a, b)) / (F.greatest(n, m) if of == "max" else F.least(n, m)), 3))

    return let(F.array_distinct(a), lambda x: let(F.array_distinct(b), lambda y: share(x, y)))


def retention(kept: Column, words: Column, least: int = 4) -> Column:
    """Share of the words of ``kept`` from ``least`` letters on that ``words`` has, repeats counted; 1 without any."""

    def share(long: Column, words: Column) -> Column:
        return F.when(F.size(long) == 0, 1.0).otherwise(F.size(F.filter(long, lambda w: F.array_contains(words, w))) / F.size(long))

    return let(F.filter(kept, lambda w: F.length(w) >= least), lambda x: let(words, lambda y: share(x, y)))


def odd_words(words: Column, known: Column, low: float = 0.20, high: float = 0.76) -> Column:
    """Unknown words of 5 letters or more with hardly any or hardly anything but vowels."""
    share = lambda w: F.length(F.regexp_replace(w, "[^aeiou]", "")) / F.length(w)
    return F.filter(words, lambda w: (F.length(w) >= 5) & ~F.array_contains(known, w) & ((share(w) < low) | (share(w) > high)))


def protected_terms(text: Column) -> Column:
    """Acronyms, their plurals as singulars, and camel-case names of a text, in lower case, sorted."""
    # each begins with a capital, so that other words aren't looked at further
    loud = F.filter(F.regexp_extract_all(filled(text), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0)), lambda w: (w >= "A") & (w < "["))
    words = F.filter(F.transform(loud, lambda w: F.substring_index(w, "'", 1)), lambda w: w.rlike("^[A-Z][A-Za-z0-9]+$"))
    names = F.transform(words, lambda w: F.when(w.rlike("^[A-Z0-9]{2,}s$"), F.lower(F.regexp_replace(w, "s$", ""))).when(w.rlike("^[A-Z0-9]+$"), F.lower(w)).when(w.rlike("^[A-Z].*[A-Z]") & w.rlike("[a-z]") & (F.length(w) >= 4), F.lower(w)))
    return F.array_sort(F.array_distinct(F.array_compact(names)))


def update_reasons(draft: Column, final: Column, tail_seconds: Column, most_seconds: float) -> Column:
    """Why a late text must not replace a draft; empty if it may.

    A protected term may not go, and none may come if the draft has any; up to five are named in a reason.
    """
    none = F.array().cast("array<string>")
    sides = F.struct(protected_terms(draft).alias("d"), protected_terms(final).alias("f"), tokens(draft).alias("dt"), tokens(final).alias("ft"))
    named = lambda label, terms: F.when(F.size(terms) > 0, F.concat(F.lit(label), F.array_join(F.slice(terms, 1, 5), ",")))

    def reasons(s: Column) -> Column:
        missing = F.array_except(F.array_except(s["d"], s["ft"]), s["f"])
        new = F.when(F.size(s["d"]) > 0, F.array_except(F.array_except(s["f"], s["dt"]), s["d"])).otherwise(none)
        return F.array_compact(F.array(
            F.when(blank(final), "empty-final"),
            F.when(tail_seconds > most_seconds, "tail>threshold"),
            F.when(F.contains(filled(final), F.lit("\ufffd")), "replacement-char"),
            F.when(runaway(s["ft"]), "repetition"),
            let(missing, lambda x: named("protected-term-missing:", x)),
            let(new, lambda x: named("protected-term-new:", x)),
        ))

    return let(sides, reasons)


def cut_short(text: Column, seconds: Column, least: float = 18.0) -> Column:
    """Whether a text is too short for a recording of 18 seconds or more.  An empty text is another matter."""
    chars, words = F.length(stripped(text)), F.size(F.regexp_extract_all(filled(text), F.lit(TOKEN), F.lit(0)))
    short = (chars < F.greatest(F.lit(120), F.floor(seconds * 4))) | (words < F.greatest(F.lit(20), F.floor(seconds * 0.45))) | ((chars < F.floor(seconds * 8)) & (words < 55))
    return F.coalesce((chars > 0) & (seconds >= least) & short, F.lit(False))


def fallback_reason(engine: Column) -> Column:
    """What follows ``fallback_reason=`` up to a bar."""
    return stripped(F.regexp_extract(filled(engine), r"fallback_reason=([^|]*)", 1))


def url_class(url: Column) -> Column:
    return F.when(filled(url).rlike(r"127\.0\.0\.1|localhost"), "loopback").otherwise("other")


def first_positive(*values: Column) -> Column:
    return F.coalesce(*[F.when(v > 0, v) for v in values])


def replace_words(text: Column, words: dict[str, str]) -> Column:
    """Known wrong phrases replaced, longest first, as whole words and whatever their case.  words: a small fixed list."""
    text = filled(text)
    for wrong in sorted(words, key=len, reverse=True):
        literal = "".join(c if c.isalnum() or c == " " else "\\" + c for c in wrong)
        text = F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}_]){literal}(?![\p{{L}}\p{{N}}_])", words[wrong].replace("\\", "\\\\").replace("$", "\\$"))
    return text


def join_overlapping(parts: Column, most: int = 12) -> Column:
    """Texts in order as one; up to 12 words at a seam that both sides say, whatever their case, are kept once."""

    def append(said: Column, words: Column) -> Column:
        same = lambda w: F.transform(F.slice(said, F.size(said) - w + 1, w), F.lower) == F.transform(F.slice(words, F.lit(1), w), F.lower)
        seams = F.filter(F.sequence(F.lit(0), F.least(F.lit(most), F.size(said), F.size(words))), lambda w: F.when(w == 0, True).otherwise(same(w)))
        return F.concat(said, F.slice(words, F.array_max(seams) + 1, F.size(words)))

    return F.array_join(F.aggregate(F.transform(parts, split_words), F.array().cast("array<string>"), append), " ")
