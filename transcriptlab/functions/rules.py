"""Column builders that decide about texts and attempts: buckets, eligibility, risks, safety of changes.  Null texts count as empty."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import texts as X
from .columns import let, tokens
from .meaning import FAILED_START, FAILED_TEXTS, listed

# Words that mark roman Hindi, by what they are used for.
BUCKET_MARKERS = tuple("bhai yaar kya nahi nahin matlab haan hai hain toh karna karo chahiye".split())
SIGNAL_MARKERS = tuple("aap aapko agar aisa aur bhai chahiye dekh haan hai hain hamara hoga karna karne karke kuch kya matlab nahi nahin saath sakta sakte theek toh yaar yeh".split())
SEGMENT_MARKERS = tuple("aap aapko agar aisa aur bata bhai bhi chahiye chaahie dekh haan hai hain ham hamara hame hoga hona kaise kar kare karna karke kya kyon kyunki matlab mujhe nahi nahin par saare saari sakta sakte samajh taaki taki theek thik toh yaar yeh".split())
CATEGORY_HINDI = tuple("mujhe samajh kaise kare batao bhai bahiya aage jaldi taki yeh hai".split())
CATEGORY_ENGLISH = tuple("the what how build solve problem question cursor chatgpt".split())
MIXED_MARKERS = tuple("haan han kya hai hain nahi nahin matlab yaar mujhe mera meri kaise hoga hogi karo karna karenge achcha acha thik theek phir agar aisa waise".split())
NEGATIONS = tuple("no not never cannot cant can't dont don't doesnt doesn't didnt didn't wont won't without".split())
ROMAN_HINDI = tuple(
    """
    aap aapko agar aisa alag aur baat baatein bhai chahiye dekh dusra haan hai hain hamara har hoga honi hota humein isme ismein kaam kaise
    karna karne karke kuch kya matlab mein nahi nahin par saath sakta sakte samjhaun samajho theek toh tu uske vagairah vahi wo woh yaar ye yeh
    """.split()
)
COMMON_ENGLISH = tuple(
    """
    about after again agent agents also answer api because before being brief code core could different does done english factor from goal have
    hindi into legal maybe need only problem profession quick same should skeptical solve structure task that then there thing this through
    tool what when where which will with work would wedge your
    """.split()
)
# Words of work, and of an attempt that came to nothing.
WORK_WORDS = tuple("ai api asr bcom builder chatgpt claude cloud codex corpus cursor data email eval finalizer gpu hinglish hindi english kubernetes latency local mcp metric model paste prompt regression score skill stt tool transcript ux whisper".split())
BAD_STATUS = ("too_short", "no_speech")
BAD_ERRORS = ("too_short_capture", "blank_or_no_speech")
LEARNABLE = tuple(
    """
    paste_attempted copy_fallback finalizer_replaced finalizer_saved fallback_rescue_pasted fallback_rescue_replaced fallback_rescue_saved
    friendly_rewrite_replaced friendly_rewrite_saved light_polish_replaced light_polish_saved process_second_pass_replaced
    process_second_pass_saved term_polish_replaced term_polish_saved hindi_polish_replaced hindi_polish_saved meeting_transcribed
    """.split()
)
EDGES = r"""[ \t\r\n.,:;!?()\[\]{}"']+"""
INDIC = r"[\x{0900}-\x{097F}]"
#: Han with its extensions and compatibility forms.
HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}]"
POLARITY = tuple("not no never without avoid skip disabled mat nahi nahin".split())


def letters(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(X.filled(text)), F.lit("[a-z]+"), F.lit(0))


def alnums(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(X.filled(text)), F.lit("[a-z0-9]+"), F.lit(0))


def keyword_hits(text: Column, words: tuple[str, ...] = WORK_WORDS) -> Column:
    """The keywords that a text has as words, sorted."""
    return F.array_sort(F.array_intersect(tokens(text), listed(words)))


def two_way_bucket(text: Column, category: Column, markers: tuple[str, ...] = BUCKET_MARKERS, least: int = 2) -> Column:
    """hindi_english by category, script or two markers; else english_only."""
    low = F.lower(X.filled(category))
    named = reduce(or_, [F.contains(low, F.lit(x)) for x in ("hinglish", "hindi", "hi-en")])
    scripted = X.filled(text).rlike(r"[\x{0900}-\x{097F}\x{0600}-\x{06FF}]")
    marked = F.size(F.array_intersect(letters(text), listed(markers))) >= least
    return F.when(named | scripted | marked, "hindi_english").otherwise("english_only")


def clip_category(category: Column, gold: Column) -> Column:
    """The given category; else hindi, hinglish or english by script and words."""
    given, indic = F.lower(X.stripped(category)), X.filled(gold).rlike(INDIC)
    words = tokens(gold)
    hindi, english = F.arrays_overlap(words, listed(CATEGORY_HINDI)), F.arrays_overlap(words, listed(CATEGORY_ENGLISH))
    return F.when(given != "", given).when(indic & ~english, "hindi").when(indic | (hindi & english), "hinglish").otherwise("english")


def failed_text(text: Column) -> Column:
    low = F.lower(X.stripped(text))
    return (low == "") | low.startswith(FAILED_START) | low.isin(*FAILED_TEXTS)


def lost_attempt(status: Column, error: Column) -> Column:
    return X.filled(status).isin(*BAD_STATUS) | X.filled(error).isin(*BAD_ERRORS)


def review_status(text: Column, status: Column, seconds: Column, app: Column, least_words: int = 5, idle: tuple[str, ...] = ("yo", "come", "what", "how", "going"), apps: tuple[str, ...] = ("codex", "claude")) -> Column:
    """review_ready for representative work speech, auto_candidate for other usable speech, else skip.

    idle: words that a text may not consist of; a list of swear words is the caller's.
    """
    words = F.filter(F.regexp_extract_all(F.lower(X.filled(text)), F.lit("[a-z0-9+#.]+"), F.lit(0)), lambda w: F.length(w) > 1)

    def decided(w: Column) -> Column:
        bad = status.isin(*BAD_STATUS) | failed_text(text) | (seconds < 0.8)
        usable = ~bad & ~((F.size(w) > 0) & (F.size(F.array_except(w, listed(idle))) == 0)) & (F.size(w) >= least_words)
        work = (F.size(keyword_hits(text)) > 0) | (F.lower(X.filled(app)).isin(*apps) & (F.size(w) >= 12) & (seconds >= 5.0))
        return F.when(F.coalesce(usable & work, F.lit(False)), "review_ready").when(F.coalesce(usable, F.lit(False)), "auto_candidate").otherwise("skip")

    return let(words, decided)


def length_fits(text: Column) -> Column:
    """3 to 220 words and 12 to 1,400 characters, white space joined."""
    compact = F.regexp_replace(X.stripped(text), X.BLANK, " ")
    return F.size(X.split_words(text)).between(3, 220) & F.length(compact).between(12, 1400)


def release_trusted(disputed: Column, review: Column, trust: Column, gold: Column) -> Column:
    """Whether a clip may count in a release: not disputed, no review due, and with a reference text."""
    due = F.lower(X.filled(trust)).rlike("needs_human_review|needs human review|needs_review")
    return ~F.coalesce(disputed, F.lit(False)) & ~F.coalesce(review, F.lit(False)) & ~due & (X.stripped(gold) != "")


def polarity_guarded(text: Column) -> Column:
    """Whether a text has a word that turns its meaning round."""
    return F.arrays_overlap(F.split(X.spoken_form(text), " "), listed(POLARITY))


def fast_risks(text: Column, error: Column) -> Column:
    """Why a quick transcript may be wrong."""
    return F.array_compact(F.array(
        F.when(X.filled(error) != "", "fast_error"),
        F.when(X.stripped(text) == "", "fast_empty"),
        F.when(F.size(tokens(text)) <= 3, "fast_too_short"),
        F.when(X.repeated_substring_score(text) >= 0.2, "fast_repetition"),
        F.when(F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")).rlike(" (speaking in foreign language|unclear|inaudible) "), "fast_unclear_marker"),
    ))


def script_risks(text: Column, error: Column) -> Column:
    """Scripts that a detector's transcript shows."""
    found = {"devanagari": INDIC, "arabic": r"[\x{0600}-\x{06FF}]", "chinese": HAN}
    return F.array_compact(F.array(F.when(X.filled(error) != "", "detector_error"), *[F.when(X.filled(text).rlike(p), f"detector_{n}") for n, p in found.items()]))


def plain_term(text: Column) -> Column:
    """White space joined, punctuation off the ends."""
    return F.regexp_replace(F.regexp_replace(X.filled(text), X.BLANK, " "), f"^{EDGES}|{EDGES}$", "")


def learnable_text(status: Column, *fields: Column) -> Column:
    """The different texts of an attempt, a line each; empty for states that aren't learnt from and failed recognition."""
    some = F.filter(F.array(*fields), lambda f: F.coalesce(plain_term(f) != "", F.lit(False)))

    def joined(texts: Column) -> Column:
        keys = F.transform(texts, lambda f: F.lower(plain_term(f)))
        return let(keys, lambda k: F.array_join(F.filter(texts, lambda _, i: F.array_position(k, F.get(k, i)) == i + 1), "\n"))

    state = F.lower(X.stripped(status))
    text = let(some, joined)
    return F.when((state != "") & ~state.isin(*LEARNABLE), "").when(F.contains(F.lower(text), F.lit(FAILED_START)), "").otherwise(text)


def safe_id(value: Column, most: int = 140) -> Column:
    """An id of letters, digits, dots, hyphens and single underscores."""
    kept = F.regexp_replace(F.regexp_replace(X.stripped(value), "[^A-Za-z0-9_.-]+", "_"), "_+", "_")
    return F.substring(F.regexp_replace(kept, "^_+|_+$", ""), 1, most)


def stamped_id(value: Column, pattern: str, prefix: str) -> Column:
    """prefix, date, time and number of an id with six groups of a time and one of a number; other ids in safe small letters."""
    part = lambda i: F.regexp_extract(X.filled(value), pattern, i)
    other = F.regexp_replace(F.lower(F.regexp_replace(X.filled(value), "[^a-zA-Z0-9]+", "_")), "^_+|_+$", "")
    stamp = F.concat(F.lit(prefix), part(1), part(2), part(3), F.lit("_"), part(4), part(5), part(6), F.lit("_"), part(7))
    return F.when(part(1) != "", stamp).otherwise(F.concat(F.lit(prefix), other))


def hindi_signal(text: Column, markers: tuple[str, ...] = SIGNAL_MARKERS) -> Column:
    return X.filled(text).rlike(INDIC) | F.arrays_overlap(alnums(text), listed(markers))


def second_pass_fits(draft: Column, final: Column) -> Column:
    """Whether a second pass may stand for a draft: it differs, has Hindi in it and isn't much shorter."""
    a, b = X.stripped(draft), X.stripped(final)
    n, m = F.size(alnums(draft)), F.size(alnums(final))
    short = ((n >= 6) & (m < F.greatest(F.lit(3), F.floor(n / 2)))) | (F.length(b) < F.greatest(F.lit(20), F.floor(F.length(a) / 2)))
    return (b != "") & (a != b) & hindi_signal(b) & ((a == "") | ~short)


def junk_words(text: Column, draft: Column, forced: tuple[str, ...] = ("kakareapata", "vedik", "yesap", "khanya", "sakuj", "kuchar", "lagala", "hiya")) -> Column:
    """Words of a candidate that look like noise: unknown ones with hardly any or hardly anything but vowels, and listed ones."""
    known = F.concat(alnums(draft), listed(COMMON_ENGLISH), listed(ROMAN_HINDI))
    return let(known, lambda k: F.filter(alnums(text), lambda w: (F.length(w) >= 5) & ~F.array_contains(k, w) & (w.isin(*forced) | (F.size(X.odd_words(F.array(w), F.array().cast("array<string>"))) > 0))))


def candidate_verdict(draft: Column, text: Column, seconds: Column, most_seconds: float) -> Column:
    """struct(accepted, junk, retention, signal, policy): whether a candidate may replace a draft, and why not."""
    facts = F.struct(junk_words(text, draft).alias("junk"), X.retention(alnums(draft), alnums(text)).alias("retention"), hindi_signal(text).alias("signal"), second_pass_fits(draft, text).alias("policy"))

    def judged(x: Column) -> Column:
        accepted = (seconds <= most_seconds) & x["signal"] & x["policy"] & (x["retention"] >= 0.35) & (F.size(x["junk"]) == 0)
        return F.struct(F.coalesce(accepted, F.lit(False)).alias("accepted"), x["junk"].alias("junk"), F.round(x["retention"], 3).alias("retention"), x["signal"].alias("signal"), x["policy"].alias("policy"))

    return let(facts, judged)


def selection_score(draft: Column, text: Column, seconds: Column, name: Column, bonus: dict[str, float], markers: tuple[str, ...] = SIGNAL_MARKERS) -> Column:
    """How good a safe candidate is: its Hindi, what it keeps of the draft, and its speed."""
    hits = F.size(F.array_intersect(alnums(text), listed(markers)))
    extra = reduce(lambda c, kv: F.when(name == kv[0], kv[1]).otherwise(c), bonus.items(), F.lit(0.0))
    return 0.7 * F.least(hits, F.lit(4)) + 0.6 * X.retention(alnums(draft), alnums(text)) + extra - F.greatest(F.lit(0.0), seconds - 1.5) * 0.12


def numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(X.filled(text), F.lit(r"(?<![\p{L}\p{N}_])[0-9]+(?:[.,][0-9]+)?(?![\p{L}\p{N}_])"), F.lit(0))))


def pattern_terms(text: Column) -> Column:
    """Words in capitals (and their plural), with digits behind letters, or with a capital inside, sorted."""
    words = F.regexp_extract_all(X.filled(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    kinds = r"^([A-Z][A-Z0-9]{1,9}s?|[A-Za-z]+[0-9][A-Za-z0-9]*|[A-Za-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*)$"
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w.rlike(kinds))))


def comparable(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(X.filled(text)), "[^a-z0-9]+", " "))


def rewrite_safety(draft: Column, final: Column, terms: Column | None = None) -> Column:
    """struct(numbers, negations, terms, mixed): what a rewritten text lost of a draft, and whether a text in two languages was changed."""
    words = lambda t: F.regexp_extract_all(F.lower(X.filled(t)), F.lit("[a-z0-9']+"), F.lit(0))
    kept = pattern_terms(draft) if terms is None else F.array_sort(F.array_union(terms, pattern_terms(draft)))
    lost = let(F.struct(comparable(draft).alias("d"), comparable(final).alias("f")), lambda x: F.filter(kept, lambda t: F.contains(x["d"], comparable(t)) & ~F.contains(x["f"], comparable(t))))
    denied = lambda t: F.array_sort(F.array_intersect(words(t), listed(NEGATIONS)))
    mixed = (X.filled(draft).rlike(r"[\x{0900}-\x{097F}\x{0600}-\x{06FF}\x{4E00}-\x{9FFF}]") | F.arrays_overlap(words(draft), listed(MIXED_MARKERS))) & (comparable(draft) != comparable(final))
    return F.struct(F.array_except(numbers(draft), numbers(final)).alias("numbers"), F.array_except(denied(draft), denied(final)).alias("negations"), lost.alias("terms"), mixed.alias("mixed"))


def rewrite_reviews(draft: Column, final: Column) -> Column:
    """Why an accepted rewrite should be looked at."""
    ends = lambda t: F.length(F.regexp_replace(X.filled(t), "[^.?!]", ""))
    return F.array_compact(F.array(
        F.when(F.abs(F.length(X.filled(final)) - F.length(X.filled(draft))) >= 12, "large_char_delta"),
        F.when(ends(final) - ends(draft) >= 4, "large_sentence_delta"),
        F.when(X.filled(final).endswith("?") & ~X.stripped(draft).endswith("?"), "question_mark_added"),
    ))


def dictionary_terms(text: Column, aliases: Column) -> Column:
    """Canonical terms of a dictionary, array<struct<alias, canonical>> in small letters, that a text shows.

    An alias of several words stands as a phrase; a single word as a word or, from 5 letters on, inside the text without blanks.
    """
    plain = let(F.regexp_replace(F.lower(X.filled(text)), "[^a-z0-9]+", " "), lambda p: F.struct(F.concat(F.lit(" "), p, F.lit(" ")).alias("padded"), F.replace(p, F.lit(" "), F.lit("")).alias("compact")))

    def shown(x: Column) -> Column:
        word = lambda a: F.contains(x["padded"], F.concat(F.lit(" "), a["alias"], F.lit(" ")))
        inside = lambda a: ~F.contains(a["alias"], F.lit(" ")) & (F.length(a["alias"]) >= 5) & F.contains(x["compact"], a["alias"])
        return F.array_sort(F.array_distinct(F.transform(F.filter(aliases, lambda a: (a["alias"] != "") & (word(a) | inside(a))), lambda a: a["canonical"])))

    return let(plain, shown)


def plausibility(text: Column, translated: Column) -> Column:
    """How likely a transcript is one: its length, Latin letters, words of work; less for other scripts, courtesies and repetition."""
    words, latin = F.size(tokens(text)), F.size(F.regexp_extract_all(X.filled(text), F.lit("[A-Za-z][A-Za-z0-9.+#-]*"), F.lit(0)))
    share = latin / F.greatest(F.lit(1), words)
    named = "api asr cursor codex document format impress linux office prompt screen slide tutorial window".split()
    points = [
        F.when(words >= 3, 0.2), F.when(words >= 8, 0.2), F.when(words >= 18, 0.1), F.when(share >= 0.8, 0.25).when(share >= 0.35, 0.15),
        F.when(F.arrays_overlap(tokens(text), listed(named)), 0.2), F.when(translated, 0.15), F.when(X.filled(text).rlike(INDIC), 0.05),
        F.when(X.filled(text).rlike(r"[\x{0600}-\x{06FF}]"), -0.35), F.when(F.lower(X.stripped(text)).rlike(r"^(unclear|thank you|thanks)\.?$"), -0.7),
    ]
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in points]) - F.least(X.repeated_substring_score(text), F.lit(1.0)) * 1.2
    return F.when(X.stripped(text) == "", -10.0).otherwise(F.round(total + 1e-9, 3))


# Products and clauses that recognisers get wrong.
PRODUCTS = r"Cursor\s+ChatGPT|ChatGPT|Cursor|Codex"
PRODUCT_PROBLEM = rf"(?i)\b(solve|debug|fix)\s+for\s+(?:a\s+)?({PRODUCTS})\b"
LOCAL_CLAUSE = (r"(?i)\b(?:it|this)\s+should\s+be\s+(?:a\s+)?(?:solution|possible)\s+because\b", r"(?i)\b(?:it|this)\s+needs\s+to\s+be\s+(?:a\s+)?(?:solution|possible)\s+because\b")
LOCAL_WRITTEN = "This tool should be local because"
COMPANY_DATA = r"\b(company|enterprise|work)\s+data\b"
NO_CLOUD = r"\b(?:cannot|can't|can\s+not|should\s+not|must\s+not)\s+(?:go|be\s+sent|send|move)\s+(?:to\s+)?(?:the\s+)?cloud\b"


def work_polish(text: Column) -> Column:
    """struct(text, rules): two repairs of speech about work, each only where its context stands, and those that changed something."""
    first = F.regexp_replace(X.filled(text), PRODUCT_PROBLEM, "$1 a $2 problem")

    def second(t: Column) -> Column:
        low = F.lower(t)
        guarded = low.rlike(COMPANY_DATA) & low.rlike(NO_CLOUD) & ~(low.rlike(r"\btool\b") & low.rlike(r"\blocal\b"))
        # the first clause of the first pattern that stands in the text
        once = lambda p: F.regexp_replace(t, rf"^((?s).*?){p}", f"$1{LOCAL_WRITTEN}")
        return F.when(guarded & t.rlike(LOCAL_CLAUSE[0]), once(LOCAL_CLAUSE[0])).when(guarded & t.rlike(LOCAL_CLAUSE[1]), once(LOCAL_CLAUSE[1])).otherwise(t)

    def named(x: Column) -> Column:
        rules = F.array_compact(F.array(F.when(x["a"] != X.filled(text), "product_problem_phrase"), F.when(x["b"] != x["a"], "local_tool_cloud_clause")))
        return F.struct(x["b"].alias("text"), rules.alias("rules"))

    return let(let(first, lambda a: F.struct(a.alias("a"), second(a).alias("b"))), named)


# Words around a denied phrase.
ADVERBS = "ever|really|actually|just|please"
SOFTENERS = "really|actually|fully|completely|quite|exactly|currently|still|even|truly|entirely|totally|anymore"
REPORTERS, REFERENCES, ARTICLES = "call|say|label|describe|mark|treat", "it|this|that|them|as", "a|an|the|as|is"
DENIED_BEFORE = (
    " (no longer|no more|not|no|never|without|mat|nahi|nahin|not a|not an|not the|not to|not be|not get)$",
    " (do|does|did) not [^ ]+ to$",
    rf" not( ({ADVERBS}))* ({REPORTERS})(?=( [^ ]+)* ({ARTICLES})( |$))( ({REPORTERS}|{REFERENCES}|{ARTICLES})){{1,4}}$",
)
DENIED_NEAR = rf" (not|never|no longer|no more)( ({SOFTENERS}))*$"
DENIED_AFTER = "^ (is|was|are) not( (a|an|the))? (date|default|issue|problem|case|cause|reason)( |$)"


def asserted(actual: Column, phrase: Column) -> Column:
    """Whether a text says a phrase at a place where it isn't denied: by what stands before it or right behind it."""
    words = lambda t: F.filter(F.split(X.spoken_form(t), " "), lambda w: w != "")
    line = lambda w: F.when(F.size(w) > 0, F.concat(F.lit(" "), F.array_join(w, " "))).otherwise("")

    def found(x: Column) -> Column:
        w, p = x["w"], x["p"]
        n, m = F.size(w), F.size(p)
        spots = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), n - m + 1)), lambda i: F.slice(w, i, m) == p)

        def stands(i: Column) -> Column:
            before = F.regexp_replace(line(F.slice(w, F.greatest(F.lit(1), i - 6), F.least(F.lit(6), i - 1))), rf"( ({ADVERBS}))+$", "")
            near = line(F.slice(w, F.greatest(F.lit(1), i - 10), F.least(F.lit(10), i - 1)))
            after = line(F.slice(w, i + m, F.lit(25)))
            return ~(reduce(or_, [before.rlike(p) for p in DENIED_BEFORE]) | near.rlike(DENIED_NEAR) | after.rlike(DENIED_AFTER))

        return F.when((m == 0) | (n < m), False).otherwise(F.exists(spots, stands))

    return let(F.struct(words(actual).alias("w"), words(phrase).alias("p")), found)


def required_and_forbidden(actual: Column, required: Column, forbidden: Column) -> Column:
    """Whether a text lacks a required phrase or asserts a forbidden one; arrays of phrases, null for none."""
    none = F.array().cast("array<string>")
    said = X.spoken_form(actual)
    lacks = F.exists(F.coalesce(required, none), lambda r: (X.stripped(r) != "") & ~F.contains(said, X.spoken_form(r)))
    return lacks | F.exists(F.coalesce(forbidden, none), lambda f: (X.stripped(f) != "") & asserted(actual, f))


def value_delta(draft: Column, final: Column, roman: tuple[str, ...] = ROMAN_HINDI, idle: tuple[str, ...] = ("aur", "bhai", "bhi", "de", "dekh", "haan", "hai", "hain", "hi", "matlab", "na", "par", "raha", "rahe", "rahi", "theek", "tha", "thik", "to", "vah", "vo", "woh", "ya", "yaar", "yah", "yaha", "ye")) -> Column:
    """New roman Hindi words of a final text that carry something, sorted."""
    has = lambda t: F.array_intersect(alnums(t), listed(roman))
    return F.array_sort(F.array_except(F.array_except(has(final), has(draft)), listed(idle)))


OPEN_ENDS = ("aur", "but", "ki", "ke", "ka", "mein", "me", "par", "to", "with")


def meaning_reasons(draft: Column, final: Column, stop: tuple[str, ...] = COMMON_ENGLISH) -> Column:
    """Why a final text doesn't improve the meaning of a draft; empty if it may, or if either has under 4 words of content."""
    content = lambda t: F.filter(alnums(t), lambda w: (F.length(w) >= 4) & ~w.isin(*stop))
    facts = F.struct(content(draft).alias("d"), content(final).alias("f"), F.size(value_delta(draft, final)).alias("value"), F.element_at(F.concat(F.array(F.lit("")), alnums(final)), -1).alias("last"))

    def reasons(x: Column) -> Column:
        d, f = F.array_distinct(x["d"]), F.array_distinct(x["f"])
        kept, new, gone = F.size(F.array_intersect(d, f)) / F.greatest(F.lit(1), F.size(d)), F.size(F.array_except(f, d)), F.size(F.array_except(d, f))
        share = F.format_string("%.2f", kept)
        one = (
            F.when((F.size(x["d"]) < 4) | (F.size(x["f"]) < 4), None)
            .when(x["last"].isin(*OPEN_ENDS), "incomplete-tail")
            .when((x["value"] >= 5) & ((F.size(x["f"]) >= 5) | (kept >= 0.65)), None)
            .when((kept < 0.78) & (new < 6), F.concat(F.lit("default-meaning-drop:"), share))
            .when(new < 3, "no-default-meaning-gain")
            .when((kept < 0.85) & (gone >= 2), F.concat(F.lit("default-meaning-tradeoff:"), share))
        )
        return F.array_compact(F.array(one))

    return let(facts, reasons)


def suggested_label(fast: Column, current: Column, raw: Column, safe: Column, risk: Column, reasons: Column) -> Column:
    """struct(text, source): the text that a reviewer is shown first, and why that one."""
    f, c, r = X.stripped(fast), X.stripped(current), X.stripped(raw)
    pair = lambda t, s: F.struct(t.alias("text"), F.lit(s).alias("source"))
    first = lambda a, b: F.when(a != "", a).otherwise(b)
    return (
        F.when(safe & (c != ""), pair(c, "current_final_safe_update"))
        .when(F.size(F.coalesce(reasons, F.array().cast("array<string>"))) > 0, pair(first(f, c), "fast_text_rejected_hindi_candidate"))
        .when(risk & (r != "") & (c == ""), pair(f, "fast_text_risk_no_safe_update"))
        .otherwise(pair(first(c, f), "fast_or_current_no_hindi_risk"))
    )


def translation_loss(text: Column) -> Column:
    """Whether a text begins as translations do that lost what was said."""
    return F.lower(X.filled(text)).rlike("^(yes, look|yes, see|now tell me|what is it that|it should be a solution)")


def tool_seconds(tool: Column, seconds: Column, cloud_ms: Column, down: Column, done: Column, cloud_tool: str) -> Column:
    """A result's latency: the cloud tool's own figure for that one; else seconds, that figure, or from key release to paste."""
    own = cloud_ms / 1000.0
    return F.when(tool == cloud_tool, own).otherwise(F.coalesce(seconds, own, done - down))
