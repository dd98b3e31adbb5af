"""Column builders for what a text means: concepts, expected terms and their aliases, scripts, critical errors."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache, reduce
from itertools import chain, islice
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import WORDS, coded_distances, item_lists, let, longest_copies, stretches

# Concepts with the words that name them, whole phrases, and pieces of text that name them anywhere.
CONCEPTS: dict[str, tuple[str, str, str]] = {
    "understand": ("understand samajna samajhna", "", "समझ"),
    "idea": ("idea soch", "", ""),
    "execution": ("execution execute hakikat", "", ""),
    "fast": ("fast quickly jaldi jaldy", "", ""),
    "build": ("build banaye banana kare", "", "बनाये,करें"),
    "solve": ("samadhan", "", "सॉल्फ,solve"),
    "real_problem": ("problem", "", ""),
    "fun": ("fun maza", "", ""),
    "waste": ("waste faltu", "", ""),
    "how": ("how kaise kaisse kaisi", "", "कैसे"),
    "tell": ("tell batao badao", "", "बताओ"),
    "move_forward": ("aage badh badhe", "move forward,aake bahar", "आगे,बढ़"),
    "things": ("cheez cheeze cheezein things", "", "चीज"),
    "brother": ("bahiya bhaiya bhai", "", "भैया"),
    "zero_to_one": ("", "zero to one,0 to 1", ""),
    "results": ("result results", "", ""),
    "recording_eval": ("recording audio eval evals transcript transcription", "", ""),
    "loading": ("loading", "", ""),
    "share": ("share sharing", "", ""),
}
#: Any word that begins with this names the first concept.
STEM = "samajh"
# Words that are no anchors of meaning.
STOP_WORDS = tuple(
    """
    the a an and or to from in on it is this that then with for can do we you i me my so ok okay aa hai ki ka ke ko yeh toh ab aap aar yaar
    mujhe samajna samajhna samajh kaise kaisse kare isko tha tak sakte sakti shaasakti jaldi quickly because otherwise want getting going
    would could
    """.split()
)
# Words that are no terms to be heard.
ANCHOR_STOP_WORDS = tuple(
    """
    about after again against also because before being between could does doing done from have into like main make more need okay only other
    really right should something still that then there these thing things this very want what when where whether which with without would
    your aap aage aata agar aur bana banana banado banae banaye batao bhai bahiya cheeze cheezein hai hain haan hoon hua hum isko jaldi jahan
    jahaan kaise kar kare karke karna kya kyun mat mein mujhe nahi sake sakte samajh samajhna taki tha toh vaise waise wahan yaar yeh
    """.split()
)
# Terms with the ways in which they are written.
ALIASES: dict[str, tuple[str, ...]] = {
    "api": ("api", "एपीआई"),
    "asr": ("asr", "एएसआर"),
    "bcom": ("bcom",),
    "bpd": ("bpd",),
    "chatgpt": ("chatgpt", "chat gpt", "चैटजीपीटी"),
    "claude": ("claude", "क्लॉड"),
    "clean": ("clean", "क्लीन"),
    "cloud": ("cloud", "क्लाउड"),
    "codex": ("codex", "कोडेक्स", "कोडिक्स"),
    "company": ("company", "कंपनी"),
    "cursor": ("cursor", "करसर"),
    "data": ("data", "डेटा", "डाटा"),
    "document": ("document", "documents", "डॉक्यूमेंट", "डॉक्यूमेंट्स"),
    "documents": ("documents", "document", "डॉक्यूमेंट", "डॉक्यूमेंट्स"),
    "duplicate": ("duplicate", "duplicates", "डुप्लिकेट"),
    "english": ("english", "इंग्लिश"),
    "font": ("font", "fonts", "फॉन्ट", "फ़ॉन्ट"),
    "hindi": ("hindi", "हिंदी"),
    "hinglish": ("hinglish", "हिंग्लिश"),
    "growth": ("growth", "ग्रोथ"),
    "libreoffice": ("libreoffice", "libre office", "लिबरऑफिस", "लिबर ऑफिस"),
    "linux": ("linux", "लिनक्स"),
    "local": ("local", "लोकल"),
    "lose": ("lose", "loose", "लूज"),
    "mat": ("mat", "मत", "do not", "don't", "dont", "not"),
    "meaning": ("meaning", "मीनिंग"),
    "pci": ("pci", "पीसीआई"),
    "pii": ("pii", "पीआईआई"),
    "prd": ("prd", "पीआरडी"),
    "prompt": ("prompt", "प्रॉम्प्ट", "प्रॉंप्ट"),
    "problem": ("problem", "problems", "प्रॉब्लम"),
    "sdk": ("sdk", "एसडीके"),
    "section": ("section", "sections", "सेक्शन"),
    "skill": ("skill", "skills", "स्किल"),
    "slide": ("slide", "slides", "स्लाइड"),
    "task": ("task", "tasks", "टास्क"),
    "tasks": ("tasks", "task", "टास्क"),
    "text": ("text", "टेक्स्ट"),
    "title": ("title", "टाइटल"),
    "sox": ("sox", "सॉक्स"),
    "teams": ("teams", "टीम्स"),
    "tool": ("tool", "टूल"),
    "toolbar": ("toolbar", "tool bar", "टूलबार"),
    "tutorial": ("tutorial", "tutorials", "ट्यूटोरियल"),
    "wispr": ("wispr", "whisper", "विस्पर"),
}
# Spellings of roman Hindi words.
SPELLINGS: dict[str, tuple[str, ...]] = {
    "aata": ("ata",),
    "bangal": ("bangaal", "bengal"),
    "bangaal": ("bangal", "bengal"),
    "hoon": ("hun",),
    "jahan": ("jahaan", "jaha", "jahaa"),
    "jahaan": ("jahan", "jaha", "jahaa"),
    "kaafi": ("kafi", "kaaphi", "kaphi"),
    "kafi": ("kaafi", "kaaphi", "kaphi"),
    "kaaphi": ("kaafi", "kafi", "kaphi"),
    "karein": ("karen",),
    "karen": ("karein",),
    "vaise": ("waise",),
    "waise": ("vaise",),
    "wahan": ("vahaan", "vahan"),
}
# Texts and flags of a transcript that must not be used.
FAILED_START = "asr failure detected"
FAILED_TEXTS = ("[blank_audio]", "blank_audio", "<|nospeech|>", "[no speech]", "no speech detected")
CRITICAL_FLAGS = ("critical_semantic_error", "critical_fact_error", "dangerous_error", "wrong_action", "negation_flip", "entity_substitution", "number_error", "date_error")
TRUE_WORDS = ("1", "true", "yes", "y", "critical", "fail", "failed")
SCRIPTS = {"devanagari": r"[\x{0900}-\x{097F}]", "arabic": r"[\x{0600}-\x{06FF}]", "han": r"[\x{4E00}-\x{9FFF}]"}
MIXED_CATEGORIES = ("hinglish", "hindi", "hi-en", "chinese", "mandarin", "cmn", "zh")
TERM = r"[A-Za-z][A-Za-z0-9+.#'-]*"
_TERM, _PLAIN, _PARTS, _INDIC = re.compile(TERM), re.compile("[a-z0-9+#]+"), re.compile(r"[,;\n]+"), re.compile("[\u0900-\u097f]")


def listed(values: tuple[str, ...] | list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


#: The concepts of a word, those of pieces of text, and the phrases of concepts with the first word, by which each is looked for.
_FORMS = {w: tuple(c for c, (forms, _, _) in CONCEPTS.items() if w in forms.split()) for _, (forms, _, _) in CONCEPTS.items() for w in forms.split()}
_PIECES = tuple((x, c) for c, (_, _, parts) in CONCEPTS.items() for x in parts.split(",") if x)
_PHRASES = tuple((f" {x} ", c) for c, (_, phrases, _) in CONCEPTS.items() for x in phrases.split(",") if x)
_MARKS = frozenset(x.split()[0] for x, _ in _PHRASES)
_NO_WORDS, _NO_TERMS, _KNOWN = frozenset(STOP_WORDS), frozenset(ANCHOR_STOP_WORDS), frozenset(ALIASES)


COUNTS = T.ArrayType(T.StructType([T.StructField("wanted", T.IntegerType()), T.StructField("met", T.IntegerType())]))
HEARD = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("hits", WORDS)])


#: Letters of which every piece begins with one.
_BEGIN = frozenset(x[0] for x, _ in _PIECES)


@lru_cache(1 << 17)
def _named(word: str) -> tuple[str, ...]:
    """What a lower-case word names, itself included; an empty name where it may be part of a phrase."""
    names = _FORMS.get(word, ()) + (() if _BEGIN.isdisjoint(word) else tuple(c for x, c in _PIECES if x in word))
    if word.startswith(STEM):
        names += (next(iter(CONCEPTS)),)
    if len(word) > 4 and word not in _NO_WORDS:
        names += (word,)
    return names if _MARKS.isdisjoint(word.split(" ") if " " in word else (word,)) else (*names, "")


def _concepts_of(words: list[str | None]) -> set[str]:
    known = [w for w in words if w is not None]
    found = set(chain.from_iterable(map(_named, known)))
    if "" in found:
        found.remove("")
        text = f" {' '.join(known)} "
        found.update(c for x, c in _PHRASES if x in text)
    return found


@F.arrow_udf(WORDS)
def _concepts(words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else sorted(_concepts_of(w)) for w in item_lists(words)], pa.list_(pa.string()))


def concepts(words: Column) -> Column:
    """The concepts that lower-case words name, and the words of more than 4 characters that aren't stop words, each once."""
    return _concepts(words)


def _once_each(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=-1) != 0] if len(keys) else keys


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of some numbers are among sorted ones."""
    at = np.searchsorted(keys, wanted)
    return np.append(keys, -1)[at] == wanted


class _Numbers(dict):
    """Numbers of names, in the order in which they came."""

    def of(self, names: Iterable[str]) -> list[int]:
        return [self.setdefault(x, len(self)) for x in names]


class _Known:
    """What a rule gives for names, as numbers: each name is asked once."""

    def __init__(self, names: _Numbers, rule):
        self.names, self.rule = names, rule
        self.many, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def given(self, rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) for everything that the names of the rows give."""
        if len(self.many) < len(self.names):
            more = [self.rule(x) for x in islice(self.names, len(self.many), None)]
            self.many = np.append(self.many, np.array([len(x) for x in more], np.int64))
            self.flat = np.append(self.flat, np.array(list(chain.from_iterable(more)), np.int64))
            self.starts = np.cumsum(self.many) - self.many
        k = self.many[codes] if len(codes) else np.zeros(0, np.int64)
        at = np.arange(k.sum()) + np.repeat(self.starts[codes] - (np.cumsum(k) - k), k) if len(codes) else k
        return np.repeat(rows, k), self.flat[at]


def _simple(term: str) -> bool:
    """Whether a term is one lower-case word, written only as itself and as its singulars or plural."""
    return term.isascii() and term.isalnum() and term.islower() and term not in ALIASES and term not in SPELLINGS


class _Vocabulary:
    """Words, pieces of text, terms and concepts by numbers with what they give, kept in a Python worker from batch to batch and begun anew when it is full."""

    def __init__(self):
        self.words, self.plain, self.terms, self.concepts = _Numbers(), _Numbers(), _Numbers(), _Numbers({"": 0})
        self.low = _Known(self.words, lambda w: self.plain.of((w.lower(),)))
        self.named = _Known(self.words, lambda w: self.concepts.of(_named(w.lower())))
        self.anchors = _Known(self.words, lambda w: self.terms.of(_once(map(_anchor, (w,) if w.isascii() and w.isalpha() else _TERM.findall(w)))))
        self.said = _Known(self.words, lambda w: self.plain.of((w.lower(),) if w.isascii() and w.isalnum() else _PLAIN.findall(w.lower())))
        # every term is one of its ways
        self.ways = _Known(self.terms, lambda t: self.plain.of(singulars(t) if _simple(t) else (t, *_ways(t)[0])))
        self.pairs = _Known(self.terms, lambda t: () if _simple(t) else self._pairs(t))
        self.long = _Known(self.terms, lambda t: (not _simple(t) and any(p.count(" ") > 1 for p in _ways(t)[1]),))
        self.indic = _Known(self.terms, lambda t: (not _simple(t) and bool(_ways(t)[2]),))

    def _pairs(self, term: str) -> list[int]:
        """The first two words of its phrases."""
        firsts = [self.plain.of(p.split(" ")[:2]) for p in _ways(term)[1]]
        return [(a << 32) + b for a, b in firsts]

    def codes(self, words: pa.Array) -> np.ndarray:
        """The words' numbers; null has one below 0."""
        coded = words.dictionary_encode()
        own = np.array([*self.words.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), -3], np.int64)
        return own[pc.fill_null(coded.indices, len(own) - 1).to_numpy(zero_copy_only=False)]

    def lower(self, codes: np.ndarray) -> np.ndarray:
        """The numbers of the words whatever their case."""
        out = np.full(len(codes), -3, np.int64)
        known = np.flatnonzero(codes >= 0)
        out[known] = self.low.given(known, codes[known])[1]
        return out


_VOCABULARY = [_Vocabulary()]


def vocabulary(most: int = 1 << 19) -> _Vocabulary:
    if max(map(len, (_VOCABULARY[0].words, _VOCABULARY[0].plain, _VOCABULARY[0].terms))) > most:
        _VOCABULARY[0] = _Vocabulary()
    return _VOCABULARY[0]


def _named_in(voc: _Vocabulary, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list, number of a concept) of lists of words, case not counting."""
    row, known = np.repeat(np.arange(len(sizes)), sizes), codes >= 0
    row, codes = row[known], codes[known]
    row_of, found = voc.named.given(row, codes)
    phrase = found == 0
    if phrase.any():
        more, words = [], list(voc.words)
        ends = np.searchsorted(row, np.arange(len(sizes) + 1))
        for i in np.unique(row_of[phrase]).tolist():
            text = f" {' '.join(words[c].lower() for c in codes[ends[i] : ends[i + 1]].tolist())} "
            more += [(i, voc.concepts.of((c,))[0]) for x, c in _PHRASES if x in text]
        more = np.array(more, np.int64).reshape(-1, 2)
        row_of, found = np.append(row_of[~phrase], more[:, 0]), np.append(found[~phrase], more[:, 1])
    return row_of, found


def concept_counts(voc: _Vocabulary, sides: tuple[np.ndarray, np.ndarray], owner: np.ndarray, said: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each of some lists the number of its concepts, and how many of them the list has that it is held against.  Lists as codes and sizes."""
    (side, want), (text, have) = _named_in(voc, *sides), _named_in(voc, *said)
    n = len(voc.concepts)
    want = _once_each(side * n + want)
    side = want // n
    met = _among(np.sort(text * n + have), owner[side] * n + want % n)
    return np.bincount(side, minlength=len(owner)), np.bincount(side[met], minlength=len(owner))


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _places(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))


@F.arrow_udf(COUNTS)
def _counts(expected: pa.Array, actual: pa.Array) -> pa.Array:
    out = []
    for some in stretches(_lengths(actual)):
        want, said, voc = expected[some], actual[some], vocabulary()
        sides, sizes = want.flatten(), _lengths(want)
        counts = concept_counts(voc, (voc.codes(sides.flatten()), _lengths(sides)), np.repeat(np.arange(len(sizes)), sizes), (voc.codes(said.flatten()), _lengths(said)))
        items = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in counts], ["wanted", "met"], mask=sides.is_null())
        out.append(pa.ListArray.from_arrays(_places(sizes), items, mask=pc.or_(want.is_null(), said.is_null())))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([("wanted", pa.int32()), ("met", pa.int32())])))


def concept_coverage(expected: Column, actual: Column) -> Column:
    """For each of some arrays of words the share of its concepts that ``actual`` has, to 3 digits; 1 where it has none.  Case doesn't count."""
    return F.transform(_counts(expected, actual), lambda x: share(x["wanted"], x["met"]))


def share(wanted: Column, met: Column) -> Column:
    return F.when(wanted == 0, 1.0).otherwise(F.round(met / wanted, 3))


def term_key(term: str) -> str:
    """Lower case with only a-z, 0-9, + and #, single blanks between words."""
    low = term.lower()
    return low if low.isascii() and low.isalnum() else " ".join(_PLAIN.findall(low))


@lru_cache(1 << 17)
def _anchor(word: str) -> str:
    """A word as a term; empty if it is no anchor."""
    key = term_key(word)
    loud = word.upper() == word  # a word begins with a letter
    return key if key and key not in _NO_TERMS and (len(key) >= 4 or loud or key in _KNOWN) else ""


def _once(terms: Iterable[str]) -> list[str]:
    return [t for t in dict.fromkeys(terms) if t]


def _pieces(voc: _Vocabulary, text: pa.Array, words: pa.Array | None = None, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of the pieces of texts between blanks; no term or plain word goes across a blank.  words, codes: lists that may well be these."""
    split = pc.split_pattern(pc.fill_null(text, ""), " ")
    sizes, flat = _lengths(split), split.flatten()
    if words is None or not (flat.equals(words.flatten()) and np.array_equal(sizes, _lengths(words))):
        codes = voc.codes(flat)
    return np.repeat(np.arange(len(text)), sizes), codes


def terms_of(voc: _Vocabulary, pieces: tuple[np.ndarray, np.ndarray], given: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, number of a term): the terms that are given, else the anchors of the text, of each row once, as they come."""
    own = {}
    if given.null_count < len(given):
        for i, g in enumerate(given.to_numpy(zero_copy_only=False)):
            named = _once(map(term_key, _PARTS.split(g))) if g else []
            if named:
                own[i] = voc.terms.of(named)
    row, found = voc.anchors.given(*pieces)
    if own:
        other = ~np.isin(row, list(own))
        row = np.append(row[other], np.repeat(list(own), [len(x) for x in own.values()]))
        found = np.append(found[other], np.fromiter(chain.from_iterable(own.values()), np.int64))
        order = np.argsort(row, kind="stable")
        row, found = row[order], found[order]
    first = _firsts(row, found, len(voc.terms))
    return row[first], found[first]


def _firsts(row: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    """Where a row has each of its numbers for the first time."""
    # the place is part of the key, so that equal ones needn't keep their order
    key = np.sort((row * n + found) * len(row) + np.arange(len(row)))
    return np.sort(key[np.diff(key // max(len(row), 1), prepend=-1) != 0] % max(len(row), 1))


@F.arrow_udf(WORDS)
def _expected(text: pa.Array, terms: pa.Array) -> pa.Array:
    out = []
    for some in stretches(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), 8_000_000):
        voc = vocabulary()
        row, found = terms_of(voc, _pieces(voc, text[some]), terms[some])
        used, at = np.unique(found, return_inverse=True)
        every = np.array(list(voc.terms), object)
        out.append(pa.ListArray.from_arrays(_places(np.bincount(row, minlength=some.stop - some.start)), pa.array(every[used], pa.string()).take(pa.array(at))))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))


def anchor_terms(text: Column) -> Column:
    """A text's words of 4 characters or more, those in capitals and known terms; without stop words, each once."""
    return _expected(text, F.lit(None).cast("string"))


def expected_terms(text: Column, terms: Column | None = None) -> Column:
    """The terms of a string that commas, semicolons or newlines part; without any, the anchors of the text."""
    return anchor_terms(text) if terms is None else _expected(text, terms)


def singulars(term: str) -> tuple[str, ...]:
    """A term in plain letters and its likely singulars or plural; phrases stand for themselves, an empty term has none."""
    a = term_key(term)
    if not a or " " in a:
        return (a,) if a else ()
    n = len(a)
    more = [a]
    if a.endswith("ies") and n > 4:
        more.append(a[:-3] + "y")
    if a.endswith("es") and n > 3:
        more.append(a[:-2])
    return (*more, a[:-1] if a.endswith("s") and n > 3 else a + "s")


@lru_cache(1 << 17)
def _ways(term: str) -> tuple[frozenset[str], tuple[str, ...], tuple[str, ...]]:
    """The ways in which a term is written, its own or those that the tables give, and other spellings: words, phrases, and pieces of text."""
    names = (*ALIASES.get(term, (term,)), *SPELLINGS.get(term, ()))
    indic = tuple(x.lower() for x in names if _INDIC.search(x))
    plain = [v for x in names if not _INDIC.search(x) for v in singulars(x)]
    return frozenset(v for v in plain if " " not in v), tuple(v for v in plain if " " in v), indic


def _in_other_ways(term: str, text: str) -> bool:
    """Whether a text says a term in one of its ways that aren't single plain words."""
    _, phrases, indic = _ways(term)
    return (bool(phrases) and any(f" {p} " in f" {' '.join(_PLAIN.findall(text))} " for p in phrases)) or any(x in text for x in indic)


def heard(voc: _Vocabulary, row: np.ndarray, found: np.ndarray, actual: pa.Array, pieces: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of the terms (row, number) the text of their row says in any of the ways in which they are written.  pieces: those of the texts."""
    here = np.arange(len(row))
    said_row, said = voc.said.given(*pieces)
    at, way = voc.ways.given(here, found)
    begun_at, pair = voc.pairs.given(here, found)
    n = len(voc.plain)
    met, begun = np.zeros(len(row), bool), np.zeros(len(row), bool)
    met[at[_among(np.sort(said_row * n + said), row[at] * n + way)]] = True
    if len(pair):
        # phrases whose first two words follow each other in the text; a phrase of two is thereby found
        follow = np.sort((said_row[:-1] * n * n + said[:-1] * n + said[1:])[said_row[:-1] == said_row[1:]])
        begun[begun_at[_among(follow, row[begun_at] * n * n + (pair >> 32) * n + (pair & 0xFFFFFFFF))]] = True
    long, indic = voc.long.given(here, found)[1] == 1, voc.indic.given(here, found)[1] == 1
    met |= begun & ~long
    # letters of Devanagari are none of ASCII
    plain = pc.fill_null(pc.string_is_ascii(actual), True).to_numpy(zero_copy_only=False)
    left = np.flatnonzero(~met & ((begun & long) | (indic & ~plain[row])))
    terms = list(voc.terms) if len(left) else []
    last, text = -1, ""
    for i in left.tolist():
        if row[i] != last:
            last = row[i]
            text = (actual[int(last)].as_py() or "").lower()
        met[i] = _in_other_ways(terms[found[i]], text)
    return met


@F.arrow_udf(HEARD)
def _heard_terms(terms: pa.Array, actual: pa.Array) -> pa.Array:
    out = []
    for some in stretches(pc.fill_null(pc.binary_length(actual), 0).to_numpy(zero_copy_only=False), 8_000_000):
        wanted, said, voc = terms[some], actual[some], vocabulary()
        sizes, coded = _lengths(wanted), wanted.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        row, at = np.repeat(np.arange(len(sizes)), sizes), pc.fill_null(coded.indices, len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
        first = _firsts(row, at, len(names) + 1)
        row, at = row[first], at[first]
        n = np.bincount(row, minlength=len(sizes))
        real = at < len(names)  # a null counts and is never heard
        row, at = row[real], at[real]
        met = heard(voc, row, np.array(voc.terms.of(names), np.int64)[at], said, _pieces(voc, said))
        unknown = wanted.is_null()
        hits = pa.ListArray.from_arrays(_places(np.bincount(row[met], minlength=len(sizes))), coded.dictionary.cast(pa.string()).take(pa.array(at[met])), mask=unknown)
        out.append(pa.StructArray.from_arrays([pa.array(n.astype(np.int32), mask=unknown.to_numpy(zero_copy_only=False)), hits], ["n", "hits"]))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([("n", pa.int32()), ("hits", pa.list_(pa.string()))]))


def heard_terms(terms: Column, actual: Column) -> Column:
    """struct(n, hits): how many different terms there are, and those that a text says in any of the ways in which they are written.

    One with Devanagari letters is looked up as a substring, any other as whole words in one of its variants.
    """
    return _heard_terms(terms, actual)


FIGURES = ("errors", "copied", "wanted", "met", "terms", "heard")
RUN = T.StructType([T.StructField(n, T.IntegerType()) for n in FIGURES])


@F.arrow_udf(RUN)
def _run_counts(ref: pa.Array, hyp: pa.Array, gold: pa.Array, actual: pa.Array, given: pa.Array) -> pa.Array:
    out = []
    for some in stretches(_lengths(ref) + _lengths(hyp)):
        a, b, voc = ref[some], hyp[some], vocabulary()
        codes = voc.codes(pa.concat_arrays([a.flatten(), b.flatten()]).cast(pa.string()))
        low, m, k = voc.lower(codes), _lengths(a), _lengths(b)
        cut = len(codes) - k.sum()
        errors, copied = coded_distances((low[:cut], m), (low[cut:], k)), longest_copies(low[cut:], k, range(2, 9))
        wanted, met = concept_counts(voc, (codes[:cut], m), np.arange(len(m)), (codes[cut:], k))
        row, found = terms_of(voc, _pieces(voc, gold[some], a, codes[:cut]), given[some])
        said = heard(voc, row, found, actual[some], _pieces(voc, actual[some], b, codes[cut:]))
        n = some.stop - some.start
        unknown = pc.or_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
        figures = (errors, copied, wanted, met, np.bincount(row, minlength=n), np.bincount(row[said], minlength=n))
        out.append(pa.StructArray.from_arrays([pa.array(x.astype(np.int32), mask=unknown if f in ("wanted", "met") else None) for f, x in zip(FIGURES, figures, strict=True)], list(FIGURES)))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([(f, pa.int32()) for f in FIGURES]))


def run_counts(ref: Column, hyp: Column, gold: Column, actual: Column, terms: Column | None = None) -> Column:
    """struct(errors, copied, wanted, met, terms, heard) of a text's words against those of its reference: what ``word_errors``, ``repeated_ngram_score``,
    ``concept_coverage``, ``expected_terms`` and ``heard_terms`` count, case not counting, with words moved and looked up once for all of them."""
    return _run_counts(ref, hyp, gold, actual, F.lit(None).cast("string") if terms is None else terms)


def scripts(text: Column) -> Column:
    """The scripts other than Latin that a text has, of Devanagari, Arabic and Han."""
    return F.array_compact(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(n)) for n, p in SCRIPTS.items()]))


def language_preservation(gold: Column, actual: Column) -> Column:
    """Share of the reference's scripts that the transcript has; 1 where it has none but Latin."""
    return let(scripts(gold), lambda want: F.when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(want, scripts(actual))) / F.size(want)))


def mixed_language(category: Column, gold: Column) -> Column:
    low = F.lower(F.coalesce(category, F.lit("")))
    return reduce(or_, [F.contains(low, F.lit(x)) for x in MIXED_CATEGORIES]) | F.coalesce(gold, F.lit("")).rlike(r"[\x{0900}-\x{097F}\x{4E00}-\x{9FFF}]")


def truthy(flag: Column) -> Column:
    """Whether a flag written as text, number or boolean is set."""
    text = F.lower(F.trim(F.coalesce(flag.cast("string"), F.lit(""))))
    return text.isin(*TRUE_WORDS) | F.coalesce(text.try_cast("double") != 0, F.lit(False))


def critical_error(actual: Column, flags: Column | None = None, marks: tuple[Column, ...] = (), errors: tuple[Column, ...] = ()) -> Column:
    """Whether a transcript must not be used: it tells of a failure, or a flag, a mark that is set or an error says so.

    flags: text parted by commas, semicolons or blanks; marks: text, numbers or booleans; errors: arrays of texts.
    """
    said = F.lower(F.trim(F.coalesce(actual, F.lit(""))))
    tests = [said.startswith(FAILED_START), said.isin(*FAILED_TEXTS), *[truthy(m) for m in marks]]
    tests += [F.coalesce(F.exists(e, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), F.lit(False)) for e in errors]
    if flags is not None:
        tests.append(F.arrays_overlap(F.split(F.lower(F.coalesce(flags, F.lit(""))), r"[,;\s]+"), listed(CRITICAL_FLAGS)))
    return reduce(or_, tests)
