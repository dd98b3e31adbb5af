"""Devanagari in Latin letters, and one spelling for roman Hindi.

Consonants carry an a, which a vowel sign behind them replaces and a virama takes away.  So every consonant first gets
an a, behind the h that aspirated ones have, then signs swallow the a before them, and last each code point becomes its letter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import filled, stripped

# Code points of Devanagari and the letters that stand for them without marks.
CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ", "kkggnccjjnttddnttddnppbbmyrlvssshl", strict=True))
#: Letters with a dot below, each as one code point and as a letter with the dot behind it.
DOTTED = dict(zip("\u0958\u0959\u095a\u095b\u095c\u095d\u095e\u095f\u0929\u0931\u0934", (x + "\u093c" for x in "कखगजडढफयनरळ"), strict=True))
DOTTED_LETTERS = dict(zip(DOTTED, "qkgzrrfynrl", strict=True))
ASPIRATED = "खघछझठढथधफभ\u0959\u095d"
VOWELS = dict(zip("अआइईउऊऋॠऌएऍऎओऑऒ", "aaiiuurrleeeooo", strict=True))
SIGNS = dict(zip("ािीुूृॄॢॣेॅॆोॉॊ", "aiiuurrlleeeooo", strict=True))
TWO = {"ऐ": "ai", "औ": "au", "ै": "ai", "ौ": "au", "ॐ": "om", "॥": ".."}
MARKS = dict(zip("ंँः।॰०१२३४५६७८९", "mmh..0123456789", strict=True))
SILENT = "\u093c\u094d\u093d\u200c\u200d"
WORDS_FIRST = {"हाँ": "haan", "हां": "haan", "नहीं": "nahi"}
# Words as people write them, for what the letters give, in order.
SPOKEN = dict(
    pair.split(":")
    for pair in """
    dekha:dekh vaha:woh saba:sab karane:karne karake:karke kucha:kuch nahim:nahi agara:agar hamem:humein para:par usake:uske satha:saath
    vagairaha:vagairah apako:aapko apa:aap karana:karna hara:har kama:kaam alagaalaga:alag_alag cahie:chahiye sakata:sakta isamem:ismein
    mem:mein matalaba:matlab batem:baatein paemgi:payengi aura:aur yaha:yeh dem:den
    """.split()
)
# Other spellings of roman Hindi words.
SPELLINGS = {
    "chaahie": "chahiye", "chaahiye": "chahiye", "hamaara": "hamara", "hamein": "hame", "hamen": "hame", "havaavaaji": "hawabaazi",
    "hawaabaazi": "hawabaazi", "kuchh": "kuch", "paega": "payega", "thik": "theek", "vichaar": "vichar",
}

_SINGLE = CONSONANTS | DOTTED_LETTERS | VOWELS | SIGNS | MARKS
FROM = "".join(_SINGLE) + SILENT
TO = "".join(_SINGLE.values())
LETTER = "".join(CONSONANTS) + "".join(DOTTED_LETTERS)
SIGN = "".join(SIGNS) + "ैौ्"
INDIC = r"[\x{0900}-\x{097F}]"


def transliterated(text: Column) -> Column:
    """Devanagari of a text as Latin letters, everything else as it is."""
    for single, dotted in DOTTED.items():
        text = F.replace(text, F.lit(dotted), F.lit(single))
    text = F.regexp_replace(text, f"([{ASPIRATED}])", "$1h")
    text = F.regexp_replace(text, f"([{LETTER}]h?)", "$1a")
    text = F.regexp_replace(text, f"a([{SIGN}])", "$1")
    text = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), TWO.items(), text)
    return F.translate(text, FROM, TO)


def respelled(text: Column) -> Column:
    """Words of SPOKEN in the spelling people use, in any case; other word characters beside them keep a word from being one."""
    return reduce(lambda t, kv: F.regexp_replace(t, rf"(?iU)\b{kv[0]}\b", kv[1].replace("_", " ")), SPOKEN.items(), text)


def romanized(text: Column) -> Column:
    """A text with its Devanagari in Latin letters and spoken spelling, white space squeezed; as it is without Devanagari."""
    prepared = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), WORDS_FIRST.items(), filled(text))
    return F.when(filled(text).rlike(INDIC), stripped(F.regexp_replace(respelled(transliterated(prepared)), r"(?U)\s+", " "))).otherwise(filled(text))


def one_spelling(text: Column) -> Column:
    """Roman Hindi words of SPELLINGS in one spelling; a capital first letter stays one."""
    text = filled(text)
    for word, kept in SPELLINGS.items():
        text = F.regexp_replace(text, rf"(?U)\b{word[0].upper()}(?i:{word[1:]})\b", kept.capitalize())
        text = F.regexp_replace(text, rf"(?U)\b{word[0]}(?i:{word[1:]})\b", kept)
    return text
