"""A second decoding that is still behind, with what its draft has beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alignment import common_blocks
from ..functions.columns import let
from ..functions.roman import romanized
from ..functions.texts import stripped

# How a complete answer ends, in Latin letters.
COMPLETE = tuple(f"{first} mein {second} {last}" for last in ("de", "den") for first in ("sankshipt", "samksipta") for second in ("uttar", "uttara"))
WORD = "[A-Za-z0-9']+"


def plain_word(word: Column) -> Column:
    """A word for comparison: lower case, no apostrophes around it, no possessive or plural s."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(word), "^'+|'+$", ""), "'s$", "")
    return F.when(F.length(bare) > 3, F.regexp_replace(bare, "s$", "")).otherwise(bare)


def plain_words(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), plain_word), lambda w: w != "")


def behind(text: Column, n: Column) -> Column:
    """What stands behind the nth word of a text that isn't empty for comparison."""
    pieces = F.regexp_extract_all(text, F.lit(f"({WORD})([^A-Za-z0-9']*)"), F.lit(0))

    def rest(p: Column) -> Column:
        counted = F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: plain_word(F.regexp_extract(F.element_at(p, i), WORD, 0)) != "")
        own = F.element_at(counted, n)
        return F.concat(F.regexp_replace(F.element_at(p, own), f"^{WORD}", ""), F.array_join(F.slice(p, own + 1, F.size(p)), ""))

    return let(pieces, rest)


def ends_complete(text: Column) -> Column:
    said = F.regexp_replace(F.regexp_replace(F.lower(romanized(text)), "[ .,!?:;]+$", ""), r"\s+", " ")
    return said.rlike("(" + "|".join(COMPLETE) + ")$")


def merge_tails(rows: DataFrame, draft: str = "draft", text: str = "text", pending: str = "pending") -> DataFrame:
    """rows with ``merged``: text, and behind it what the draft says after the last stretch that both share.

    Nothing is added if no chunk is pending and the text ends as a complete answer or covers the draft (over half of its words, the last
    too); if text or draft have under 2 or 4 words; if fewer than 3 words are shared and no stretch of two ends within one word of the
    text's end; or if under two words are left of the draft.  Null texts count as empty.
    """
    draft_, text_ = stripped(F.col(draft)), stripped(F.col(text))
    words = rows.withColumn("_m", F.struct(draft_.alias("d"), text_.alias("t"), plain_words(text_).alias("a"), plain_words(draft_).alias("b")))
    aligned = words.withColumn("_blocks", common_blocks(F.col("_m.a"), F.col("_m.b")))
    d, t, n, m = F.col("_m.d"), F.col("_m.t"), F.size("_m.a"), F.size("_m.b")
    matched = F.aggregate("_blocks", F.lit(0), lambda s, x: s + x["size"])
    last = F.aggregate("_blocks", F.lit(0), lambda s, x: F.greatest(s, x["b"] + x["size"]))
    # from the end of the text, or two words and more: where the draft goes on
    goes_on = F.aggregate("_blocks", F.lit(0), lambda s, x: F.when((x["size"] >= 2) | (x["a"] + x["size"] >= n - 2), F.greatest(s, x["b"] + x["size"])).otherwise(s))
    at_end = F.exists("_blocks", lambda x: (x["size"] >= 2) & (x["a"] + x["size"] >= n - 1))
    covers = (m >= 4) & (n >= 4) & (matched / F.greatest(m, F.lit(1)) >= 0.55) & (last >= m)
    done = (F.coalesce(F.col(pending), F.lit(0)) == 0) & (ends_complete(t) | covers)
    fits = (t != "") & (d != "") & ~done & (n >= 2) & (m >= 4) & ((matched >= 3) | at_end) & (goes_on > 0) & (goes_on < m)
    tail = F.when(fits, F.regexp_replace(stripped(behind(d, goes_on)), r"^[ ,.;:-]+", ""))
    joined = F.concat(F.regexp_replace(t, "[ ,]+$", ""), F.lit(" "), F.regexp_replace(F.col("_tail"), "^[ ,]+", ""))
    enough = F.size(F.regexp_extract_all("_tail", F.lit(r"\S+"), F.lit(0))) >= 2
    return aligned.withColumn("_tail", tail).withColumn("merged", F.when(F.coalesce(enough, F.lit(False)), joined).otherwise(t)).drop("_m", "_blocks", "_tail")
