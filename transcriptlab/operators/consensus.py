"""Reference texts chosen from what several systems heard.

Candidates of a clip meet each other in its row or by an equi-join on the clip, so a clip makes as many pairs as the square
of its number of systems.  Likeness of texts comes from an alignment of their letters, in batches inside tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alignment
from ..functions.alignment import likeness

# Words that show that an English clip was heard in another language.
FOREIGN = ("sieht", "gut", "aus", "nicht", "danke", "bonjour", "gracias")


def comparable(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def similarity(a: Column, b: Column) -> Column:
    """Matched characters of the longest matching blocks, as a share of both texts; case and punctuation don't count."""
    return likeness(comparable(a), comparable(b))


def alike(a: Column, b: Column, least: Column) -> Column:
    """Whether the similarity is so much."""
    return alignment.alike(comparable(a), comparable(b), least)


def words_at_least(text: Column, n: int, letters: str) -> Column:
    """Whether a text has so many words of some letters; no words are made."""
    return text.rlike(f"(?:[{letters}]++[^{letters}]*+){{{n}}}")


#: A text of one or two different words at most, and one with a foreign word; both stop at the first other word.
_W, _NO = "[a-z0-9']", "[^a-z0-9']"
FEW = rf"^{_NO}*+({_W}++)(?:{_NO}++\1(?!{_W}))*+(?:{_NO}++({_W}++)(?:{_NO}++(?:\1|\2)(?!{_W}))*+)?+{_NO}*+$"
OTHER = rf"(?<![a-z'])(?:{'|'.join(FOREIGN)})(?![a-z'])"


def usable(text: Column) -> Column:
    """Whether a text has two words or more, isn't one or two words said over and over, and is in no other language."""
    low = F.lower(F.coalesce(text, F.lit("")))
    looped = low.rlike(FEW) & words_at_least(low, 8, "a-z0-9'")
    foreign = text.rlike(r"[\x{0900}-\x{097F}]") | low.rlike(OTHER)
    return F.coalesce(words_at_least(low, 2, "a-z0-9'") & ~looped & ~foreign, F.lit(False))


def draft_gold(candidates: DataFrame, weights: dict[str, float], lone: tuple[str, ...] = (), other: float = 0.5) -> DataFrame:
    """(id, text, name, support) for each clip: the candidate that those like it support most.

    candidates: id, name, text, error, one row for each clip and name.  Texts of up to 18 words must be 0.94 alike, longer
    ones 0.82.  Names in ``lone`` lose a point where only they say so.  Ties go by the order of ``weights``.  Where no
    candidate is usable, the first one with a text and no error is taken, with support 0; else the text is empty and
    the name "none".
    """
    order = list(weights)
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("name")], F.lit(other))
    place = F.coalesce(F.create_map(*[F.lit(x) for i, n in enumerate(order) for x in (n, i)])[F.col("name")], F.lit(99))
    heard = F.coalesce(F.col("error").isNull() & (F.col("text") != ""), F.lit(False))
    rows = candidates.select("id", "name", "text", heard.alias("heard"), weight.alias("weight"), place.alias("place"))
    rows = rows.withColumn("good", F.col("heard") & F.col("id").isNotNull() & usable(F.col("text")))
    # a clip's candidates are moved once and meet in its row; weights in hundredths, so that sums don't depend on their order
    voice = F.struct("name", "text", "weight", "place", F.round(F.col("weight") * 100).cast("long").alias("voice"), F.when(words_at_least(F.col("text"), 19, "A-Za-z0-9'"), 0.82).otherwise(0.94).alias("least"))
    # min_by passes over rows without an order; where any candidate is usable, the others play no part
    first = F.when(F.col("heard") & ~F.col("good"), F.struct("place", "name"))
    clips = rows.groupBy("id").agg(F.collect_list(F.when(F.col("good"), voice)).alias("good"), F.min_by(F.struct("text", "name", F.lit(0.0).alias("support")), first).alias("rest"))
    each = lambda use: F.transform("good", use)
    clips = clips.withColumn("backing", alignment.supports(each(lambda c: comparable(c["text"])), each(lambda c: c["least"]), each(lambda c: c["voice"])))

    def ranked(c: Column, voices: Column) -> Column:
        backing = voices / 100
        support = F.when(c["name"].isin(*lone) & (backing <= c["weight"]), backing - 1).otherwise(backing) if lone else backing
        return F.struct(support.alias("support"), (-c["place"]).alias("place"), c["weight"].alias("weight"), c["name"].alias("name"), c["text"].alias("text"))

    best = F.array_max(F.zip_with("good", "backing", ranked))
    none = F.struct(F.lit("").alias("text"), F.lit("none").alias("name"), F.lit(0.0).alias("support"))
    chosen = clips.withColumn("best", best).select("id", F.when(F.col("best").isNotNull(), F.struct("best.text", "best.name", "best.support")).otherwise(F.coalesce("rest", none)).alias("x"))
    return chosen.select("id", "x.text", "x.name", "x.support")


def crosscheck(offline: DataFrame, transcripts: DataFrame, least: float = 0.90) -> DataFrame:
    """(id, status, text) for each clip of ``offline`` (id, gold), held against transcripts (id, name, text, error).

    confirmed: the transcripts agree with each other and the gold text, which stays; replaces: they agree with each
    other alone, and the one nearest to the gold text is taken; failed: there is none; else needs_human_review.
    """
    good = transcripts.filter(F.col("error").isNull() & (F.col("text") != "")).select("id", "name", "text")
    near = good.join(offline.select("id", "gold"), "id").withColumn("near", similarity(F.col("text"), F.col("gold")))
    best = near.groupBy("id").agg(F.max("near").alias("near"), F.min_by("text", F.struct(-F.col("near"), "name")).alias("text"), F.count("*").alias("n"))
    pairs = good.join(good.select("id", F.col("name").alias("_name"), F.col("text").alias("_text")), "id").filter("name <> _name")
    agreed = pairs.withColumn("s", alike(F.col("text"), F.col("_text"), F.lit(least))).groupBy("id").agg(F.min("s").alias("together"))
    near_gold, together = F.col("near") >= least, F.coalesce("together", F.lit(True))
    status = F.when(F.col("n").isNull(), "failed").when(together & near_gold, "confirmed").when(together & (F.col("n") > 1), "replaces").otherwise("needs_human_review")
    kept = F.when((status == "confirmed") & (F.col("n") > 1), F.col("gold")).otherwise(F.coalesce("text", F.lit("")))
    return offline.select("id", "gold").join(best, "id", "left").join(agreed, "id", "left").select("id", status.alias("status"), kept.alias("text"))
