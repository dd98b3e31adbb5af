"""Utterances and the files they were read from, by names that are equal or hold one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a gram; shorter names are looked up whole.
GRAM = 4


def grams(text: Column, size: int) -> Column:
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def held_in(small: DataFrame, large: DataFrame, size: int = GRAM) -> DataFrame:
    """(s, l), distinct: texts of small (s) and large (l) where s stands within l.

    A small text is looked up by that of its grams which the fewest large ones have, and each match is verified; texts
    shorter than a gram by themselves.  No text is empty.
    """
    few, many = small.select("s").filter("s <> ''").distinct(), large.select("l").filter("l <> ''").distinct()
    index = many.select("l", F.explode(grams(F.col("l"), size)).alias("gram"))
    own = few.filter(F.length("s") >= size).select("s", F.explode(grams(F.col("s"), size)).alias("gram"))
    known = own.join(index.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    # a gram that no large text has rules a small one out
    key = known.groupBy("s").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    found = key.join(index, "gram").filter(F.contains("l", F.col("s"))).select("s", "l")
    for short in range(1, size):
        whole = many.select("l", F.explode(grams(F.col("l"), short)).alias("s"))
        found = found.unionByName(few.filter(F.length("s") == short).join(whole, "s").select("s", "l"))
    return found


def files_of(utterances: DataFrame, files: DataFrame) -> DataFrame:
    """utterances (id, ...) with the path of each: that of the stem which is equal to the id, else of the first that holds it or that it holds.

    files: stem, path, place.  A stem that repeats keeps its first place and its last path; null and empty names match nothing.
    """
    known = files.filter("stem <> ''").groupBy("stem").agg(F.min("place").alias("place"), F.max_by("path", "place").alias("path"))
    ids = utterances.select("id").filter("id <> ''").distinct()
    equal = ids.join(known.select(F.col("stem").alias("id"), F.col("path").alias("_equal")), "id")
    rest = ids.join(equal, "id", "left_anti")
    inside = held_in(known.select(F.col("stem").alias("s")), rest.select(F.col("id").alias("l"))).select(F.col("l").alias("id"), F.col("s").alias("stem"))
    around = held_in(rest.select(F.col("id").alias("s")), known.select(F.col("stem").alias("l"))).select(F.col("s").alias("id"), F.col("l").alias("stem"))
    first = inside.unionByName(around).join(known, "stem").groupBy("id").agg(F.min_by("path", "place").alias("_held"))
    return utterances.join(equal, "id", "left").join(first, "id", "left").withColumn("path", F.coalesce("_equal", "_held")).drop("_equal", "_held")
