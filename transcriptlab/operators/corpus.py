"""Jobs over clips and their texts: de-duplication, sampling, matching, intervals, chunks, mining."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import common_prefix, tokens


def dedupe_by_trust(clips: DataFrame) -> DataFrame:
    """One clip for each text: the most trusted, of those the first."""
    rank = F.when(F.col("trust") == "gold", 2).when(F.col("trust") == "silver", 1).otherwise(0)
    best = clips.groupBy("gold", "category").agg(F.max_by(F.struct("id", "trust"), F.struct(rank, -F.col("doc_id"))).alias("x"), F.count("*").alias("copies"))
    return best.select("x.id", "category", "x.trust", "copies")


def placed(rows: DataFrame, by: str, order: str, ranges: int = 256) -> DataFrame:
    """rows with ``place`` (from 0, by a whole number that is unique in a group) and ``n``, the size of its group.

    A group is cut into ranges of that number; ranks within a range and counts of the ranges before give places, so no task sorts a group.
    """
    ends = rows.groupBy(F.col(by).alias("_by")).agg(F.min(order).alias("_low"), F.max(order).alias("_high"), F.count("*").alias("n"))
    cut = rows.join(ends, F.col(by).eqNullSafe(F.col("_by")))
    cut = cut.withColumn("_range", F.floor((F.col(order) - F.col("_low")) / (F.col("_high") - F.col("_low") + 1.0) * ranges).cast("int"))
    upto = Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # at most a row for each range
    sums = cut.groupBy(F.col("_by").alias("_of"), F.col("_range").alias("_at")).agg(F.count("*").alias("_m"))
    starts = sums.select("_of", "_at", F.coalesce(F.sum("_m").over(upto), F.lit(0)).alias("_before"))
    held = cut.join(starts, F.col("_by").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_at")))
    place = F.row_number().over(Window.partitionBy("_by", "_range").orderBy(order)) - 1 + F.col("_before")
    return held.select(*rows.columns, "n", place.cast("long").alias("place"))


def number_repeats(clips: DataFrame) -> DataFrame:
    """Ids made from texts; the second and later clips of a text get a numbered suffix."""
    named = placed(clips.select("doc_id", F.md5("gold").alias("key")), "key", "doc_id")
    base = F.concat(F.lit("t_"), F.substring("key", 1, 8))
    return named.select("doc_id", F.when(F.col("place") > 0, F.concat(base, F.lit("__dup"), F.col("place") + 1)).otherwise(base).alias("text_id"))


def first_wins(clips: DataFrame) -> DataFrame:
    """The first clip of each text, whatever its case."""
    return clips.groupBy(F.lower("gold").alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def even_sample(clips: DataFrame, k: int) -> DataFrame:
    """k clips of each source, evenly spaced by id; the middle one for k = 1."""
    rows = placed(clips.select("source", "doc_id"), "source", "doc_id")
    step = (F.col("n") - 1) / F.lit(max(k - 1, 1))
    wanted = F.array(*[F.bround(step * i, 0).cast("int") for i in range(k)]) if k > 1 else F.array(F.floor((F.col("n") - 1) / 2).cast("int"))
    return rows.filter(F.array_contains(wanted, F.col("place").cast("int"))).select("source", "doc_id", F.col("place").cast("int").alias("place"))


#: Prompts and their words, up to which the words' lists of prompts are broadcast; and pairs of a text and a prompt held at once.
PROMPTS, PROMPT_WORDS, HELD = 20_000, 2_000_000, 2_000_000


def best_match(texts: DataFrame, prompts: DataFrame, least: float = 0.0, most_prompts: int = PROMPTS, most_words: int = PROMPT_WORDS) -> DataFrame:
    """For each text the prompt with the largest overlap coefficient of distinct tokens, the smallest item_id on ties.

    Few prompts go to all tasks as an inverted index, and a text's own tokens say how much it shares with each.  Of many, texts meet the
    index by an equi-join on tokens, so only pairs that share a token exist.
    """
    words = lambda c: F.array_distinct(F.filter(tokens(F.col(c), "[A-Za-z0-9+#.]+"), lambda w: F.length(w) > 3))
    known = prompts.select("item_id", words("text").alias("w"))
    size = known.agg(F.count("*").alias("prompts"), F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("words")).first()
    if 0 < size["words"] <= most_words and size["prompts"] <= most_prompts:
        return _matched(texts.select("doc_id", words("text").alias("w")), known, least)
    index = known.select("item_id", F.size("w").alias("m"), F.explode("w").alias("token"))
    asked = texts.select("doc_id", words("text").alias("w")).select("doc_id", F.size("w").alias("n"), F.explode("w").alias("token"))
    shared = asked.join(index, "token").groupBy("doc_id", "item_id").agg(F.count("*").alias("common"), F.first("n").alias("n"), F.first("m").alias("m"))
    score = F.round(F.col("common") / F.greatest(F.lit(1), F.least("n", "m")), 4)
    best = shared.withColumn("score", score).filter(F.col("score") > least).groupBy("doc_id").agg(F.max_by(F.struct("item_id", "score"), F.struct("score", -F.col("item_id"))).alias("x"))
    return best.select("doc_id", "x.item_id", "x.score")


def _matched(texts: DataFrame, prompts: DataFrame, least: float) -> DataFrame:
    """best_match of texts (doc_id, w) against prompts (item_id, w) that every task holds."""
    held = prompts.orderBy("item_id").toArrow()
    lists = held["w"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(code, minlength=len(coded.dictionary))))
    parts = (coded.dictionary, owner[order], ends, lists.value_lengths().to_numpy(), held["item_id"].to_numpy())
    shared = texts.sparkSession.sparkContext.broadcast(parts)

    @F.arrow_udf(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType())]))
    def best(w: pa.Array) -> pa.Array:
        vocabulary, owners, ends, sizes, ids = shared.value
        n = w.value_lengths().to_numpy()
        code = pc.fill_null(pc.index_in(w.flatten(), value_set=vocabulary), -1).to_numpy()
        row = np.repeat(np.arange(len(w)), n)[code >= 0]
        code = code[code >= 0]
        many = ends[code + 1] - ends[code]
        item, score = np.full(len(w), -1), np.zeros(len(w))
        upto, start = np.cumsum(np.bincount(row, many, len(w))), 0
        while start < len(w):  # whole texts, as many as keep the pairs within bounds
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + HELD, side="right")))
            some = slice(*np.searchsorted(row, [start, stop]))
            r, m = np.repeat(row[some], many[some]), many[some]
            own = owners[np.repeat(ends[code[some]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
            pair, common = np.unique(r * len(ids) + own, return_counts=True)
            r, own = pair // len(ids), pair % len(ids)
            s = np.floor(common / np.maximum(np.minimum(n[r], sizes[own]), 1) * 1e4 + 0.5 + 1e-7) / 1e4
            by = np.lexsort((own, -s, r))
            first = by[np.append(True, r[by][1:] != r[by][:-1])] if len(by) else by
            item[r[first]], score[r[first]] = own[first], s[first]
            start = stop
        gone = (item < 0) | (score <= least)
        return pa.StructArray.from_arrays([pa.array(ids[item], pa.int64()), pa.array(score)], ["item_id", "score"], mask=pa.array(gone))

    return texts.select("doc_id", best("w").alias("x")).filter("x IS NOT NULL").select("doc_id", "x.item_id", "x.score")


def captions_in_window(captions: DataFrame, length: float = 12.0, cell: float = 8.0) -> DataFrame:
    """For each caption, how many captions of its recording overlap [start, start + length], ends included.

    Both sides are cut into cells of time and meet by recording and cell; the pair's first common cell counts it once.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor(b / cell)))
    left = captions.select("conv_id", "turn", F.col("start").alias("a"), (F.col("start") + length).alias("b")).withColumn("cell", cells(F.col("a"), F.col("b")))
    right = captions.select("conv_id", F.col("turn").alias("other"), "text", F.col("start").alias("c"), F.col("stop").alias("d")).withColumn("cell", cells(F.col("c"), F.col("d")))
    met = left.join(right, ["conv_id", "cell"]).filter((F.col("c") <= F.col("b")) & (F.col("d") >= F.col("a")) & (F.col("cell") == F.floor(F.greatest("a", "c") / cell)))
    return met.groupBy("conv_id", "turn").agg(F.count("*").alias("captions"), F.sum(F.length("text")).alias("chars"))


def pipeline_tail(segments: DataFrame) -> DataFrame:
    """When each recording's last chunk is done, and how long after its end.

    done = max(done, end) + compute for each chunk in turn; in closed form the running sum of compute plus the running
    maximum of end less the compute before it.
    """
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    summed = segments.withColumn("work", F.sum("compute").over(upto))
    done = F.col("work") + F.max(F.col("end") - (F.col("work") - F.col("compute"))).over(upto)
    return summed.withColumn("done", done).groupBy("conv_id").agg(F.count("*").alias("chunks"), F.round(F.max("done"), 4).alias("done"), F.round(F.greatest(F.lit(0.0), F.max("done") - F.max("end")), 4).alias("tail"))


def stable_drafts(drafts: DataFrame, least: int = 3) -> DataFrame:
    """drafts with the number of words that each shares with the one before it, stable_words; stable from ``least`` words on."""
    before = F.lag("words").over(Window.partitionBy("doc_id").orderBy("k"))
    words = F.coalesce(F.size(common_prefix(before, F.col("words"))), F.lit(0))
    shared = F.when(before.isNull(), 0).otherwise(words)
    return drafts.select("*", shared.alias("stable_words")).withColumn("stable", F.col("stable_words") >= least)


def stable_prefix(drafts: DataFrame, least: int = 3) -> DataFrame:
    """Words that each draft shares with the one before it; stable from ``least`` words on."""
    return stable_drafts(drafts, least).select("doc_id", "k", "stable_words", "stable")


def silence(frames: DataFrame, width: int = 8, level: float = 0.1) -> DataFrame:
    """Peak, largest window energy and share of silent windows of each vector of samples."""
    rows = frames.select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    windows = rows.groupBy("vec_id", F.floor(F.col("pos") / width).alias("w")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(F.abs("x")).alias("peak"))
    return windows.groupBy("vec_id").agg(F.round(F.max("peak"), 4).alias("peak"), F.round(F.max("rms"), 4).alias("max_rms"), F.round(F.avg((F.col("rms") < level).cast("int")), 4).alias("silent_ratio"))


def language_mix(docs: DataFrame) -> DataFrame:
    """Texts by the scripts that they use."""
    han, latin = F.col("text").rlike(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"), F.col("text").rlike("[A-Za-z]{2,}")
    kind = F.when(han & latin, "chinese_english").when(han, "chinese").when(latin, "english").otherwise("other")
    return docs.groupBy("lang", kind.alias("mix")).agg(F.count("*").alias("n"))


def mine_terms(docs: DataFrame, least: int = 2) -> DataFrame:
    """Acronyms, camel-case and capitalised words by the number of texts they stand in; a text counts once."""
    term = r"^([A-Z]{2,6}|[A-Z][a-z]{3,}([A-Z][a-z]+)*)$"
    found = F.array_distinct(F.filter(tokens(F.col("text"), lower=False), lambda w: w.rlike(term)))
    return docs.select(F.explode(found).alias("term")).groupBy("term").agg(F.count("*").alias("texts")).filter(F.col("texts") >= least)


def vocabulary(docs: DataFrame, least: int = 5) -> DataFrame:
    """Document frequency of lower-cased tokens of 5 letters or more."""
    words = F.array_distinct(F.filter(tokens(F.col("text")), lambda w: F.length(w) >= 5))
    return docs.select(F.explode(words).alias("token")).groupBy("token").agg(F.count("*").alias("texts")).filter(F.col("texts") >= least)


#: A line that only corrects: the right word and the wrong one.
CORRECTION = r"^([\p{L}\p{N}_]+) not ([\p{L}\p{N}_]+)$"


def correction_context(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, right, wrong, about): lines ("X not Y") of turns (conv_id, turn, line) with the last earlier turn that is no such line.

    Lines whose words differ only in case correct nothing and are left out; a null line corrects nothing.
    """
    said = turns.withColumn("corrects", F.coalesce(F.col("line").rlike(CORRECTION), F.lit(False)))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    at = F.last(F.when(~F.col("corrects"), F.col("turn")), ignorenulls=True).over(before)
    pair = lambda i: F.regexp_extract("line", CORRECTION, i)
    found = said.withColumn("about", at).filter("corrects").select("conv_id", "turn", pair(1).alias("right"), pair(2).alias("wrong"), "about")
    return found.filter(F.lower("right") != F.lower("wrong"))


def weighted_rank(ratings: DataFrame, weights: DataFrame) -> DataFrame:
    """(use, tool, score, rank) of ratings (tool, axis, rating) by weights (use, axis, weight): for each use the tools by their weighted mean.

    Axes without a weight don't count for a use; ties go by the tool's name, whatever its case.
    """
    totals = ratings.join(weights, "axis").groupBy("use", "tool").agg(F.round(F.sum(F.col("rating") * F.col("weight")) / F.sum("weight"), 4).alias("score"))
    order = Window.partitionBy("use").orderBy(F.col("score").desc(), F.lower("tool"), "tool")  # a row for each tool
    return totals.withColumn("rank", F.row_number().over(order).cast("int"))


def failure_traps(runs: DataFrame) -> DataFrame:
    """Seconds and errors by failure trap of runs (backend, seconds, error, failure_traps); a run counts in each of its traps, in "unknown" without any."""
    traps = F.when(F.size("failure_traps") > 0, F.col("failure_traps")).otherwise(F.array(F.lit("unknown")))
    each = runs.select("backend", "seconds", "error", F.explode(F.array_distinct(traps)).alias("trap"))
    return each.groupBy("backend", "trap").agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 4).alias("seconds"), F.count("error").alias("errors"))
