"""Jobs that learn corrections from what was said, meet rows by their places, and continue drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.texts import filled, split_words

# Words that are no terms; words after a correction that don't belong to it; words that make a line no correction.
TERM_STOP_WORDS = (
    "a", "an", "and", "are", "as", "auto", "balanced", "be", "because", "by", "but", "can", "cool", "do", "either", "fantastic", "for", "from", "get", "go", "got", "hello", "how", "i", "if", "in", "is", "it", "just", "let",
    "like", "me", "maybe", "more", "my", "no", "not", "now", "of", "okay", "out", "or", "right", "say", "see", "so", "that", "the", "then", "thing", "things", "this", "to", "what", "when", "where", "with", "yeah", "yes", "you", "your",
)
FILLERS = ("bro", "dude", "man", "mf", "motherfucker", "please", "pls", "yaar")
BLOCKED = ("do", "does", "did", "should", "would", "could", "cannot", "can't", "dont", "don't", "isnt", "isn't", "wasnt", "wasn't")
EDGES = r"""[ \t\r\n.,:;!?()\[\]{}"']+"""
LEAD = "^(i said|i mean|it is|that is) "
TRAIL = rf"(^| )({'|'.join(FILLERS)})( ({'|'.join(FILLERS)}))*$"
PAIR = r"^([A-Za-z0-9.+#-]+(?: [A-Za-z0-9.+#-]+){0,2}) not ([A-Za-z0-9.+#-]+(?: [A-Za-z0-9.+#-]+){0,3})$"
TERM = "[A-Za-z0-9.+#-]+"


def _edges_off(text: Column) -> Column:
    return F.regexp_replace(text, f"^{EDGES}|{EDGES}$", "")


def correction_pairs(lines: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """lines (any columns, ``line``) that say "X not Y", with ``wrong`` and ``right``; a text of several lines is to be split before.

    Lead-ins and fillers go; three words a side at most, none of which makes the line a plain statement, and not all of them stop words.
    A capitalised single word is written as ``names`` has it, else small if it corrects a single word.
    """
    line = F.regexp_replace(F.regexp_replace(_edges_off(filled(F.col("line"))), r"[ \t\r\n]+", " "), r"(?i)\bit['’]?s\b", "it is")
    line = F.trim(F.regexp_replace(F.regexp_replace(line, "[,;:]+", " "), " +", " "))
    rows = lines.withColumn("_line", F.regexp_replace(line, "(?i)" + LEAD, ""))
    rows = rows.filter((F.length("_line") <= 90) & (F.size(F.split("_line", " not ")) == 2))

    def side(group: int) -> Column:
        return _edges_off(F.regexp_extract("_line", "(?i)" + PAIR, group))

    right = F.regexp_replace(F.regexp_replace(side(1), "(?i)" + LEAD, ""), "(?i)" + TRAIL, "")
    rows = rows.withColumn("_right", right).withColumn("wrong", F.regexp_replace(side(2), "(?i)" + TRAIL, ""))
    words = lambda c: split_words(F.lower(c))
    listed = lambda values: F.array(*map(F.lit, values))
    bad = listed(FILLERS + BLOCKED)
    valid = (F.lower("_right") != F.lower("wrong")) & (F.length("_right") <= 50) & (F.length("wrong") <= 50)
    for c in ("_right", "wrong"):
        valid = valid & let(words(F.col(c)), lambda w: F.size(w).between(1, 3) & ~F.arrays_overlap(w, bad) & (F.size(F.array_except(w, listed(TERM_STOP_WORDS))) > 0))
    known = F.create_map(*[F.lit(x) for kv in (names or {"": ""}).items() for x in kv])[F.lower("_right")]
    written = F.when(F.col("_right").rlike("^[A-Z][a-z]+$"), F.coalesce(known, F.when(F.contains("wrong", F.lit(" ")), F.col("_right")).otherwise(F.lower("_right")))).otherwise(F.col("_right"))
    return rows.filter(valid).withColumn("right", written).drop("_line", "_right")


def learn_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, source, replacement): corrections of a conversation that are safe to learn.

    turns: conv_id, turn, line.  A pair of single words that are unlike, and not names, is learnt only with two words before and three after it in the last turn that
    corrects nothing; it is left out where that doesn't hold the wrong word.
    """
    pairs = correction_pairs(turns.select("conv_id", "turn", "line")).select("conv_id", "turn", "wrong", "right")
    all_turns = turns.select("conv_id", "turn", "line").join(pairs, ["conv_id", "turn"], "left")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = all_turns.withColumn("said", F.last(F.when(F.col("wrong").isNull(), F.coalesce("line", F.lit(""))), ignorenulls=True).over(before)).filter("wrong IS NOT NULL")
    name = lambda c: F.col(c).rlike("[0-9.+#-]|[A-Z].*[A-Z]")
    phrase = F.contains("wrong", F.lit(" ")) | F.contains("right", F.lit(" "))
    safe = phrase | name("wrong") | name("right") | (F.levenshtein(F.lower("wrong"), F.lower("right")) <= 2)
    rows = rows.withColumn("_words", F.regexp_extract_all(filled(F.col("said")), F.lit(TERM), F.lit(0)))
    rows = rows.withColumn("_at", F.array_position(F.transform("_words", F.lower), F.lower("wrong")).cast("int"))
    first = F.greatest(F.lit(1), F.col("_at") - 2)
    head, tail = F.slice("_words", first, F.col("_at") - first), F.slice("_words", F.col("_at") + 1, F.lit(3))
    around = lambda w: F.array_join(F.concat(head, F.array(w), tail), " ")
    rows = rows.filter(safe | (F.col("_at") > 0))
    source = F.when(safe, F.col("wrong")).otherwise(around(F.get("_words", F.col("_at") - 1)))
    replacement = F.when(safe, F.col("right")).otherwise(around(F.col("right")))
    return rows.select("conv_id", "turn", source.alias("source"), replacement.alias("replacement"))


def positional_join(left: DataFrame, right: DataFrame, group: str, order: str) -> DataFrame:
    """(group, place, left, right): the nth row of each group of ``left`` with the nth of ``right``, by the column ``order``; -1 for none."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    a = left.select(group, place.alias("place"), F.col(order).alias("left"))
    b = right.select(group, place.alias("place"), F.col(order).alias("right"))
    return a.join(b, [group, "place"], "full").fillna(-1, ["left", "right"])


def newest_of_kinds(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """A row for each user: the newest event of each kind (-1: none), and whether all kinds are there."""
    newest = [F.coalesce(F.max_by("event_id", F.when(F.col("event_type") == k, F.struct("ts", "event_id"))), F.lit(-1)).alias(k) for k in kinds]
    rows = events.groupBy("user_id").agg(*newest)
    complete = F.lit(True)
    for k in kinds:
        complete = complete & (F.col(k) >= 0)
    return rows.withColumn("complete", complete)


def chunk_totals(segments: DataFrame) -> DataFrame:
    """Chunks of each recording, the longest computing time, and whether computing keeps up with every chunk."""
    return segments.groupBy("conv_id").agg(F.count("*").alias("chunks"), F.max("compute").alias("longest"), F.bool_and(F.col("compute") <= F.col("duration")).alias("keeps_up"))


def corpus_stats(clips: DataFrame) -> DataFrame:
    return clips.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("trust") == "gold").alias("gold"), F.count_if(F.col("trust") == "needs_human_review").alias("to_review"), F.round(F.max("audio_seconds"), 3).alias("longest"), F.countDistinct("source").alias("sources"))


def ranked_by_keywords(clips: DataFrame, signals: tuple[str, ...], others: tuple[str, ...], k: int) -> DataFrame:
    """The first k clips of each category by words found (signals count five times), then length, then id."""
    words = F.array_distinct(F.transform("toks", F.lower))
    hits = lambda names: F.size(F.array_intersect(words, F.array(*map(F.lit, names))))
    rows = clips.select("category", "doc_id", "audio_seconds", (5 * hits(signals) + hits(others)).alias("score"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.col("score").desc(), F.col("audio_seconds").desc(), "doc_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("category", "rank", "doc_id", "score")


def tail_anchor(draft: Column, tail: Column, least: int = 4, most: int = 9, last: int = 30) -> Column:
    """The longest run of 4 to 9 words of ``tail`` that stands in the last 30 words of ``draft``: a struct of its length, its place in the
    draft and the place of its end in the tail, the last of equals; null without one."""

    def runs(d: Column, t: Column, w: int) -> Column:
        starts = lambda words, low: F.when(F.size(words) - w + 1 >= low, F.sequence(low, F.size(words) - w + 1)).otherwise(F.array().cast("array<int>"))
        spots = starts(d, F.greatest(F.lit(1), F.size(d) - last + 1))
        same = lambda i: F.transform(F.filter(spots, lambda j: F.slice(d, j, F.lit(w)) == F.slice(t, i, F.lit(w))), lambda j: F.struct(F.lit(w).alias("length"), j.alias("draft_at"), (i + w - 1).alias("tail_end")))
        return F.array_max(F.flatten(F.transform(starts(t, F.lit(1)), same)))

    return let(draft, lambda d: let(tail, lambda t: F.coalesce(*[runs(d, t, w) for w in range(most, least - 1, -1)])))


def continue_drafts(rows: DataFrame, least: int = 4, most: int = 22) -> DataFrame:
    """(doc_id, outcome, appended): what a second decoding of the end adds to a draft.  rows: doc_id, draft, tail (arrays of words).

    no-overlap: they share no run of words; no-new-tail: under 4 words follow it; append-too-long: over 22 do; else merged.
    """
    found = rows.withColumn("_a", tail_anchor(F.col("draft"), F.col("tail"))).withColumn("_new", F.slice("tail", F.col("_a.tail_end") + 1, F.size("tail")))
    outcome = F.when(F.col("_a").isNull(), "no-overlap").when(F.size("_new") < least, "no-new-tail").when(F.size("_new") > most, "append-too-long").otherwise("merged")
    return found.select("doc_id", outcome.alias("outcome"), F.when(outcome == "merged", F.array_join("_new", " ")).otherwise("").alias("appended"))
