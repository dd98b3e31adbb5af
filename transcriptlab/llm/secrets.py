"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule is a regex.  A Boolean query over trigrams of the lower-cased text is derived from it: every match
must contain the trigrams of at least one of the strings that the regex spells out, for each stretch that
it spells out.  The inverted index has a posting for each trigram of these queries and each text that
contains it.  The postings of a query are intersected where it asks for all trigrams of a string, and united where any of
several strings will do; what is left are the rule's candidates, which the
regex itself verifies over the whole text.  A rule that spells out no three characters (runs of hex digits)
has no query and scans every text.

Candidates are few beside the texts: their keys go to where the texts are read as long as they are so many at most
(``BROADCAST_KEYS``).  Beyond that they are joined by key, and only the spans found come back to the other rows.

Positions count code points, ends are exclusive.  Within a kind matches are leftmost and don't overlap; of
matches that fail the kind's length they are dropped after matching, as they still take up their text.

Cases: a null text is empty and has no spans; very long texts are read whole; repeated rows
each get their spans (postings belong to a doc_id and text, so equal rows share them); a null doc_id is an id; spans that start
together are ordered as the kinds are listed; an empty table gives an empty result; of extra columns only those asked for are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

# Patterns of secrets, base kinds first.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
PRIVATE_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
GITHUB = r"gh[pousr]_[A-Za-z0-9]{36,}"
SLACK = r"xox[abprs]-[A-Za-z0-9-]{10,}"
GOOGLE = r"AIza[0-9A-Za-z_-]{35}"
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: Least characters of a group, checked after matching.
    group: int = 0
    least: int = 0
    base: bool = False


RULES = (
    Rule("assign", ASSIGN, 2, 6, base=True),
    Rule("access", ACCESS, 0, 20, base=True),
    Rule("hex", HEX, base=True),
    Rule("private_key", PRIVATE_KEY),
    Rule("github", GITHUB),
    Rule("slack", SLACK),
    Rule("google", GOOGLE),
    Rule("jwt", JWT),
)

Query = list[list[frozenset[str]]]  # all of: any of: all trigrams of
#: Up to so many (doc_id, text, rules) keys, some 30 bytes each, are broadcast.
BROADCAST_KEYS = 200_000

#: What an element of a regex may be: characters (None: any of many), or the alternatives of a group; and how often.
Element = tuple[set[str] | None, list | None, int, int | None]


def parsed(regex: str) -> list[list[Element]]:
    """The alternatives of a regex, each a list of elements.

    Knows what rules are written in: characters, escapes, sets, groups, ``(?i:``, alternatives and quantifiers.
    """
    alternatives, at = _alternatives(regex, 0)
    if at != len(regex):
        raise ValueError(f"not understood from {regex[at:]!r}")
    return alternatives


def _alternatives(regex: str, at: int) -> tuple[list[list[Element]], int]:
    out: list[list[Element]] = [[]]
    while at < len(regex) and regex[at] != ")":
        if regex[at] == "|":
            out.append([])
            at += 1
            continue
        chars, group = None, None
        if regex[at] == "(":
            head = re.match(r"\((?:\?i?:)?", regex[at:])[0]
            group, at = _alternatives(regex, at + len(head))
            at += 1
        elif regex[at] == "[":
            inner = re.match(r"\[(\^?)((?:\\x[0-9A-Fa-f]{2}|\\.|[^\]\\])+)\]", regex[at:])
            at += len(inner[0])
            # ranges and negated sets are many characters
            if not inner[1] and not re.search(r".-.", inner[2]):
                chars = set(re.sub(r"\\x([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), inner[2]).replace("\\", ""))
        else:
            one = re.match(r"\\x([0-9A-Fa-f]{2})|\\(\W)|([^\\.^$*+?{}])", regex[at:])
            if one is None:
                raise ValueError(f"not understood from {regex[at:]!r}")
            chars = {chr(int(one[1], 16)) if one[1] else one[2] or one[3]}
            at += len(one[0])
        many = re.match(r"([?*+])|\{(\d+)(,?)(\d*)\}", regex[at:])
        least, most = 1, 1
        if many:
            at += len(many[0])
            if many[1]:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[many[1]]
            else:
                least = int(many[2])
                most = int(many[4]) if many[4] else None if many[3] else least
        out[-1].append((chars, group, least, most))
    return out, at


def trigram_query(regex: str, most: int = 64) -> Query:
    """The Boolean trigram query of a regex over lower-cased text; empty if nothing is mandatory."""
    clauses: Query = []

    def flush(strings: set[str]) -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if sets and all(sets):
            least = [s for s in sets if not any(t < s for t in sets)]
            clauses.append(sorted(least, key=sorted))

    def spelled(element: Element) -> set[str] | None:
        """All strings that an element can be, if they are few."""
        chars, group, least, top = element
        if (least, top) not in ((0, 1), (1, 1)):
            return None
        if group is not None:
            parts = [joined(x) for x in group]
            found = None if None in parts else set().union(*parts)
        else:
            found = None if chars is None else {c.lower() for c in chars}
        return found if found is None or least else found | {""}

    def joined(elements: list[Element]) -> set[str] | None:
        out = {""}
        for element in elements:
            part = spelled(element)
            if part is None or len(out) * len(part) > most:
                return None
            out = {a + b for a in out for b in part}
        return out

    alternatives = parsed(regex)
    if len(alternatives) > 1:
        alternatives = [[(None, alternatives, 1, 1)]]
    strings: set[str] = {""}
    for element in alternatives[0]:
        part = spelled(element)
        if part is None or len(strings) * len(part) > most:
            flush(strings)
            strings = {""} if part is None else part
        else:
            strings = {a + b for a in strings for b in part}
    flush(strings)
    return clauses


def keyed(docs: DataFrame, doc_id: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, key, text, kept): the text whole and its hash."""
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(0)
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), kept.alias("kept"))


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id, key): the postings of the given trigrams, out of (doc_id, key, text)."""
    low = docs.select("doc_id", "key", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select(F.explode(present).alias("trigram"), "doc_id", "key")


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, key, rules): texts whose postings satisfy the query of a rule; rules has a bit for each by its place."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.regex))}
    # a text's postings together: at most all trigrams of the queries
    texts = postings.groupBy("doc_id", "key").agg(F.collect_set("trigram").alias("has"))

    def every(grams: frozenset[str]) -> Column:
        return F.size(F.array_except(F.array(*map(F.lit, sorted(grams))), "has")) == 0

    def satisfied(query: Query) -> Column:
        return reduce(Column.__and__, [reduce(Column.__or__, [every(s) for s in clause]) for clause in query])

    bits = reduce(Column.__add__, [F.when(satisfied(q), F.lit(1 << i)).otherwise(F.lit(0)) for i, q in queries.items()])
    return texts.select("doc_id", "key", bits.alias("rules")).filter("rules > 0")


def spans(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<s, k, e, kind>> of a rule's matches in a text."""
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    between = F.split(text, rule.regex, -1)
    kind = "struct<s:bigint,k:int,e:bigint,kind:string>"
    empty = F.array().cast(f"array<{kind}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        own = F.struct(start.alias("s"), F.lit(number).alias("k"), end.alias("e"), F.lit(rule.kind).alias("kind"))
        keep = F.lit(True) if not rule.least else F.length(F.regexp_extract(x["1"], rule.regex, rule.group)) >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

    both = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda a, b: F.struct(a.alias("0"), b.alias("1")))
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(both, start, step, lambda acc: acc["out"])).otherwise(empty)


SPANS = "array<struct<s:bigint,k:int,e:bigint,kind:string>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, *keep, spans): all matches of all rules, by start and then by kind."""
    texts = keyed(docs, doc_id, text, keep)
    asked = {i for i, r in enumerate(rules) if trigram_query(r.regex)}
    free = [spans(F.col("text"), r, i) for i, r in enumerate(rules) if i not in asked]
    none = F.array().cast(SPANS)
    verified = [F.when(F.col("rules").bitwiseAND(F.lit(1 << i)) != 0, spans(F.col("text"), rules[i], i)).otherwise(none) for i in sorted(asked)]
    trigrams = sorted({t for i in asked for clause in trigram_query(rules[i].regex) for s in clause for t in s})
    found = checkpoint(candidates(trigram_index(texts, trigrams), rules)) if asked else None
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key"))
    if found is None:
        every = texts.select("doc_id", "kept", F.concat(*free).alias("spans"))
    elif found.count() <= broadcast_keys:
        few = found.select(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key"), "rules")
        every = texts.join(F.broadcast(few), same, "left").select("doc_id", "kept", F.concat(*free, *verified).alias("spans"))
    else:
        many = found.select(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key"), "rules")
        read = texts.join(many.hint("shuffle_hash"), same)
        hits = read.select(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key"), F.concat(*verified).alias("hits")).filter(F.size("hits") > 0)
        hits = hits.groupBy("own_id", "own_key").agg(F.first("hits").alias("hits"))  # of rows that repeat a doc_id and text
        scanned = texts.select("doc_id", "key", "kept", (F.concat(*free) if free else none).alias("own"))
        every = scanned.join(hits, same, "left").select("doc_id", "kept", F.concat("own", F.coalesce("hits", none)).alias("spans"))
    return every.select("doc_id", *[F.col("kept").getField(c).alias(c) for c in keep], F.array_sort("spans").alias("spans"))


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in RULES if r.base]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, base), F.sha2(written(F.filter("spans", lambda x: x["kind"].isin(*base))), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The same in SQL, without the index: every rule over every text."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for i, r in enumerate(RULES):
        p = quoted(r.regex)
        keep = f"length(regexp_extract(f[i], {p}, {r.group})) >= {r.least}" if r.least else "true"
        parts.append(
            f"SELECT rid, {i} AS k, '{r.kind}' AS kind, s, e FROM (SELECT rid, i, f, list_sum(list_transform(list_slice(b, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(f, 1, i - 1), lambda x: length(x))), 0) AS s, s + length(f[i]) AS e"
            f" FROM (SELECT rid, regexp_extract_all(t, {p}) AS f, string_split_regex(t, {p}) AS b, unnest(range(1, len(f) + 1)) AS i FROM d)) WHERE {keep}"
        )
    every = " UNION ALL ".join(parts)
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    entry = "concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT))"
    return (
        f"WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(\"text\", '') AS t FROM documents), m AS ({every})"
        f" SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({entry}, ',' ORDER BY s, k) FILTER (WHERE kind IN ({base})), '')) AS base_sha256,"
        f" coalesce(string_agg({entry}, ',' ORDER BY s, k) FILTER (WHERE kind IS NOT NULL), '') AS spans FROM d LEFT JOIN m USING (rid) GROUP BY d.rid, d.doc_id"
    )


OP4_SQL = _sql()
