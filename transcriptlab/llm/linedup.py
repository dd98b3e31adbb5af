"""Line dedup by site-relative frequency, in DataFrame functions only.

Lines are grouped by host; the pages that contain a line are divided by the host's page total, and lines
above a boilerplate ratio are dropped from every page of that host.  A line is compared without its outer
blanks; a page counts once for a line however often it repeats it; blank lines are never dropped.

Cases: a null text stays null (its page counts in the host's total); an empty text stays empty; a page
whose lines all go keeps an empty text; repeated rows are pages of their own; a null host is a host;
lines of any length are compared by a 64-bit hash within their host; an empty table gives an empty result; extra
columns pass through whatever their names, and counts replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

#: A line that a template puts on a tenth of a site's pages is boilerplate.  The cut is half of that, so that a host on which
#: chance lowers the line's share still loses it; the same for all sizes.
#: On a host of one or two pages every line passes any ratio, though nothing repeats; so a line must be on three pages.
RATIO, MIN_PAGES = 0.05, 3
#: Up to so many (host, line) pairs, 16 bytes each, are broadcast; beyond that they are joined by line.
BROADCAST_PAIRS = 200_000
#: Of one host at most so many, as each of its lines is looked for among them.
MOST_OF_HOST = 2_000
SALTS = 16


def _host(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _keys(lines: Column) -> Column:
    """Hashes of the lines that aren't blank, each once."""
    return F.array_distinct(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.xxhash64(F.trim(x))))


def boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, text: str = "text", host: str = "source") -> DataFrame:
    """(_host, _line): hashes of the lines in more than ``ratio`` of their host's pages, and in ``min_pages`` at least."""
    totals = docs.groupBy(_host(host).alias("_host")).agg(F.count("*").alias("_pages"))
    seen = docs.select(_host(host).alias("_host"), F.explode(_keys(_lines(text))).alias("_line")).groupBy("_host", "_line").agg(F.count("*").alias("_with")).filter(F.col("_with") >= min_pages)
    return seen.join(totals, "_host").filter(F.col("_with") > ratio * F.col("_pages")).select("_host", "_line")


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, text: str = "text", host: str = "source", broadcast_pairs: int = BROADCAST_PAIRS, counts: bool = False) -> DataFrame:
    """docs without the boilerplate lines of each host; with ``counts``, also n_lines and n_dropped."""
    found = checkpoint(boilerplate(docs, ratio, min_pages, text, host))
    # the input row as one column, so that its names can't clash with those used here
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    pages = docs.select(whole, _host(host).alias("host"), F.col(text).alias("text"))
    sizes = found.groupBy("_host").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    # At most (lines a page) / ratio pairs a host: small beside the pages, but growing with the hosts.
    if (sizes.n or 0) <= broadcast_pairs and (sizes.most or 0) <= MOST_OF_HOST:
        drops = found.groupBy(F.col("_host").alias("host")).agg(F.collect_set("_line").alias("gone"))
        marked = pages.join(F.broadcast(drops), "host", "left")
    else:
        # Boilerplate is frequent by nature: its pairs are dealt over salts, that of a page's line comes from its text.
        key = F.struct("host", F.xxhash64("text").alias("x"), F.length("text").alias("n"))
        keyed = pages.withColumn("key", key)
        lines = keyed.select("key", "host", F.pmod(F.col("key.x"), F.lit(SALTS)).alias("salt"), F.explode(_keys(_lines("text"))).alias("line"))
        dealt = found.select(F.col("_host").alias("host"), F.col("_line").alias("line"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        # a list for each text, of its own lines: pages with the same text share it
        drops = lines.join(dealt, ["host", "line", "salt"]).groupBy("key").agg(F.collect_set("line").alias("gone"))
        marked = keyed.join(drops.hint("shuffle_hash"), "key", "left")
    lines = _lines("text")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains("gone", F.xxhash64(F.trim(x))))
    new = {text: F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))}
    if counts:
        new["n_lines"] = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
        new["n_dropped"] = F.when(F.col("text").isNull() | F.col("gone").isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long")
    made = marked.select("row", F.struct(*[v.alias(c) for c, v in new.items()]).alias("made"))
    names = [*docs.columns, *[c for c in new if c not in docs.columns]]
    return made.select(*[F.col("made" if c in new else "row").getField(c).alias(c) for c in names])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=True)


OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, "text" FROM documents),
l AS (SELECT rid, source, unnest(string_split("text", chr(10))) AS line, generate_subscripts(string_split("text", chr(10)), 1) AS pos FROM d),
f AS (SELECT source, trim(line, ' ') AS line, count(DISTINCT rid) AS c FROM l WHERE trim(line, ' ') <> '' GROUP BY 1, 2),
t AS (SELECT source, count(*) AS n FROM d GROUP BY 1),
b AS (SELECT f.source, f.line FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source WHERE c >= {MIN_PAGES} AND c > {RATIO} * n),
k AS (SELECT l.rid, l.pos, l.line, b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line, ' ') = b.line),
r AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS "text", count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped FROM k GROUP BY rid)
SELECT d.doc_id, d.source, r."text", coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_dropped, 0) AS n_dropped FROM d LEFT JOIN r ON d.rid = r.rid
"""


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without boilerplate lines, n_chars counted anew; documents that have nothing left stay, empty."""
    return drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long"))
