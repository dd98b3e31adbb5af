"""Helpers that the operators share: tables, shared scratch, per-batch word hashing, hashing in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own if Spark runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stash(df: DataFrame) -> DataFrame:
    """Write a wider intermediate table as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of runs of non-white-space characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(texts: pa.Array, limit: int = 3_000_000) -> Iterator[pa.Array]:
    """Split a batch of texts by bytes, so that what a task holds doesn't depend on how long the texts are.

    A single text over the limit makes a slice of its own.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def word_hashes(texts: pa.Array, separators: str | None = None, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of every text, and the number of words of each text.

    Words are runs of non-white-space; ``separators`` (a regex) first turns what it matches into blanks.
    With ``prefix`` the first array has two columns: the word's hash, and that of its first characters.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if separators:
        texts = pc.replace_substring_regex(texts, pattern=separators, replacement=" ")
    words = pc.ascii_split_whitespace(texts)
    flat = words.flatten()
    offsets = words.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    coded = flat.dictionary_encode()
    values = coded.dictionary.to_numpy(zero_copy_only=False)
    known = pd.util.hash_array(values, categorize=False) if len(values) else np.zeros(0, np.uint64)
    if prefix:
        heads = pc.utf8_slice_codeunits(coded.dictionary, 0, prefix).to_numpy(zero_copy_only=False)
        known = np.stack([known, pd.util.hash_array(heads, hash_key="prefix0123456789", categorize=False) if len(values) else known], 1)
    full = np.array([v != "" for v in values], dtype=bool)
    codes = coded.indices.to_numpy().astype(np.int64)
    hashes = known[codes] if len(codes) else np.zeros((0, 2) if prefix else 0, np.uint64)
    keep = full[codes] if len(codes) else np.zeros(0, bool)
    counts = np.diff(np.concatenate([[0], np.cumsum(keep)])[offsets])
    return hashes[keep], counts


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """A number in (0, 1) from the top 53 bits of a hash."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
