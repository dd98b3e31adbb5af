"""Readers and sinks of transcript tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTEMPT = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("created_at", T.TimestampType()), T.StructField("mode", T.StringType()), T.StructField("status", T.StringType()), T.StructField("error_type", T.StringType()),
    T.StructField("raw_text", T.StringType()), T.StructField("corrected_text", T.StringType()), T.StructField("pasted_text", T.StringType()), T.StructField("audio_path", T.StringType()), T.StructField("release_to_paste_seconds", T.DoubleType()),
])
CLIP = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "audio", "gold", "source", "category", "language")] + [T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("benchmarks", T.MapType(T.StringType(), T.StringType()))])


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the folder that spark.checkpoint.dir names; in one of our own if that is unset and Spark runs in one process."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; lines that aren't objects of this shape are left out."""
    rows = spark.read.schema(T.StructType([*ATTEMPT.fields, T.StructField("_corrupt_record", T.StringType())])).json(path, mode="PERMISSIVE")
    return rows.filter("_corrupt_record IS NULL").drop("_corrupt_record")


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of clips; those without audio or reference text are left out."""
    return spark.read.schema(CLIP).json(path, multiLine=True).filter((F.coalesce(F.trim("gold"), F.lit("")) != "") & (F.coalesce(F.trim("audio"), F.lit("")) != ""))


def append_attempts(df: DataFrame, path: str) -> None:
    df.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def append_events(df: DataFrame, path: str) -> None:
    """Events (event, run_id, created_at, fields) as JSON lines by day."""
    df.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").json(path)


def write_results(df: DataFrame, path: str, batch: str) -> None:
    """Results of a batch, all of them or none; a batch that is written again replaces itself, others stay.

    A reader sees a batch only once its files are committed, so that a job which is stopped goes on with the batches that lack.
    """
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def upsert_clips(base: DataFrame, delta: DataFrame) -> DataFrame:
    """base with delta's values where it has them, and delta's new clips; benchmark texts are merged by name."""
    b, d = base.alias("b"), delta.alias("d")
    plain = [c for c in base.columns if c not in ("id", "benchmarks")]
    maps = F.map_concat(F.map_filter(F.coalesce("b.benchmarks", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("d.benchmarks", F.create_map().cast("map<string,string>"))), k)), F.coalesce("d.benchmarks", F.create_map().cast("map<string,string>")))
    return b.join(d, F.col("b.id") == F.col("d.id"), "full").select(F.coalesce("b.id", "d.id").alias("id"), *[F.coalesce(f"d.{c}", f"b.{c}").alias(c) for c in plain], maps.alias("benchmarks"))


def load_dictionary(dictionary: DataFrame, memory: DataFrame) -> DataFrame:
    """(alias, canonical): approved memory terms go before the dictionary, the first canonical of an alias wins."""
    fixed = dictionary.select("canonical", "aliases", F.lit(1).alias("order"))
    learnt = memory.filter(F.col("enabled") & F.col("status").isin("auto", "approved")).select("canonical", "aliases", F.lit(0).alias("order"))
    each = fixed.unionByName(learnt).select("canonical", "order", F.explode(F.array_union(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    first = Window.partitionBy(F.lower("alias")).orderBy("order", "canonical")
    return each.withColumn("n", F.row_number().over(first)).filter("n = 1").select(F.lower("alias").alias("alias"), "canonical")
