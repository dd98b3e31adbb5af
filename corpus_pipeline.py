"""A training corpus from documents: toxic ones out, boilerplate lines out, one of each near copies, mixed, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from transcriptlab.llm.common import stash, table
from transcriptlab.llm.linedup import stage_line_dedup
from transcriptlab.llm.mixing import stage_mixing
from transcriptlab.llm.neardup import stage_near_dedup
from transcriptlab.llm.packing import stage_packing
from transcriptlab.llm.toxicity import stage_toxicity

STAGES = [
    ("toxicity", stage_toxicity),
    ("line dedup", stage_line_dedup),
    ("near dedup", stage_near_dedup),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: A trained classifier and hashed sketches have no SQL form; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: where each piece of each document lies.  Stages are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(docs)
    return docs
