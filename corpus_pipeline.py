"""The corpus pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as
Parquet and read again as the next stage's docs; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylake.llm import pipeline_stages as stages

STAGES = [
    ("language_id", stages.keep_identified),
    ("near_dedup", stages.keep_one_of_each_class),
    ("secret_scans", stages.redact_secrets),
    ("mixing", stages.mix_sources),
    ("packing", stages.pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stages.hand_over(stage(spark, docs, sf_dir), name) if name != STAGES[-1][0] else stage(spark, docs, sf_dir)
    return docs


#: The tokenizer and the trained classifier are beyond SQL.
ORACLE_SQL = None
