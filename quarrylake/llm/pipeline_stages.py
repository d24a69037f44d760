"""Stages of the corpus pipeline; each applies one operator to all rows it gets.

A document is rejected only for a reason that the stage states; nulls, empty
texts and repeated rows pass through every stage with the operators' own rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, neardup, packing, secrets
from .common import stage_table
from .queries import tokenizer_path

#: A document goes when its language is unknown or less likely than this; texts that
#: mix two languages stay.
LEAST_SCORE = 0.3


def hand_over(df: DataFrame, name: str) -> DataFrame:
    """Write a stage's rows and read them again."""
    return stage_table(df, f"pipeline-{name}")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter or without a clear language go."""
    training = docs.where(~langid.held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), "text", "lang")
    model = langid.fit(training)
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    scored = langid.predict(rows, model, ["doc"], within="doc")
    if model is not None:
        scored = scored.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    else:
        scored = scored.where(F.col("doc.text").rlike(r"\p{L}"))
    return scored.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: one row of each class stays, that with the smallest id."""
    classes = stage_table(neardup.near_duplicates(docs, shingle_words=5, percent=80), "pipeline-classes")
    again = not classes.groupBy("doc_id", "row_key").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    # one row of a class: smallest id, then text; a row without a set is its own class
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    kept = classes.where("class_key is not null").groupBy("class_key").agg(first).select("first.doc_id", "first.row_key")
    kept = kept.union(classes.where("class_key is null").select("doc_id", "row_key").distinct()).toDF("_id", "_row")
    # only the struct meets the keys, so that columns of any name may be there
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").cast("long").alias("_own"), F.xxhash64("text").alias("_text"))
    rows = rows.join(kept, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_row")))
    rows = rows.dropDuplicates(["_own", "_text"]) if again else rows
    return rows.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: every span is replaced by a mark; no document goes."""
    found = secrets.scan(docs.select("doc_id", "text")).where(F.size("base") + F.size("added") > 0)
    found = found.select(F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key"), F.concat("base", "added").alias("hit_spans"))
    found = found.dropDuplicates(["hit_id", "hit_key"])
    key = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_key"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text").join(found, key, "left")
    text = F.when(F.col("hit_spans").isNotNull(), secrets.redact(F.col("text"), F.col("hit_spans"))).otherwise(F.col("text"))
    rows = rows.select("doc", text.alias("clean"))
    return rows.select(
        *[
            F.col("clean").alias(c) if c == "text"
            else F.when(F.col("doc.n_chars").isNotNull(), F.length("clean")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
            else F.col("doc")[c].alias(c)
            for c in docs.columns
        ]
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents as often, and as far, as the mix takes them."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the mixed documents as pieces of sequences."""
    return packing.pack(docs, tokenizer_path())
