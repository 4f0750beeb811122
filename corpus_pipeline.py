"""A training-data pipeline over the documents table, each stage one operator of gatescan.llm.

A stage is a function of (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of documents (and any others that the table has). An empty table gives an empty result. run() writes each stage as Parquet in the shared checkpoint folder and reads it again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatescan.llm import chunks, jaccard, language, packing, secrets, substrings
from gatescan.llm.queries import vocabulary

_TEMPORARY = "__stage"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those without a letter (or without text). If no language is learned, the others stay."""
    model = language.train(docs.where(~language.held_out()))
    if not model.languages:
        return docs.where(language.lettered("text"))
    found = language.predict(docs, model, keep=docs.columns, suffix=_TEMPORARY)
    return found.where(F.col("lang_pred" + _TEMPORARY) != language.UNKNOWN).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays. Rows with a null id stay. Rows of one id are one
    document: all of them stay or go."""
    with chunks.temporary_tables(spark):
        gone = chunks.checkpoint(jaccard.link_components(docs).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a repeated window go; a text without any stays as it is. Emptied documents stay, with empty text."""
    found = substrings.remove_repeats(docs, suffix=_TEMPORARY)
    changed = F.col("n_removed" + _TEMPORARY) > 0
    text = F.when(changed, F.col("kept_text" + _TEMPORARY)).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("kept_text" + _TEMPORARY).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).withColumn("text", text).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret is replaced by a mark."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences that hold all documents."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Packing and the near-duplicate components are no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; the rows of the last."""
    chunks.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
