"""A training corpus from documents: filter, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir), with docs as the stage before left them, and returns a
DataFrame; all but the last return the columns of documents, further ones too, whatever their names.
No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerlens.llm import jaccard, mixing, packing, passages, toxicity
from kmerlens.llm.common import staged, tasks_for


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier calls toxic; it learns from labels of these docs. Null
    and empty texts are judged as texts without words; where nothing can be learned all rows stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model).coalesce(tasks_for(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones: that of the smallest doc_id (a null one last),
    and one of rows that repeat doc_id and text. Null texts and texts without words all stay."""
    return jaccard.one_of_each(docs).coalesce(tasks_for(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages cut from all documents but that of the smallest doc_id; n_chars follows the
    text. Null texts stay null and keep their n_chars; a text of which nothing is left is empty."""
    left = passages.without_passages(docs, passages.repeated_passages(docs))
    return left.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns).coalesce(tasks_for(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, which is not at all for those without words; rows
    that repeat each other share their copies."""
    return mixing.repeated_by_copies(docs, mixing.mix(docs)).coalesce(tasks_for(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's tokens lies in sequences of 1,024 tokens. Copies of a document
    give pieces that repeat each other; a null or empty text is its end token alone."""
    return packing.pack(packing.tokenize(docs))


STAGES = [
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A trained classifier and seeded rounding decide what stays: SQL can't express run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
