"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import contamination, near_dedup, packing, ranking, registry, repeats, shared


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones, accepts."""
    shared.small_batches(spark)
    return ranking.accept(docs, ranking.learn(docs, shared.read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (80 % of five-word shingles): the one with the smallest id."""
    return near_dedup.keep_one(docs, percent=80)


def exact_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of 100-byte strings that occur earlier; where there is a column n_chars, it counts what is left. A null text becomes an empty one."""
    left = repeats.without_repeats(docs)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in benchmark windows."""
    return contamination.remove_documents(docs, shared.read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, registry.tokenizer())


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("exact repeats", exact_repeats),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Learnt scores and least-cost patterns are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
