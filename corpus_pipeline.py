"""The corpus pipeline: ordered stages, each one operator of auditspark.llm.

Every stage takes (spark, docs, sf_dir) and gives what the next one reads; run() writes each result to
the shared folder and reads it again, so that no stage is computed twice. All but the last give the
columns of docs, whatever their names, in their order; an empty table gives an empty one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm import jaccard, mixing, packing, quality, repeats
from auditspark.llm.common import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Null texts and texts without words hold no evidence and stay;
    rows that repeat fare alike; a null id has no gold label."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles: the one with the
    smallest id, null first. Texts null or without words are linked with nothing and stay, all of them; of
    rows that repeat one stays."""
    return jaccard.keep_one(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 400-byte strings that occur again anywhere; n_chars follows the text. Null texts
    stay null; rows that repeat are each other's copies, so such strings go from all of them."""
    left = repeats.remove_repeats(docs, keep_columns=True)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Null sources are one source; documents without
    words, of which there is nothing to take, stay; rows that repeat share their copies."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences. A null text is empty, its end id alone; rows that
    repeat are packed each by itself."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("source_mix", source_mix), ("packing", packed)]
#: The stages cannot be expressed in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
