"""The corpus pipeline: documents in, packed training sequences out.

A missing or empty text is scored like any other, has no lines and no passages,
and counts as one text: the near-duplicate stage keeps one row of all empty
texts.  A document without id stays and is the last of its group.  Of repeated
rows one stays; ties go to the smaller id, then the smaller hash of the text.
Texts are never cut short.  An empty table gives an empty result.  Further
columns, also those with names used inside a stage, pass through to the last
stage; names that differ only in case, or repeat, must not occur (Spark cannot
write them as Parquet).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillmark.llm import line_dedup, packing, repeats, simhash, toxicity
from drillmark.llm.shared import documents, kept


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score one half and more for toxicity go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier line go; a document that loses all of them stays, empty."""
    return _counted(line_dedup.without_repeats(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the first by id, then text."""
    return simhash.one_per_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that occur again are cut out of the texts."""
    return _counted(repeats.without_repeats(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents and their places in sequences."""
    found = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxic_documents),
    ("line_dedup", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages are tested one by one against brute force.
ORACLE_SQL = None
