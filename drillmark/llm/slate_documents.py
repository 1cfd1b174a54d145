"""Queries over whole documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from drillmark.llm import alignment, byte_pairs, config_packing, fingerprints, line_dedup, packing, repeats, simhash, toxicity
from drillmark.llm.registry import query
from drillmark.llm.shared import documents


@query()
def op1_fingerprints(spark, sf_dir):
    return fingerprints.edited_likeness(documents(spark, sf_dir))


@query()
def op2_packing(spark, sf_dir):
    found = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumnRenamed("id", "doc_id")


@query()
def op4_byte_pairs(spark, sf_dir):
    found = byte_pairs.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.withColumnRenamed("id", "doc_id")


@query()
def op6_lines(spark, sf_dir):
    """Per document: its lines, those removed, and the SHA-256 of the text left."""
    left = line_dedup.without_repeats(documents(spark, sf_dir).select("doc_id", "text"), flags_as="_flags")
    lines = F.coalesce(F.size("_flags"), F.lit(0))
    stay = F.coalesce(F.size(F.filter("_flags", lambda x: x)), F.lit(0))
    return left.select(
        "doc_id",
        F.greatest(lines, F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(lines - stay, F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query()
def op7_toxicity(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.scored(documents(spark, sf_dir), labels).select(
        F.col("id").alias("doc_id"),
        toxicity.held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query()
def op8_simhash(spark, sf_dir):
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"),
        simhash.hex_of(F.col("fingerprint")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query()
def op9_repeats(spark, sf_dir):
    return repeats.digests(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query()
def op11_config_packing(spark, sf_dir):
    found = config_packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumnRenamed("id", "doc_id")


@query()
def op13_alignment(spark, sf_dir):
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.linked_counts(documents(spark, sf_dir), a, b).withColumnRenamed("id", "doc_id")
