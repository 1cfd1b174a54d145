"""Queries over vectors and web pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from drillmark.llm import captures, negatives, neighbours
from drillmark.llm.registry import query
from drillmark.llm.shared import kept, shared_folder


@query()
def op3_neighbours(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(vectors, F.col("vec_id") % 100 == 0)


@query(
    f"""
    WITH known AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
        FROM pages
    ), told AS (
        SELECT *, CASE WHEN payload_bytes >= {captures.LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper
        FROM known
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN keeper IS NULL OR keeper IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN keeper IS NOT NULL AND keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to
    FROM told
    """
)
def op5_captures(spark, sf_dir):
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    captures.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    whole = captures.transactions(captures.read_archives(spark, folder)).drop("payload")
    found = captures.resolved(kept(whole, "captures"))
    return found.select(
        F.col("metadata.page_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.col("refers_to_page").alias("refers_to"),
    )


@query(
    """
    WITH whole AS (
        SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ), usable AS (
        SELECT * FROM whole WHERE len(v) = (SELECT len(v) FROM whole GROUP BY len(v) ORDER BY count(*) DESC, len(v) DESC LIMIT 1)
    ), scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
        FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
        WHERE a.vec_id % 100 = 0
    ), positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank
    FROM positives p JOIN scored n
      ON n.anchor_id = p.anchor_id AND NOT n.same
     AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
    QUALIFY rank <= 10
    """
)
def op12_negatives(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return negatives.mined(negatives.relabelled(vectors), F.col("id") % 100 == 0)
