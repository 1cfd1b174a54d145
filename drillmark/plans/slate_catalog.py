"""Registered queries: catalog, facets, samples, import status."""

from __future__ import annotations

from pyspark.sql import functions as F

from drillmark.functions.scoring import (
    chosen_text,
    correct_text,
    marks,
    method_label,
    mixed_source,
    seeded_unit,
    syntax_language,
)
from drillmark.functions.text import relative_path, split_list
from drillmark.operators.predicates import known_methods
from drillmark.plans import bindings as B
from drillmark.plans import catalog as C
from drillmark.plans.registry import query

_Q = f"({B.QUESTIONS_SQL}) q"
_CURATED = "is_complete AND NOT is_ai_generated"


@query(
    f"""
    SELECT id, title, difficulty, array_to_string(tags, ' ') AS tags FROM {_Q}
    WHERE question_type = 'STANDARD' AND difficulty = 'Medium' AND {_CURATED}
      AND list_contains(supported_methods, 'java') AND list_contains(tags, 'red')
    ORDER BY title, id LIMIT 20
    """
)
def picker_page(spark, sf_dir):
    page = C.picker_page(B.questions(spark, sf_dir), "STANDARD", "Medium", "java", "red")
    return page.withColumn("tags", F.array_join("tags", " "))


@query(
    f"""
    SELECT count(*) AS n FROM {_Q}
    WHERE question_type = 'LARGE' AND {_CURATED} AND list_contains(supported_methods, 'sql')
    """
)
def curated_count(spark, sf_dir):
    return C.curated_count(B.questions(spark, sf_dir), "LARGE", method="sql")


@query(
    f"""
    SELECT DISTINCT unnest(tags) AS topic FROM {_Q}
    WHERE question_type = 'PROMO' AND difficulty = 'Hard' AND {_CURATED}
      AND list_contains(supported_methods, 'python')
    """
)
def facet_topics(spark, sf_dir):
    return C.available_topics(B.questions(spark, sf_dir), "PROMO", "Hard", "python")


@query(
    f"""
    SELECT DISTINCT difficulty,
           list_position(['Beginner', 'Easy', 'Medium', 'Hard', 'Very Hard'], difficulty) AS place
    FROM {_Q} WHERE question_type = 'SMALL' AND {_CURATED}
      AND list_contains(supported_methods, 'polars')
    """
)
def facet_difficulties(spark, sf_dir):
    return C.available_difficulties(B.questions(spark, sf_dir), "SMALL", "polars")


def _items(spark, sf_dir):
    return B.corpus(spark, sf_dir).select(
        "id",
        F.col("question_type").alias("domain"),
        F.get("tags", F.lit(0)).alias("topic"),
        "difficulty",
        "is_complete",
        F.when(F.col("is_ai_generated"), "coding").otherwise("theory").alias("answer_format"),
        F.col("problem_statement").alias("prompt"),
    )


@query(
    """
    SELECT DISTINCT 'domain' AS facet, lang AS value FROM documents WHERE n_chars >= 200
    UNION SELECT DISTINCT 'topic', source FROM documents WHERE n_chars >= 200
    """
)
def item_facets(spark, sf_dir):
    return C.item_facets(_items(spark, sf_dir))


@query(
    f"""
    SELECT id, title FROM {_Q} WHERE question_type = 'MEDIUM' AND {_CURATED}
    ORDER BY md5(concat_ws(':', id::varchar, 'seed-7')), id LIMIT 25
    """
)
def seeded_sample_of_questions(spark, sf_dir):
    picked = C.random_questions(B.questions(spark, sf_dir), 25, "seed-7", "MEDIUM")
    return picked.select("id", "title")


@query(
    f"""
    SELECT CASE WHEN count(*) > 0 THEN 'dataset,ai_generated,mixed' ELSE 'ai_generated' END
             AS learning_modes
    FROM {_Q} WHERE question_type = 'LARGE' AND {_CURATED}
      AND list_contains(supported_methods, 'pandas')
    """
)
def learning_modes(spark, sf_dir):
    modes = C.learning_modes(
        B.questions(spark, sf_dir), "LARGE", "pandas", ("dataset", "ai_generated", "mixed")
    )
    return modes.withColumn("learning_modes", F.array_join("learning_modes", ","))


_LATEST = f"""
SELECT dataset_name, started_at, id, status FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY started_at DESC, id DESC) AS n
  FROM ({B.IMPORT_RUNS_SQL})) WHERE n = 1
"""


@query(_LATEST)
def latest_run_per_dataset(spark, sf_dir):
    return C.latest_runs(B.import_runs(spark, sf_dir))


@query(
    f"""
    SELECT c_custkey::varchar AS dataset_name FROM customer
    WHERE c_custkey::varchar NOT IN
      (SELECT dataset_name FROM ({_LATEST}) WHERE status = 'completed')
    """
)
def pending_datasets(spark, sf_dir):
    configured = B.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("dataset_name")
    )
    return C.pending_datasets(
        B.import_runs(spark, sf_dir), configured, B.questions(spark, sf_dir)
    )


@query(
    """
    SELECT doc_id AS id, source AS topic FROM documents
    WHERE n_chars >= 200 AND source <> 'src13' AND lang = 'fr'
      AND n_chars > 1000 AND n_chars <= 2000
    ORDER BY doc_id LIMIT 3
    """
)
def local_references(spark, sf_dir):
    picked = C.references_for(_items(spark, sf_dir), "theory", "Medium", domain="fr")
    return picked.select("id", "topic")


@query(
    f"""
    SELECT question_id, id, is_example, example_no FROM (
      SELECT l_orderkey AS question_id, {B.LINE_ID_SQL} AS id, l_discount = 0 AS is_example,
             row_number() OVER (PARTITION BY l_orderkey
                                ORDER BY l_discount = 0 DESC, {B.LINE_ID_SQL}) AS example_no
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P')
    WHERE example_no <= 3
    """
)
def examples_fallback(spark, sf_dir):
    questions = B.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") != "P", '[{"input": 1}]').alias("examples"),
    )
    cases = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("question_id"),
        B.line_id().alias("id"),
        (F.col("l_discount") == 0).alias("is_example"),
    )
    return C.examples_of(questions, cases)


@query(
    f"""
    SELECT d.id, d.title, s.dataset_name, b.item_id AS generation_id,
           CASE WHEN d.is_ai_generated THEN 'ai_generated' ELSE 'dataset' END AS source_kind
    FROM ({B.CORPUS_SQL}) d LEFT JOIN ({B.CORPUS_SOURCES_SQL}) s ON s.id = d.source_id
    LEFT JOIN benchmark b ON b.item_id = d.id
    """
)
def question_detail(spark, sf_dir):
    questions = B.corpus(spark, sf_dir).withColumn("question_id", F.col("id"))
    sources = B.corpus_sources(spark, sf_dir).withColumnRenamed("id", "source_id")
    generated = B.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("item_id").alias("generation_id")
    )
    return C.question_detail(questions, sources, generated).select(
        "id", "title", "dataset_name", "generation_id", "source_kind"
    )


@query(
    """
    SELECT conv_id AS question_id, role AS asset_type, text AS content FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n
      FROM conversations) WHERE n = 1
    """
)
def last_asset_per_type(spark, sf_dir):
    assets = B.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("question_id"),
        F.col("role").alias("asset_type"),
        F.col("turn").alias("id"),
        F.col("text").alias("content"),
    )
    return C.assets_by_type(assets)


@query(
    """
    SELECT conv_id AS question_id, role AS method, turn AS id, length(text) AS chars,
           row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS place
    FROM conversations
    """
)
def stored_solutions(spark, sf_dir):
    solutions = B.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("question_id"),
        F.col("role").alias("method"),
        F.col("turn").alias("id"),
        F.length("text").alias("chars"),
    )
    return C.stored_solutions(solutions, block=F.floor(F.col("id") / 65536))


@query(
    f"""
    SELECT CASE WHEN question_type = 'data_analysis' THEN 'data_analysis' ELSE 'algorithm' END
             AS catalog, count(*) AS n
    FROM (SELECT CASE WHEN question_type IN ('STANDARD', 'ECONOMY', 'PROMO') THEN 'algorithm'
                      ELSE 'data_analysis' END AS question_type FROM {_Q})
    GROUP BY 1
    """
)
def catalog_routing(spark, sf_dir):
    kind = F.when(F.col("question_type").isin(*B.ALGORITHM_TYPES), "algorithm").otherwise(
        "data_analysis"
    )
    routed = B.questions(spark, sf_dir).select(C.catalog_of(kind).alias("catalog"))
    return routed.groupBy("catalog").agg(F.count("*").alias("n"))


@query(
    """
    SELECT c_custkey AS request_id,
           CASE WHEN c_acctbal > 0 AND c_nationkey < 20 THEN
                  CASE WHEN ('0x' || substr(md5(c_custkey::varchar || ':coin'), 1, 8))::bigint
                            / 4294967296.0 < 0.5 THEN 'ai' ELSE 'dataset' END
                WHEN c_nationkey < 20 THEN 'ai' WHEN c_acctbal > 0 THEN 'dataset' END AS source
    FROM customer
    """
)
def mixed_sources(spark, sf_dir):
    return B.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"),
        mixed_source(
            F.col("c_acctbal") > 0, F.col("c_nationkey") < 20, seeded_unit(F.col("c_custkey"), "coin")
        ).alias("source"),
    )


@query(
    """
    WITH stored AS (SELECT l_partkey, CASE l_returnflag WHEN 'A' THEN 'java' WHEN 'N' THEN 'sql'
                             ELSE 'cpp' END AS method, min_by(l_linestatus, """
    + B.LINE_ID_SQL
    + f"""|| '-' || l_orderkey) AS code FROM lineitem GROUP BY ALL)
    SELECT q.id AS question_id, q.method,
           coalesce(s.code, CASE q.method WHEN 'sql' THEN 'SELECT ' WHEN 'java' THEN 'class Solution'
                                 END) AS code
    FROM (SELECT id, unnest(supported_methods) AS method FROM {_Q}) q
    LEFT JOIN stored s ON s.l_partkey = q.id AND s.method = q.method
    """
)
def starter_codes(spark, sf_dir):
    method = F.when(F.col("l_returnflag") == "A", "java").when(F.col("l_returnflag") == "N", "sql")
    assets = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("question_id"),
        F.lit("starter_code").alias("asset_type"),
        method.otherwise("cpp").alias("method"),
        F.concat_ws("-", B.line_id(), F.col("l_orderkey").cast("string")).alias("id"),
        F.col("l_linestatus").alias("content"),
    )
    templates = {"sql": "SELECT ", "java": "class Solution"}
    return C.starter_codes(B.questions(spark, sf_dir), assets, templates)


@query(
    """
    SELECT p_partkey AS id, 'SQL,Java,C++' AS labels, 'sql,java,cpp' AS known,
           CASE WHEN p_size > 25 THEN 'python' ELSE 'javascript' END AS syntax,
           CASE WHEN p_size > 40 THEN 'Unanswered' WHEN p_size > 20 THEN p_brand
                ELSE 'Unanswered' END AS answer,
           CASE WHEN p_size > 20 AND p_size <= 40 THEN p_brand WHEN p_size <= 20 THEN 'gone' END
             AS correct,
           string_split(p_name, ' ')[1] || '|' || string_split(p_name, ' ')[2] AS topics,
           'src/' || p_type || '.py' AS relative, p_type || '.py' AS outside,
           round(p_size / 10, 1) AS marks
    FROM part
    """
)
def display_rules(spark, sf_dir):
    offered = F.array(F.lit("sql"), F.col("p_name"), F.lit("java"), F.lit("cpp"))
    known = known_methods(offered)
    options = F.array(F.struct(F.lit("a").alias("id"), F.col("p_brand").alias("text")))
    chosen = F.when(F.col("p_size") > 40, None).when(F.col("p_size") > 20, "a").otherwise("gone")
    listed = F.concat(F.translate("p_name", " ", ","), F.lit(", ,"))
    path = F.concat(F.lit("file:/data/root/src/"), F.col("p_type"), F.lit(".py"))
    return B.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.array_join(F.transform(known, method_label), ",").alias("labels"),
        F.array_join(known, ",").alias("known"),
        syntax_language(
            F.when(F.col("p_size") > 25, "polars").otherwise("javascript/typescript")
        ).alias("syntax"),
        chosen_text(options, chosen).alias("answer"),
        correct_text(options, chosen).alias("correct"),
        F.array_join(split_list(listed), "|").alias("topics"),
        relative_path(path, "/data/root").alias("relative"),
        relative_path(path, "/other").alias("outside"),
        marks(F.col("p_size")).alias("marks"),
    )


@query(
    """
    SELECT c_custkey AS question_id,
           CASE WHEN c_mktsegment = 'BUILDING' THEN 'items' END AS table_name,
           n AS row_no, '{"n":' || n || '}' AS "row"
    FROM (SELECT *, unnest(range(1, least(c_nationkey, 5) + 1)) AS n FROM customer
          WHERE c_mktsegment <> 'FURNITURE')
    """
)
def fixture_preview(spark, sf_dir):
    numbers = F.sequence(F.lit(1), F.col("c_nationkey"))
    filled = F.transform(numbers, lambda i: F.struct(i.alias("n")))
    rows = F.when(F.col("c_nationkey") > 0, filled).otherwise(F.slice(filled, 1, 0))
    segment = F.col("c_mktsegment")
    content = (
        F.when(segment == "BUILDING", F.to_json(F.struct(rows.alias("items"))))
        .when(segment == "FURNITURE", "no table")
        .otherwise(F.to_json(rows))
    )
    assets = B.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("question_id"),
        F.lit("fixture_data").alias("asset_type"),
        content.alias("content"),
    )
    return C.fixture_preview(assets)
