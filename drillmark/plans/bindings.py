"""The driver's tables seen as the engine's tables.

Each function is a projection of one driver table; nothing is filtered out.
The SQL texts say the same for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drillmark import schemas as S

ALGORITHM_TYPES = ("STANDARD", "ECONOMY", "PROMO")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bucket(value: Column, bounds) -> Column:
    out = F.when(value <= bounds[0], S.DIFFICULTIES[0])
    for bound, level in zip(bounds[1:], S.DIFFICULTIES[1:4]):
        out = out.when(value <= bound, level)
    return out.otherwise(S.DIFFICULTIES[4])


def questions(spark, sf_dir) -> DataFrame:
    """part as the question catalog."""
    methods = F.when(
        F.col("p_type").isin(*ALGORITHM_TYPES), F.array(*map(F.lit, S.ALGORITHM_METHODS))
    ).otherwise(F.array(*map(F.lit, S.DATA_ANALYSIS_METHODS)))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("question_type"),
        _bucket(F.col("p_size"), (10, 20, 30, 40)).alias("difficulty"),
        F.split("p_name", " ").alias("tags"),
        methods.alias("supported_methods"),
        (F.col("p_brand") != "Brand#7").alias("is_complete"),
        (F.col("p_brand") == "Brand#13").alias("is_ai_generated"),
        F.concat_ws(" ", "p_brand", "p_name").alias("problem_statement"),
    )


QUESTIONS_SQL = """
SELECT p_partkey AS id, p_name AS title, p_type AS question_type,
       CASE WHEN p_size <= 10 THEN 'Beginner' WHEN p_size <= 20 THEN 'Easy'
            WHEN p_size <= 30 THEN 'Medium' WHEN p_size <= 40 THEN 'Hard'
            ELSE 'Very Hard' END AS difficulty,
       string_split(p_name, ' ') AS tags,
       CASE WHEN p_type IN ('STANDARD', 'ECONOMY', 'PROMO')
            THEN ['python', 'javascript/typescript', 'java', 'cpp']
            ELSE ['sql', 'pandas', 'pyspark', 'polars'] END AS supported_methods,
       p_brand <> 'Brand#7' AS is_complete, p_brand = 'Brand#13' AS is_ai_generated,
       concat_ws(' ', p_brand, p_name) AS problem_statement
FROM part
"""


def attempts(spark, sf_dir) -> DataFrame:
    """lineitem as the attempt log: many attempts per question."""
    finished = F.col("l_linestatus") == "F"
    unassessed = ~finished & (F.col("l_tax") == 0)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("question_id"),
        F.col("l_returnflag").alias("method"),
        F.when(finished, "completed").otherwise("error").alias("assessment_status"),
        F.when(~unassessed, F.col("l_quantity") * 2).alias("percentage_correct"),
        F.col("l_shipdate").alias("attempted_at"),
    )


ATTEMPTS_SQL = """
SELECT l_partkey AS question_id, l_returnflag AS method,
       CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'error' END AS assessment_status,
       CASE WHEN l_linestatus <> 'F' AND l_tax = 0 THEN NULL ELSE l_quantity * 2 END
         AS percentage_correct,
       l_shipdate AS attempted_at
FROM lineitem
"""


def dated_attempts(spark, sf_dir) -> DataFrame:
    """orders as attempts with a unique id."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(
        F.col("o_orderstatus") == "O", "pending"
    )
    percent = F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice") / 5000)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("question_id"),
        F.col("o_orderpriority").alias("method"),
        status.otherwise("error").alias("assessment_status"),
        percent.alias("percentage_correct"),
        F.round(percent / 10, 1).alias("marks"),
        F.col("o_orderdate").alias("attempted_at"),
    )


DATED_ATTEMPTS_SQL = """
SELECT o_orderkey AS id, o_custkey AS question_id, o_orderpriority AS method,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'error' END
         AS assessment_status,
       CASE WHEN o_orderstatus <> 'O' THEN o_totalprice / 5000 END AS percentage_correct,
       CASE WHEN o_orderstatus <> 'O' THEN round(o_totalprice / 5000 / 10, 1) END AS marks,
       o_orderdate AS attempted_at
FROM orders
"""


def customer_level() -> Column:
    return _bucket(F.col("c_nationkey"), (4, 9, 14, 19))


def customer_questions(spark, sf_dir) -> DataFrame:
    """customer as the questions of the dated attempts."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("question_type"),
        customer_level().alias("difficulty"),
        F.concat_ws(" ", "c_name", "c_mktsegment").alias("problem_statement"),
        F.lit(None).cast("string").alias("constraints"),
        F.array("c_mktsegment").alias("tags"),
    )


CUSTOMER_QUESTIONS_SQL = """
SELECT c_custkey AS id, c_name AS title, c_mktsegment AS question_type,
       CASE WHEN c_nationkey <= 4 THEN 'Beginner' WHEN c_nationkey <= 9 THEN 'Easy'
            WHEN c_nationkey <= 14 THEN 'Medium' WHEN c_nationkey <= 19 THEN 'Hard'
            ELSE 'Very Hard' END AS difficulty,
       concat_ws(' ', c_name, c_mktsegment) AS problem_statement
FROM customer
"""


def quizzes(spark, sf_dir) -> DataFrame:
    """orders as quiz headers."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(
        F.col("o_orderstatus") == "O", "in_progress"
    )
    percent = F.col("o_totalprice") / 5000
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("quiz_id"),
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("learner_id"),
        status.otherwise("evaluation_error").alias("status"),
        F.col("o_orderpriority").alias("difficulty"),
        F.col("o_orderdate").alias("started_at"),
        percent.alias("percentage_correct"),
        (percent >= S.SOLVED_PERCENT).alias("passed"),
    )


QUIZZES_SQL = """
SELECT o_orderkey AS quiz_id, o_orderkey AS id, o_custkey AS learner_id,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress'
            ELSE 'evaluation_error' END AS status,
       o_orderpriority AS difficulty, o_orderdate AS started_at,
       o_totalprice / 5000 AS percentage_correct, o_totalprice / 5000 >= 80 AS passed
FROM orders
"""


def line_id() -> Column:
    """An id that sorts like (line number, part, supplier) within its order."""
    return F.concat_ws(
        "-",
        F.lpad(F.col("l_linenumber").cast("string"), 3, "0"),
        F.lpad(F.col("l_partkey").cast("string"), 14, "0"),
        F.lpad(F.col("l_suppkey").cast("string"), 14, "0"),
    )


LINE_ID_SQL = """concat_ws('-', lpad(l_linenumber::varchar, 3, '0'),
  lpad(l_partkey::varchar, 14, '0'), lpad(l_suppkey::varchar, 14, '0'))"""


def quiz_items(spark, sf_dir) -> DataFrame:
    """lineitem as quiz items, some of them scored before."""
    scored = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "N")
    coding = F.col("l_linenumber") <= 3
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("quiz_id"),
        line_id().alias("item_id"),
        F.col("l_partkey").alias("question_id"),
        F.when(coding, "coding").otherwise("mcq").alias("answer_format"),
        F.col("l_returnflag").alias("selected_option_id"),
        F.when(F.col("l_quantity") > 25, "R").otherwise("A").alias("correct_option_id"),
        F.when(F.col("l_tax") == 0, "  \n").otherwise("code").alias("answer_text"),
        F.when(F.col("l_discount") < 0.1, F.col("l_quantity") * 2).alias("reviewed_percent"),
        F.when(scored, "scored").otherwise("pending").alias("item_status"),
        F.when(scored, F.col("l_quantity")).alias("percentage_correct"),
    )


QUIZ_ITEMS_SQL = f"""
SELECT l_orderkey AS quiz_id, {LINE_ID_SQL} AS item_id, l_partkey AS question_id,
       CASE WHEN l_linenumber <= 3 THEN 'coding' ELSE 'mcq' END AS answer_format,
       CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN l_quantity
            WHEN l_linenumber > 3 THEN
              CASE WHEN l_returnflag = CASE WHEN l_quantity > 25 THEN 'R' ELSE 'A' END
                   THEN 100.0 ELSE 0.0 END
            WHEN l_tax = 0 THEN 0.0
            WHEN l_discount < 0.1 THEN l_quantity * 2 END AS score
FROM lineitem
"""


def turns(spark, sf_dir) -> DataFrame:
    """conversations as session turns, positions from 1."""
    status = F.when(F.col("role") == "assistant", "scored").when(
        F.col("role") == "user", "pending"
    )
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"),
        (F.col("turn") + 1).alias("position"),
        F.col("turn").alias("item_id"),
        F.col("text").alias("prompt"),
        F.when(F.col("role") == "assistant", F.col("text")).otherwise("").alias("answer_text"),
        F.col("role").alias("selected_option"),
        F.lit("theory").alias("answer_format"),
        status.otherwise("skipped").alias("status"),
        F.when(F.col("role") != "user", (F.length("text") % 101).cast("double")).alias("score"),
    )


TURNS_SQL = """
SELECT conv_id AS session_id, turn + 1 AS position, turn AS item_id, text AS prompt,
       CASE WHEN role = 'assistant' THEN text ELSE '' END AS answer_text,
       role AS selected_option,
       CASE role WHEN 'assistant' THEN 'scored' WHEN 'user' THEN 'pending' ELSE 'skipped' END
         AS status,
       CASE WHEN role <> 'user' THEN (length(text) % 101)::double END AS score
FROM conversations
"""


def sessions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id")).distinct()


def import_runs(spark, sf_dir) -> DataFrame:
    """events as import runs of one dataset per user."""
    status = F.when(F.col("event_type") == "purchase", "completed").when(
        F.col("event_type") == "error", "failed"
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("dataset_name"),
        F.col("event_id").alias("id"),
        F.col("ts").alias("started_at"),
        status.otherwise("running").alias("status"),
    )


IMPORT_RUNS_SQL = """
SELECT user_id::varchar AS dataset_name, event_id AS id, ts AS started_at,
       CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
            ELSE 'running' END AS status
FROM events
"""


def corpus(spark, sf_dir) -> DataFrame:
    """documents as reference questions, one type per language."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("source_id"),
        F.concat_ws(" ", "source", "lang").alias("title"),
        F.col("lang").alias("question_type"),
        _bucket(F.col("n_chars"), (500, 1000, 2000, 4000)).alias("difficulty"),
        F.col("text").alias("problem_statement"),
        F.array("source", "lang").alias("tags"),
        (F.col("source") == "src13").alias("is_ai_generated"),
        (F.col("n_chars") >= 200).alias("is_complete"),
    )


CORPUS_SQL = """
SELECT doc_id AS id, doc_id AS source_id, concat_ws(' ', source, lang) AS title,
       lang AS question_type,
       CASE WHEN n_chars <= 500 THEN 'Beginner' WHEN n_chars <= 1000 THEN 'Easy'
            WHEN n_chars <= 2000 THEN 'Medium' WHEN n_chars <= 4000 THEN 'Hard'
            ELSE 'Very Hard' END AS difficulty,
       text AS problem_statement, [source, lang] AS tags,
       source = 'src13' AS is_ai_generated, n_chars >= 200 AS is_complete
FROM documents
"""


def corpus_sources(spark, sf_dir) -> DataFrame:
    """labels as the sources of the corpus; documents without a label have none."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("quality-"), F.col("quality").cast("string")).alias("dataset_name"),
    )


CORPUS_SOURCES_SQL = """
SELECT doc_id AS id, 'quality-' || quality::varchar AS dataset_name FROM labels
"""
