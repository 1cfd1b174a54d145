"""Registered queries: learner progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from drillmark import schemas as S
from drillmark.operators.barrier import shared_path
from drillmark.plans import bindings as B
from drillmark.plans import progress as P
from drillmark.plans.registry import query
from drillmark.sources import compaction, sinks

_JOINED = f"""
FROM ({B.ATTEMPTS_SQL}) a JOIN ({B.QUESTIONS_SQL}) q ON q.id = a.question_id
"""
_DATED = f"""
FROM ({B.DATED_ATTEMPTS_SQL}) a JOIN ({B.CUSTOMER_QUESTIONS_SQL}) q ON q.id = a.question_id
"""
_SUMMARY = """
SELECT count(*) AS total_attempts, count(DISTINCT a.question_id) AS attempted_questions,
       count(DISTINCT CASE WHEN a.assessment_status = 'completed'
             AND a.percentage_correct >= 80 THEN a.question_id END) AS solved_questions,
       count(DISTINCT CASE WHEN a.percentage_correct IS NOT NULL THEN a.question_id END)
         AS assessed_questions,
       80.0::double AS solved_threshold
"""


@query(_SUMMARY + _JOINED)
def progress_summary(spark, sf_dir):
    return P.progress_summary(B.attempts(spark, sf_dir), B.questions(spark, sf_dir))


@query(
    _SUMMARY
    + _JOINED
    + "WHERE q.question_type = 'STANDARD' AND q.difficulty = 'Medium' AND a.method = 'R'"
)
def progress_filtered(spark, sf_dir):
    return P.progress_summary(
        B.attempts(spark, sf_dir), B.questions(spark, sf_dir), "STANDARD", "Medium", "R"
    )


@query(
    "SELECT q.difficulty, count(*) AS attempts, avg(a.percentage_correct) AS avg_pct"
    + _JOINED
    + "GROUP BY q.difficulty"
)
def progress_by_difficulty(spark, sf_dir):
    return P.progress_by_difficulty(B.attempts(spark, sf_dir), B.questions(spark, sf_dir))


_ATTEMPT_COLUMNS = """
SELECT a.question_id, a.id, a.method, a.assessment_status, a.percentage_correct, a.marks,
       a.attempted_at, q.title, q.question_type, q.difficulty
"""


@query(_ATTEMPT_COLUMNS + _DATED + "ORDER BY a.attempted_at DESC, a.id DESC LIMIT 5")
def recent_attempts_top5(spark, sf_dir):
    return P.recent_attempts(B.dated_attempts(spark, sf_dir), B.customer_questions(spark, sf_dir))


@query(_ATTEMPT_COLUMNS + _DATED)
def attempt_history(spark, sf_dir):
    return P.attempt_history(B.dated_attempts(spark, sf_dir), B.customer_questions(spark, sf_dir))


@query(
    f"SELECT * FROM ({B.DATED_ATTEMPTS_SQL}) WHERE question_id = 899"
)
def question_attempts(spark, sf_dir):
    return P.question_attempts(B.dated_attempts(spark, sf_dir), 899)


@query(
    """SELECT a.question_id, any_value(q.title) AS title, count(*) AS attempts,
              coalesce(bool_or(a.assessment_status = 'completed' AND a.percentage_correct >= 80),
                       false) AS solved"""
    + _JOINED
    + "GROUP BY a.question_id"
)
def question_solved_flags(spark, sf_dir):
    return P.question_flags(B.attempts(spark, sf_dir), B.questions(spark, sf_dir))


@query(
    """SELECT q.title AS "Question", left(a.id::varchar, 8) AS "Attempt", a.method AS "Method",
              a.marks AS "Marks", a.percentage_correct AS "Percent",
              strftime(a.attempted_at, '%Y-%m-%d %H:%M') AS "Time" """
    + _DATED
    + "WHERE a.marks IS NOT NULL"
)
def marks_table(spark, sf_dir):
    return P.marks_table(B.dated_attempts(spark, sf_dir), B.customer_questions(spark, sf_dir))


@query(
    """
    SELECT 'attempts' AS activity, (SELECT count(*) FROM lineitem) AS n
    UNION ALL SELECT 'quizzes', (SELECT count(*) FROM orders)
    UNION ALL SELECT 'scored_items',
                     (SELECT count(*) FROM conversations WHERE role = 'assistant')
    UNION ALL SELECT 'completed_runs', (SELECT count(*) FROM events WHERE event_type = 'purchase')
    """
)
def activity_overview(spark, sf_dir):
    return P.activity_overview(
        {
            "attempts": B.attempts(spark, sf_dir),
            "quizzes": B.quizzes(spark, sf_dir),
            "scored_items": B.turns(spark, sf_dir).filter(F.col("status") == "scored"),
            "completed_runs": B.import_runs(spark, sf_dir).filter(F.col("status") == "completed"),
        }
    )


_QUIZ_COUNTS = f"""
SELECT count(*) AS total_attempts,
       count(CASE WHEN status = 'completed' THEN 1 END) AS completed_attempts,
       count(CASE WHEN status = 'completed' AND passed THEN 1 END) AS passed_attempts
FROM ({B.QUIZZES_SQL})
"""


@query(_QUIZ_COUNTS)
def quiz_progress(spark, sf_dir):
    return P.quiz_progress(B.quizzes(spark, sf_dir))


@query(_QUIZ_COUNTS + "WHERE difficulty = '2-HIGH'")
def quiz_progress_filtered(spark, sf_dir):
    return P.quiz_progress(B.quizzes(spark, sf_dir), difficulty="2-HIGH")


@query(f"SELECT * FROM ({B.QUIZZES_SQL})")
def quiz_history(spark, sf_dir):
    return P.quiz_history(B.quizzes(spark, sf_dir))


@query(
    f"""
    WITH items AS (SELECT * FROM ({B.TURNS_SQL}) WHERE status <> 'skipped')
    SELECT count(DISTINCT s.session_id) AS sessions, count(i.session_id) AS items,
           round(avg(CASE WHEN i.status = 'scored' THEN i.score END), 6) AS mean_score,
           round(coalesce(avg(CASE WHEN i.status = 'scored' THEN i.score END), 0), 1) AS shown_mean
    FROM (SELECT DISTINCT conv_id AS session_id FROM conversations) s
    LEFT JOIN items i ON i.session_id = s.session_id
    """
)
def session_summary(spark, sf_dir):
    items = B.turns(spark, sf_dir).filter(F.col("status") != "skipped")
    out = P.session_summary(B.sessions(spark, sf_dir), items)
    return out.withColumn("mean_score", F.round("mean_score", 6))


def _interviews(spark, sf_dir):
    return B.quizzes(spark, sf_dir).select(
        F.col("quiz_id").alias("session_id"),
        "status",
        "started_at",
        F.col("percentage_correct").alias("overall_score"),
    )


@query(
    f"""
    SELECT count(*) AS interviews, count(CASE WHEN status = 'completed' THEN 1 END) AS completed,
           round(avg(CASE WHEN status = 'completed' THEN percentage_correct END), 6) AS mean_score
    FROM ({B.QUIZZES_SQL})
    """
)
def interview_summary(spark, sf_dir):
    out = P.interview_summary(_interviews(spark, sf_dir))
    return out.withColumn("mean_score", F.round("mean_score", 6))


@query(
    f"""
    SELECT quiz_id AS session_id, status, started_at, percentage_correct AS overall_score
    FROM ({B.QUIZZES_SQL}) ORDER BY started_at DESC, quiz_id DESC LIMIT 100
    """
)
def latest_interviews(spark, sf_dir):
    return P.latest_interviews(_interviews(spark, sf_dir))


@query(
    f"""
    SELECT i.item_id, i.answered_at, q.title, q.difficulty
    FROM (SELECT l_partkey AS item_id, l_shipdate AS answered_at FROM lineitem
          WHERE l_linestatus = 'F') i
    JOIN ({B.QUESTIONS_SQL}) q ON q.id = i.item_id
    ORDER BY i.answered_at DESC, i.item_id DESC LIMIT 100
    """
)
def latest_scored_items(spark, sf_dir):
    items = B.attempts(spark, sf_dir).select(
        F.col("question_id").alias("item_id"),
        F.when(F.col("assessment_status") == "completed", "scored").alias("status"),
        F.col("attempted_at").alias("answered_at"),
    )
    catalog = B.questions(spark, sf_dir).select(F.col("id").alias("item_id"), "title", "difficulty")
    return P.latest_scored_items(items, catalog).select(
        "item_id", "answered_at", "title", "difficulty"
    )


def _views(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("question_id"),
        F.col("event_id").alias("attempt_id"),
        F.col("ts").alias("viewed_at"),
        F.array("event_type").alias("methods_viewed"),
    )


@query(
    f"""
    SELECT e.event_id AS id, e.user_id AS question_id, q.title, e.ts AS viewed_at
    FROM events e JOIN ({B.CUSTOMER_QUESTIONS_SQL}) q ON q.id = e.user_id
    WHERE e.event_type = 'click' ORDER BY e.ts DESC, e.event_id DESC LIMIT 100
    """
)
def solution_view_history(spark, sf_dir):
    out = P.solution_view_history(
        _views(spark, sf_dir), B.customer_questions(spark, sf_dir), method="click"
    )
    return out.select("id", "question_id", "title", "viewed_at")


@query(
    """
    WITH firsts AS (
      SELECT user_id, event_type, ts, event_id,
             row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n
      FROM events)
    SELECT user_id AS view_id,
           string_agg(event_type, ',' ORDER BY ts, event_id) AS methods_viewed
    FROM firsts WHERE n = 1 GROUP BY user_id
    """
)
def method_list_per_view(spark, sf_dir):
    events = B.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("view_id"),
        F.col("event_type").alias("method"),
        F.col("ts").alias("viewed_at"),
        "event_id",
    )
    return P.viewed_methods(events).withColumn(
        "methods_viewed", F.array_join("methods_viewed", ",")
    )


@query(
    """
    SELECT e.event_id AS id, e.user_id AS question_id,
           CASE WHEN o.o_custkey = e.user_id THEN o.o_orderkey END AS attempt_id
    FROM events e LEFT JOIN orders o ON o.o_orderkey = e.event_id
    """
)
def linked_views(spark, sf_dir):
    linked = P.link_views(_views(spark, sf_dir), B.dated_attempts(spark, sf_dir))
    return linked.select("id", "question_id", "attempt_id")


@query(
    """
    SELECT o.o_orderkey AS id, e.event_id IS NOT NULL AS solution_viewed
    FROM orders o LEFT JOIN events e ON e.event_id = o.o_orderkey AND e.user_id = o.o_custkey
    """
)
def viewed_attempts(spark, sf_dir):
    attempts = B.dated_attempts(spark, sf_dir)
    linked = P.link_views(_views(spark, sf_dir), attempts)
    return P.flag_viewed(attempts, linked).select("id", "solution_viewed")


# --- Attempts stored batch by batch ------------------------------------------

BATCHES = 3


def _stored_attempts(spark, sf_dir, table):
    """All attempts in batches, ``table`` compacted; then the first batch comes again, as errors."""
    catalog = shared_path(spark, "catalog")
    rows = B.dated_attempts(spark, sf_dir)
    fields = S.TABLES["attempts"].fields
    absent = {f.name: F.lit(None) for f in fields if f.name not in rows.columns}
    typed = rows.withColumns(absent).select(*[F.col(f.name).cast(f.dataType) for f in fields])
    batches = [typed.filter(F.col("id").cast("long") % BATCHES == k) for k in range(BATCHES)]
    for k, batch in enumerate(batches):
        sinks.append_rows(batch, catalog, "attempts", f"batch-{k}")
    compaction.compact(spark, catalog, table)
    compaction.drop_superseded(spark, catalog, table)
    again = batches[0].withColumn("assessment_status", F.lit("error"))
    sinks.append_rows(again, catalog, "attempts", "batch-0")
    return catalog


_STORED_SQL = f"""
SELECT id % {BATCHES} AS batch, id, question_id, method, attempted_at,
       CASE WHEN id % {BATCHES} = 0 THEN 'error' ELSE assessment_status END AS assessment_status
FROM ({B.DATED_ATTEMPTS_SQL})
"""


@query(
    f"""
    SELECT question_id, assessment_status, count(*) AS attempts, min(id) AS first_id,
           max(attempted_at)::date AS last_day
    FROM ({_STORED_SQL}) GROUP BY question_id, assessment_status
    """
)
def compacted_attempts(spark, sf_dir):
    """Batches and their compacted generation read as one table."""
    stored = sinks.read_committed(spark, _stored_attempts(spark, sf_dir, "attempts"), "attempts")
    return stored.groupBy(F.col("question_id").cast("long"), "assessment_status").agg(
        F.count("*").alias("attempts"),
        F.min(F.col("id").cast("long")).alias("first_id"),
        F.max("attempted_at").cast("date").alias("last_day"),
    )


@query(
    f"""
    SELECT 'batch-' || batch AS id, 'completed' AS status, count(*) AS records_imported
    FROM ({_STORED_SQL}) GROUP BY batch
    """
)
def compacted_runs(spark, sf_dir):
    """One audit row per batch, from the generation or written since."""
    runs = sinks.read_table(spark, _stored_attempts(spark, sf_dir, "import_runs"), "import_runs")
    return runs.select("id", "status", "records_imported")
