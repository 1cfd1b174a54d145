"""Reports over learner attempts, quizzes, sessions and solution views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillmark import schemas as S
from drillmark.functions.scoring import is_solved, mean_or_zero
from drillmark.operators.joins import left_join_known
from drillmark.operators.predicates import all_of, equals, has_marks, has_member



def _newest_first(time: str = "attempted_at", key: str = "id") -> list[Column]:
    return [F.col(time).desc_nulls_last(), F.col(key).desc_nulls_last()]


def _attempts_of(
    attempts: DataFrame, questions: DataFrame, question_type, difficulty, method
) -> DataFrame:
    """Attempts joined to their question, filtered on both sides."""
    wanted = questions.filter(
        all_of(equals("question_type", question_type), equals("difficulty", difficulty))
    ).select(F.col("id").alias("question_id"), "title", "question_type", "difficulty")
    return attempts.filter(all_of(equals("method", method))).join(wanted, "question_id")


def per_question(attempts: DataFrame, method: str | None = None) -> DataFrame:
    """One row per attempted question, built before any join.

    A question with a third of all attempts shrinks to one row per map task.
    """
    percent = F.col("percentage_correct")
    return (
        attempts.filter(all_of(equals("method", method)))
        .groupBy("question_id")
        .agg(
            F.count("*").alias("attempts"),
            F.max(is_solved(F.col("assessment_status"), percent)).alias("solved"),
            F.sum(percent).alias("percent_sum"),
            F.count(percent).alias("percent_count"),
        )
    )


def progress_summary(
    attempts: DataFrame, questions: DataFrame, question_type=None, difficulty=None, method=None
) -> DataFrame:
    """A1: attempts and distinct attempted, solved and assessed questions."""
    wanted = questions.filter(
        all_of(equals("question_type", question_type), equals("difficulty", difficulty))
    ).select(F.col("id").alias("question_id"))
    joined = per_question(attempts, method).join(wanted, "question_id")
    return joined.agg(
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("total_attempts"),
        F.count("*").alias("attempted_questions"),
        F.count_if("solved").alias("solved_questions"),
        F.count_if(F.col("percent_count") > 0).alias("assessed_questions"),
    ).withColumn("solved_threshold", F.lit(S.SOLVED_PERCENT))


def progress_by_difficulty(
    attempts: DataFrame, questions: DataFrame, question_type=None, difficulty=None, method=None
) -> DataFrame:
    """A2: attempts and mean percent per difficulty; the scale place is exposed."""
    wanted = questions.filter(
        all_of(equals("question_type", question_type), equals("difficulty", difficulty))
    ).select(F.col("id").alias("question_id"), "difficulty")
    return (
        per_question(attempts, method)
        .join(wanted, "question_id")
        .groupBy("difficulty")
        .agg(
            F.sum("attempts").alias("attempts"),
            (F.sum("percent_sum") / F.nullif(F.sum("percent_count"), F.lit(0))).alias("avg_pct"),
        )
        .orderBy("difficulty")
    )


def recent_attempts(
    attempts: DataFrame, questions: DataFrame, n: int = 5, question_type=None, difficulty=None, method=None
) -> DataFrame:
    """K2: the newest attempts."""
    joined = _attempts_of(attempts, questions, question_type, difficulty, method)
    return joined.orderBy(*_newest_first()).limit(n)


def attempt_history(
    attempts: DataFrame, questions: DataFrame, question_type=None, difficulty=None, method=None
) -> DataFrame:
    """K1: every attempt, by title, then newest first.

    A global sort on (title, time, id): the range partitioner cuts through a
    title with many attempts.
    """
    joined = _attempts_of(attempts, questions, question_type, difficulty, method)
    return joined.orderBy(F.col("title").asc_nulls_last(), *_newest_first())


def question_attempts(attempts: DataFrame, question_id) -> DataFrame:
    """K3: attempts of one question, newest first."""
    return attempts.filter(F.col("question_id") == F.lit(question_id)).orderBy(*_newest_first())


def question_flags(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """Attempts per question and whether one of them solved it."""
    titles = questions.select(F.col("id").alias("question_id"), "title")
    return (
        per_question(attempts)
        .join(titles, "question_id")
        .select("question_id", "title", "attempts", "solved")
    )


def marks_table(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """one display row per marked attempt."""
    joined = _attempts_of(attempts, questions, None, None, None)
    return has_marks(joined).select(
        F.col("title").alias("Question"),
        F.substring(F.col("id").cast("string"), 1, 8).alias("Attempt"),
        F.col("method").alias("Method"),
        F.col("marks").alias("Marks"),
        F.col("percentage_correct").alias("Percent"),
        F.date_format("attempted_at", "yyyy-MM-dd HH:mm").alias("Time"),
    )


def activity_overview(facts: dict[str, DataFrame]) -> DataFrame:
    """Row count per activity; each table is counted on its own scan."""
    counts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("activity"), "n")
        for name, df in facts.items()
    ]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


def _quizzes(quizzes: DataFrame, question_type, difficulty, method) -> DataFrame:
    return quizzes.filter(
        all_of(
            equals("question_type", question_type),
            equals("difficulty", difficulty),
            equals("method", method),
        )
    )


def quiz_progress(quizzes: DataFrame, question_type=None, difficulty=None, method=None) -> DataFrame:
    """A3, F2: all, completed and passed quizzes."""
    completed = F.col("status") == "completed"
    return _quizzes(quizzes, question_type, difficulty, method).agg(
        F.count("*").alias("total_attempts"),
        F.count_if(completed).alias("completed_attempts"),
        F.count_if(completed & F.col("passed")).alias("passed_attempts"),
    )


def quiz_history(quizzes: DataFrame, question_type=None, difficulty=None, method=None) -> DataFrame:
    """K5: quizzes, newest first."""
    return _quizzes(quizzes, question_type, difficulty, method).orderBy(
        *_newest_first("started_at")
    )


def session_summary(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """Sessions (empty ones too), their items, mean scored score."""
    scored = F.when(F.col("status") == "scored", F.col("score"))
    per_session = items.groupBy("session_id").agg(
        F.count("*").alias("items"),
        F.sum(scored).alias("score_sum"),
        F.count(scored).alias("score_count"),
    )
    return (
        sessions.select("session_id")
        .join(per_session, "session_id", "left")
        .agg(
            F.count("*").alias("sessions"),
            F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
            (F.sum("score_sum") / F.nullif(F.sum("score_count"), F.lit(0))).alias("mean_score"),
        )
        .withColumn("shown_mean", mean_or_zero(F.col("mean_score")))
    )


def interview_summary(sessions: DataFrame) -> DataFrame:
    """A5: sessions, completed ones and their mean score."""
    completed = F.col("status") == "completed"
    return sessions.agg(
        F.count("*").alias("interviews"),
        F.count_if(completed).alias("completed"),
        F.avg(F.when(completed, F.col("overall_score"))).alias("mean_score"),
    )


def latest_interviews(sessions: DataFrame, n: int = 100) -> DataFrame:
    """K6."""
    return sessions.orderBy(*_newest_first("started_at", "session_id")).limit(n)


def latest_scored_items(items: DataFrame, catalog: DataFrame, n: int = 100) -> DataFrame:
    """The newest scored items with their catalog entry."""
    return (
        items.filter(F.col("status") == "scored")
        .join(catalog, "item_id")
        .orderBy(F.col("answered_at").desc_nulls_last(), F.col("item_id").desc_nulls_last())
        .limit(n)
    )


def solution_view_history(
    views: DataFrame, questions: DataFrame, n: int = 100, question_type=None, difficulty=None, method=None
) -> DataFrame:
    """The newest solution views."""
    wanted = questions.filter(
        all_of(equals("question_type", question_type), equals("difficulty", difficulty))
    ).select(F.col("id").alias("question_id"), "title")
    return (
        views.filter(all_of(has_member("methods_viewed", method)))
        .join(wanted, "question_id")
        .orderBy(*_newest_first("viewed_at"))
        .limit(n)
    )


def viewed_methods(view_events: DataFrame) -> DataFrame:
    """Distinct methods of each view in first-seen order.

    Repeats collapse before the list is built; a view has at most as many
    entries as there are methods.
    """
    first_seen = view_events.groupBy("view_id", "method").agg(
        F.min(F.struct("viewed_at", "event_id")).alias("_first")
    )
    listed = F.array_sort(F.collect_list(F.struct("_first", "method")))
    return first_seen.groupBy("view_id").agg(listed["method"].alias("methods_viewed"))


def link_views(views: DataFrame, attempts: DataFrame) -> DataFrame:
    """Keep a view's attempt only when it is an attempt at the same question."""
    known = attempts.select(F.col("id").alias("attempt_id"), "question_id").withColumn(
        "_known", F.lit(True)
    )
    return (
        left_join_known(views, known, ["attempt_id", "question_id"], "attempt_id")
        .withColumn("attempt_id", F.when(F.col("_known"), F.col("attempt_id")))
        .drop("_known")
    )


def flag_viewed(attempts: DataFrame, linked_views: DataFrame) -> DataFrame:
    """Mark the attempts that have a linked solution view."""
    viewed = (
        linked_views.filter(F.col("attempt_id").isNotNull())
        .select(F.col("attempt_id").alias("id"))
        .distinct()
        .withColumn("_seen", F.lit(True))
    )
    return (
        attempts.join(viewed, "id", "left")
        .withColumn("solution_viewed", F.coalesce("_seen", F.lit(False)))
        .drop("_seen")
    )
