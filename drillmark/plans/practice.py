"""Quizzes and timed sessions as batch jobs: assembly, scoring, status folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillmark import schemas as S
from drillmark.functions.scoring import (
    given_answer,
    item_score,
    level_difficulty,
    round_robin,
    seeded_unit,
    uses_local,
)
from drillmark.functions.text import clip_error, is_blank
from drillmark.operators.joins import salted_join, spread_join
from drillmark.operators.ordered import latest_per_key, top_per_key
from drillmark.operators.predicates import is_unfinished, with_status
from drillmark.operators.sampling import draw, next_unused, pool_sizes

# --- Attempts ----------------------------------------------------------------


def attempt_states(events: DataFrame) -> DataFrame:
    """Current state of each attempt from its event log.

    Events are (attempt_id, seq, status, submitted_code, percentage_correct,
    error).  The submission is the first event's and never changes; status,
    percent and error are the latest event's.
    """
    first = F.min(F.struct("seq", "submitted_code"))
    last = F.max(F.struct("seq", "status", "percentage_correct", "error"))
    return (
        events.groupBy("attempt_id")
        .agg(first.alias("_first"), last.alias("_last"))
        .select(
            "attempt_id",
            F.col("_first.submitted_code").alias("submitted_code"),
            F.col("_last.status").alias("status"),
            F.when(F.col("_last.status") == "completed", F.col("_last.percentage_correct")).alias(
                "percentage_correct"
            ),
            F.when(F.col("_last.status") == "error", clip_error(F.col("_last.error"))).alias(
                "error_details"
            ),
        )
    )


# --- Quiz assembly -----------------------------------------------------------


def open_pool(questions: DataFrame, generated: bool = False) -> DataFrame:
    """The curated, or the generated, questions once per (type, difficulty, method, topic) they serve.

    A question joins the group of each of its methods and of each of its tags,
    and the group of any topic.
    """
    wanted = F.col("is_ai_generated") if generated else ~F.col("is_ai_generated")
    curated = questions.filter(F.col("is_complete") & wanted)
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    topics = F.array_distinct(F.concat(F.array(F.lit(S.ANY_TOPIC)), tags))
    return curated.select(
        F.col("id").alias("question_id"),
        "question_type",
        "difficulty",
        F.explode(F.array_distinct("supported_methods")).alias("method"),
        topics.alias("_topics"),
    ).select(
        "question_id", "question_type", "difficulty", "method", F.explode("_topics").alias("topic")
    )


POOL_GROUP = ["question_type", "difficulty", "method", "topic"]


def assemble_quizzes(requests: DataFrame, questions: DataFrame, seed: str) -> DataFrame:
    """Items of every requested quiz, coding items first.

    Requests are (quiz_id, question_type, difficulty, method, topic,
    total_items, coding_items) that passed ``quiz_settings``.  A quiz whose
    group holds too few questions gets no items; see ``shortages``.
    """
    pool = open_pool(questions)
    drawn = draw(requests, pool, POOL_GROUP, "quiz_id", "question_id", "total_items", seed)
    items = drawn.filter(F.col("pool_size") >= F.col("total_items"))
    return items.select(
        "quiz_id",
        F.col("draw_no").alias("position"),
        "question_id",
        F.when(F.col("draw_no") <= F.col("coding_items"), "coding").otherwise("mcq").alias("answer_format"),
        "method",
    )


def places_of(total: Column, curated: Column, generated: Column, coin: Callable[[Column], Column]) -> Column:
    """For each place of a quiz, from 1, its source and the number of its pick there.

    Heads takes the next generated question, tails the next curated one; when one
    side is used up the other serves all places that are left.  With the heads and
    tails up to a place counted, that place needs no look at the picks before it:
    past the curated ones it takes the generated question of its number less all
    curated ones, and the other way round.  ``total`` is a small number.
    """
    places = F.sequence(F.lit(1), total.cast("int"))
    heads = F.filter(places, coin)

    def placed(k: Column) -> Column:
        ai = F.size(F.filter(heads, lambda h: h <= k))
        dataset = k - ai
        generated_turn = F.struct(k.alias("position"), F.lit("ai_generated").alias("source"), ai.alias("draw_no"))
        curated_turn = F.struct(k.alias("position"), F.lit("dataset").alias("source"), dataset.alias("draw_no"))
        late_ai = F.struct(k.alias("position"), F.lit("ai_generated").alias("source"), (k - curated).cast("int").alias("draw_no"))
        late_set = F.struct(k.alias("position"), F.lit("dataset").alias("source"), (k - generated).cast("int").alias("draw_no"))
        return (
            F.when(dataset > curated, late_ai)
            .when(ai > generated, late_set)
            .when(F.array_contains(heads, k), generated_turn)
            .otherwise(curated_turn)
        )

    return F.transform(places, placed)


def _two_pools(requests: DataFrame, questions: DataFrame) -> DataFrame:
    """Requests with the curated and the generated questions open to them.

    ``question_source`` is dataset, ai_generated or mixed; a source that is not
    asked for holds nothing.
    """
    sized = requests
    for name, generated, other in (("_curated", False, "ai_generated"), ("_generated", True, "dataset")):
        sizes = pool_sizes(open_pool(questions, generated), POOL_GROUP).withColumnRenamed("pool_size", name)
        sized = salted_join(sized, sizes, POOL_GROUP, F.col("quiz_id"), "left")
        usable = F.when(F.col("question_source") != other, F.col(name))
        sized = sized.withColumn(name, F.coalesce(usable, F.lit(0)).cast("int"))
    return sized


def assemble_mixed(requests: DataFrame, questions: DataFrame, seed: str) -> DataFrame:
    """Quizzes from curated and generated questions, a coin per place.

    Requests also have ``question_source``.  Both pools are drawn from without
    replacement; a quiz for which both together hold too few gets no items; see
    ``mixed_shortages``.
    """
    sized = _two_pools(requests, questions).filter(F.col("_curated") + F.col("_generated") >= F.col("total_items"))

    def heads(k: Column) -> Column:
        return seeded_unit(F.concat_ws("-", F.col("quiz_id"), k), seed) < 0.5

    turn = places_of(F.col("total_items"), F.col("_curated"), F.col("_generated"), heads)
    turns = sized.withColumn("_turn", F.explode(turn)).select("quiz_id", "coding_items", "_turn.*")

    def drawn(source: str, generated: bool) -> DataFrame:
        asked = sized.filter(F.col("question_source") != ("dataset" if generated else "ai_generated"))
        picks = draw(asked, open_pool(questions, generated), POOL_GROUP, "quiz_id", "question_id", "total_items", seed)
        return picks.select("quiz_id", F.lit(source).alias("source"), F.col("draw_no").cast("int").alias("draw_no"), "question_id", "method")

    picks = drawn("dataset", False).unionByName(drawn("ai_generated", True))
    # Both sides are exploded from the requests: merged, whatever the size of their file.
    return turns.join(picks.hint("merge"), ["quiz_id", "source", "draw_no"]).select(
        "quiz_id",
        "position",
        "source",
        "question_id",
        F.when(F.col("position") <= F.col("coding_items"), "coding").otherwise("mcq").alias("answer_format"),
        "method",
    )


def mixed_shortages(requests: DataFrame, questions: DataFrame) -> DataFrame:
    """Requests for more questions than their sources hold together."""
    available = F.col("_curated") + F.col("_generated")
    short = _two_pools(requests, questions).withColumn("available", available).filter(available < F.col("total_items"))
    return short.select("quiz_id", "question_source", "total_items", "available")


def shortages(requests: DataFrame, questions: DataFrame) -> DataFrame:
    """Requests that ask for more questions than their group holds."""
    available = pool_sizes(open_pool(questions), POOL_GROUP)
    return (
        salted_join(requests, available, POOL_GROUP, F.col("quiz_id"), "left")
        .withColumn("available", F.coalesce("pool_size", F.lit(0)))
        .filter(F.col("available") < F.col("total_items"))
        .select("quiz_id", "total_items", "available")
    )


def save_choice_content(items: DataFrame, content: DataFrame) -> DataFrame:
    """Choice items take over generated content, others stay as they are."""
    new = content.select(
        "quiz_id",
        "question_id",
        F.col("prompt").alias("_prompt"),
        F.col("options").alias("_options"),
        F.col("correct_option_id").alias("_correct"),
        F.col("explanation").alias("_explanation"),
        F.lit(True).alias("_found"),
    )
    fills = (F.col("answer_format") == "mcq") & F.coalesce("_found", F.lit(False))

    def filled(new_name: str, old_name: str) -> Column:
        return F.when(fills, F.col(new_name)).otherwise(F.col(old_name))

    return (
        items.join(new, ["quiz_id", "question_id"], "left")
        .withColumn("prompt_snapshot", filled("_prompt", "prompt_snapshot"))
        .withColumn("options", filled("_options", "options"))
        .withColumn("correct_option_id", filled("_correct", "correct_option_id"))
        .withColumn("explanation", filled("_explanation", "explanation"))
        .drop("_prompt", "_options", "_correct", "_explanation", "_found")
    )


def retry_plan(quizzes: DataFrame, items: DataFrame) -> DataFrame:
    """What a quiz in preparation error needs: new items, choices, or nothing."""
    per_quiz = items.groupBy("quiz_id").agg(
        F.count("*").alias("items"),
        F.count_if((F.col("answer_format") == "mcq") & F.col("options").isNull()).alias("unfilled"),
    )
    return (
        quizzes.filter(F.col("status") == "preparation_error")
        .join(per_quiz, "quiz_id", "left")
        .select(
            "quiz_id",
            F.when(F.col("items").isNull(), "reselect")
            .when(F.col("unfilled") > 0, "refill")
            .otherwise("ready")
            .alias("action"),
        )
    )


# --- Quiz scoring ------------------------------------------------------------


def score_items(items: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Percent and status of every item.

    Scored items keep their score.  ``reviews`` gives (item_id,
    reviewed_percent) of the code answers; a non-blank code answer without a
    review is in error.
    """
    if reviews is not None:
        items = items.join(reviews, "item_id", "left")
    fresh = item_score(
        F.col("answer_format"),
        F.col("selected_option_id"),
        F.col("correct_option_id"),
        F.col("answer_text"),
        F.col("reviewed_percent"),
    )
    already = F.coalesce(F.col("item_status") == "scored", F.lit(False))
    percent = F.when(already, F.col("percentage_correct")).otherwise(fresh)
    return items.withColumn("percentage_correct", percent).withColumn(
        "item_status", F.when(F.col("percentage_correct").isNull(), "error").otherwise("scored")
    )


def score_quizzes(quizzes: DataFrame, scored_items: DataFrame) -> DataFrame:
    """Equal-weight mean, rounded before the pass test.

    An item in error keeps its quiz open; so does a quiz without items.
    """
    per_quiz = scored_items.groupBy("quiz_id").agg(
        F.count("*").alias("items"),
        F.count_if(F.col("item_status") != "scored").alias("items_in_error"),
        F.round(F.sum("percentage_correct") / F.count("*"), 2).alias("_percent"),
    )
    complete = F.coalesce((F.col("items") > 0) & (F.col("items_in_error") == 0), F.lit(False))
    percent = F.when(complete, F.col("_percent"))
    return (
        quizzes.join(per_quiz, "quiz_id", "left")
        .withColumn("items", F.coalesce("items", F.lit(0)))
        .withColumn("percentage_correct", percent)
        .withColumn(
            "status",
            F.when(complete, "completed")
            .when(F.col("items_in_error") > 0, "evaluation_error")
            .otherwise("preparing"),
        )
        .withColumn("passed", F.col("percentage_correct") >= S.SOLVED_PERCENT)
        .drop("_percent", "items_in_error")
    )


def rescored(items: DataFrame, updates: DataFrame) -> DataFrame:
    """A new score replaces the old one; provider and model only when given."""
    new = updates.select(
        "item_id",
        F.col("percentage_correct").alias("_percent"),
        F.col("provider").alias("_provider"),
        F.col("model_id").alias("_model"),
    )
    rescored_now = F.col("_percent").isNotNull()
    return (
        items.join(new, "item_id", "left")
        .withColumn("item_status", F.when(rescored_now, "scored").otherwise(F.col("item_status")))
        .withColumn("percentage_correct", F.coalesce("_percent", "percentage_correct"))
        .withColumn("provider", F.coalesce("_provider", "provider"))
        .withColumn("model_id", F.coalesce("_model", "model_id"))
        .drop("_percent", "_provider", "_model")
    )


def quiz_states(events: DataFrame) -> DataFrame:
    """Latest status and error of each quiz; unknown statuses are flagged."""
    latest = latest_per_key(events, ["quiz_id"], ["event_ts", "seq"], ["status", "error"])
    return latest.select(
        "quiz_id",
        "status",
        F.when(F.col("status").endswith("_error"), clip_error(F.col("error"))).alias("error_details"),
        (~F.coalesce(F.col("status").isin(*S.QUIZ_STATUSES), F.lit(False))).alias("illegal_status"),
    )


def save_drafts(items: DataFrame, drafts: DataFrame) -> DataFrame:
    """The latest draft of an item goes to the column of its format."""
    latest = drafts.groupBy("item_id").agg(
        F.max(F.struct("seq", "value")).alias("_draft")
    )
    drafted = F.col("_draft").isNotNull()
    coding = F.col("answer_format") == "coding"
    return (
        items.join(latest, "item_id", "left")
        .withColumn(
            "answer_text",
            F.when(drafted & coding, F.col("_draft.value")).otherwise(F.col("answer_text")),
        )
        .withColumn(
            "selected_option_id",
            F.when(drafted & ~coding, F.col("_draft.value")).otherwise(F.col("selected_option_id")),
        )
        .drop("_draft")
    )


def load_quizzes(quizzes: DataFrame, items: DataFrame, questions: DataFrame) -> DataFrame:
    """Header, items and question texts, one row per item, in the order of quiz and position.

    The sort is by ranges of (quiz, position), so a very long quiz is cut over
    tasks and still comes back in order.
    """
    texts = questions.select(
        F.col("id").alias("question_id"), "title", "problem_statement", "constraints", "examples"
    )
    shown = items.join(texts, "question_id")
    return quizzes.join(shown, "quiz_id").orderBy("quiz_id", "position")


def latest_unfinished(quizzes: DataFrame, learner: str = "learner_id") -> DataFrame:
    """Each learner's newest unfinished quiz."""
    return latest_per_key(
        quizzes.filter(is_unfinished(F.col("status"))),
        [learner],
        ["started_at", "quiz_id"],
        ["quiz_id", "started_at", "status"],
    )


# --- Sessions ----------------------------------------------------------------


def plan_turns(turns: DataFrame) -> DataFrame:
    """Format, topic, language, difficulty and source per position.

    Rows carry their session's blueprint columns (formats, topics, languages,
    level, source_mode) and a 1-based position.
    """

    def given_or(column: str, defaults: list[str]) -> Column:
        values = F.col(column)
        return F.when(F.size(values) > 0, values).otherwise(F.array(*[F.lit(d) for d in defaults]))

    position = F.col("position")
    planned_format = round_robin(given_or("formats", ["theory", "coding", "mcq"]), position)
    language = round_robin(given_or("languages", ["python"]), position)
    return turns.select(
        "session_id",
        "position",
        planned_format.alias("answer_format"),
        round_robin(given_or("topics", ["AI engineering"]), position).alias("topic"),
        F.when(planned_format == "coding", language).alias("method"),
        level_difficulty(F.col("level")).alias("difficulty"),
        F.lit("scenario").alias("prompt_style"),
        uses_local(F.col("source_mode"), position).alias("use_local"),
    )


def plan_sessions(sessions: DataFrame, turns_per_session: int) -> DataFrame:
    """P5: the first ``turns_per_session`` positions of every session."""
    positions = F.sequence(F.lit(1), F.lit(turns_per_session))
    return plan_turns(sessions.withColumn("position", F.explode(positions)))


def next_items(
    sessions: DataFrame, used: DataFrame, items: DataFrame, groups, seed: str, topic: str = "topic"
) -> DataFrame:
    """Next unused item of every session, its topic first, then any topic.

    ``groups`` are the filter columns that always hold; ``topic`` is given up
    when the topic's items are used up.  Both questions are asked in one pass:
    items stand in the group of their topic and in that of any topic.
    """
    any_topic = F.lit(None).cast("string")

    def both(df: DataFrame) -> DataFrame:
        rows = F.array(
            F.struct(F.lit(1).alias("_tier"), F.col(topic).cast("string").alias("_topic")),
            F.struct(F.lit(2).alias("_tier"), any_topic.alias("_topic")),
        )
        kept = [c for c in df.columns if c != topic]
        tiers = df.select(*kept, F.inline(rows))
        return tiers.withColumn("_topic", F.coalesce("_topic", F.lit("")))

    picked = next_unused(
        both(sessions), used, both(items), [*groups, "_tier", "_topic"], "session_id", "item_id", seed
    )
    best = F.min(F.struct("_tier", "item_id")).alias("_best")
    return picked.groupBy("session_id").agg(best).select(
        "session_id",
        F.col("_best.item_id").alias("item_id"),
        F.when(F.col("_best._tier") == 1, "topic").otherwise("any").alias("match"),
    )


def last_scored_turns(turns: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` scored turns of each session, oldest first.

    ``recency`` is 1 for the newest; order by position for the oldest first.
    """
    return top_per_key(
        with_status(turns, "scored"), ["session_id"], [F.col("position").desc_nulls_last()], n, "recency"
    ).withColumn("answer", given_answer(F.col("answer_text"), F.col("selected_option")))


def adaptive_context(turns: DataFrame, n: int = 3, sessions: DataFrame | None = None) -> DataFrame:
    """One document per session with its last ``n`` scored turns.

    With ``sessions`` (session_id, blueprint) every session has one, with its
    blueprint; without scored turns the list is empty.
    """
    recent = last_scored_turns(turns, n)
    entry = F.struct(
        "position",
        F.col("prompt").alias("question"),
        "answer_format",
        "method",
        "answer",
        "score",
        F.coalesce("feedback.gaps", F.array().cast("array<string>")).alias("gaps"),
        F.col("feedback.next_focus").alias("next_focus"),
    )
    documents = recent.groupBy("session_id").agg(
        F.array_sort(F.collect_list(entry)).alias("recent_scored_turns")
    )
    if sessions is None:
        return documents
    listed = sessions.select("session_id", "blueprint").join(documents, "session_id", "left")
    empty = F.array().cast(documents.schema["recent_scored_turns"].dataType)
    return listed.withColumn("recent_scored_turns", F.coalesce("recent_scored_turns", empty))


def pending_items(turns: DataFrame) -> DataFrame:
    """Latest pending turn of each session."""
    pending = turns.filter(F.col("status") == "pending")
    return latest_per_key(pending, ["session_id"], ["position"], ["position", "item_id"])


def submit_answers(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """Score the pending turns that got a non-blank answer; others stay.

    ``answers`` gives (session_id, item_id, answer, assessed_score, answered_at).
    """
    given = answers.filter(~is_blank(F.col("answer"))).select(
        "session_id",
        "item_id",
        F.col("answer").alias("_answer"),
        F.col("assessed_score").alias("_assessed"),
        F.col("answered_at").alias("_at"),
    )
    hit = (F.col("status") == "pending") & F.col("_answer").isNotNull()
    choice = F.col("answer_format") == "mcq"
    score = F.when(
        choice, F.when(F.col("_answer") == F.col("correct_option"), 100.0).otherwise(0.0)
    ).otherwise(F.col("_assessed"))
    scored = hit & score.isNotNull()

    def updated(condition: Column, new: Column, old: str) -> Column:
        return F.when(F.col("_hit") & condition, new).otherwise(F.col(old))

    always = F.lit(True)
    return (
        turns.join(given, ["session_id", "item_id"], "left")
        .withColumn("_hit", F.coalesce(scored, F.lit(False)))
        .withColumn("_score", score)
        .withColumn("answer_text", updated(~choice, F.col("_answer"), "answer_text"))
        .withColumn("selected_option", updated(choice, F.col("_answer"), "selected_option"))
        .withColumn("score", updated(always, F.col("_score"), "score"))
        .withColumn("answered_at", updated(always, F.col("_at"), "answered_at"))
        .withColumn("status", updated(always, F.lit("scored"), "status"))
        .drop("_answer", "_assessed", "_at", "_hit", "_score")
    )


def skip_pending(turns: DataFrame) -> DataFrame:
    """Pending turns become skipped with score 0."""
    pending = F.col("status") == "pending"
    return turns.withColumn(
        "score", F.when(pending, 0.0).otherwise(F.col("score"))
    ).withColumn("status", F.when(pending, "skipped").otherwise(F.col("status")))


def close_sessions(sessions: DataFrame, turns: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Closing report over the scored turns; a session without any scores 0.

    ``reports`` gives (session_id, overall_score, summary, strengths, gaps,
    recommendations) of the assessed sessions; without it the mean score of the
    turns is reported.
    """
    per_session = (
        with_status(turns, "scored")
        .groupBy("session_id")
        .agg(F.count("*").alias("scored_turns"), F.avg("score").alias("mean_score"))
    )
    out = sessions.select("session_id").join(per_session, "session_id", "left")
    if reports is None:
        lists = F.lit(None).cast("array<string>")
        out = out.withColumns(
            {
                "overall_score": F.col("mean_score"),
                "summary": F.lit(None).cast("string"),
                "strengths": lists,
                "gaps": lists,
                "recommendations": lists,
            }
        )
    else:
        out = out.join(reports, "session_id", "left")
    empty = F.col("scored_turns").isNull()

    def fixed(values: tuple[str, ...], column: str) -> Column:
        texts = F.array(*[F.lit(v) for v in values]).cast("array<string>")
        return F.when(empty, texts).otherwise(F.col(column)).alias(column)

    return out.select(
        "session_id",
        F.coalesce("scored_turns", F.lit(0)).alias("scored_turns"),
        F.when(empty, 0.0).otherwise(F.col("overall_score")).alias("overall_score"),
        F.when(empty, S.EMPTY_SESSION_SUMMARY).otherwise(F.col("summary")).alias("summary"),
        fixed((), "strengths"),
        fixed(S.EMPTY_SESSION_GAPS, "gaps"),
        fixed(S.EMPTY_SESSION_ADVICE, "recommendations"),
        F.lit("completed").alias("status"),
    )


def transcript(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Session header and turns, one row per turn, in the order of session and position."""
    joined = spread_join(turns, sessions, ["session_id"], F.col("position"))
    return joined.orderBy("session_id", "position")
