"""Registered queries: quizzes and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from drillmark.functions.scoring import deadline, remaining_seconds
from drillmark.operators.ordered import append_positions
from drillmark.plans import backfill as BF
from drillmark.plans import bindings as B
from drillmark.plans import practice as P
from drillmark.plans.registry import query

SEED = "assembly-1"


# --- Attempts ----------------------------------------------------------------


def _attempt_events(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "completed").when(
        F.col("event_type") == "error", "error"
    )
    return B.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("attempt_id"),
        F.col("event_id").alias("seq"),
        status.otherwise("pending").alias("status"),
        F.col("props").alias("submitted_code"),
        F.col("value").alias("percentage_correct"),
        F.col("props").alias("error"),
    )


@query(
    """
    SELECT user_id AS attempt_id, min_by(props, event_id) AS submitted_code,
           CASE max_by(event_type, event_id) WHEN 'purchase' THEN 'completed'
                WHEN 'error' THEN 'error' ELSE 'pending' END AS status,
           CASE WHEN max_by(event_type, event_id) = 'purchase' THEN max_by(value, event_id) END
             AS percentage_correct,
           CASE WHEN max_by(event_type, event_id) = 'error' THEN max_by(props, event_id) END
             AS error_details
    FROM events GROUP BY user_id
    """
)
def attempt_states(spark, sf_dir):
    return P.attempt_states(_attempt_events(spark, sf_dir))


# --- Quiz assembly -----------------------------------------------------------


def _quiz_requests(spark, sf_dir):
    """customer as quiz requests over the part catalog."""
    kinds = {
        "BUILDING": ("STANDARD", "python"),
        "AUTOMOBILE": ("ECONOMY", "java"),
        "MACHINERY": ("LARGE", "sql"),
        "HOUSEHOLD": ("MEDIUM", "pandas"),
        "FURNITURE": ("PROMO", "cpp"),
    }

    def chosen(place: int):
        out = F.lit(None).cast("string")
        for segment, pair in kinds.items():
            out = F.when(F.col("c_mktsegment") == segment, pair[place]).otherwise(out)
        return out

    total = F.greatest(F.lit(1), F.floor(F.col("c_acctbal") / 1000) + 1).cast("int")
    return B.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("quiz_id"),
        chosen(0).alias("question_type"),
        B.customer_level().alias("difficulty"),
        chosen(1).alias("method"),
        F.when(F.col("c_acctbal") < 5000, "general").otherwise("red").alias("topic"),
        total.alias("total_items"),
        F.floor(total / 2).cast("int").alias("coding_items"),
    )


_REQUESTS = f"""
SELECT c_custkey AS quiz_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'STANDARD' WHEN 'AUTOMOBILE' THEN 'ECONOMY'
            WHEN 'MACHINERY' THEN 'LARGE' WHEN 'HOUSEHOLD' THEN 'MEDIUM'
            WHEN 'FURNITURE' THEN 'PROMO' END AS question_type,
       q.difficulty,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'python' WHEN 'AUTOMOBILE' THEN 'java'
            WHEN 'MACHINERY' THEN 'sql' WHEN 'HOUSEHOLD' THEN 'pandas'
            WHEN 'FURNITURE' THEN 'cpp' END AS method,
       CASE WHEN c_acctbal < 5000 THEN 'general' ELSE 'red' END AS topic,
       greatest(1, floor(c_acctbal / 1000) + 1)::int AS total_items,
       greatest(1, floor(c_acctbal / 1000) + 1)::int // 2 AS coding_items
FROM customer JOIN ({B.CUSTOMER_QUESTIONS_SQL}) q ON q.id = c_custkey
"""
_MATCHING = f"""
SELECT r.*, p.id AS question_id,
       count(*) OVER (PARTITION BY quiz_id) AS available,
       row_number() OVER (PARTITION BY quiz_id
                          ORDER BY md5(p.id::varchar || ':{SEED}'), p.id) - 1 AS slot,
       ('0x' || substr(md5(quiz_id::varchar || ':{SEED}'), 1, 12))::bigint AS start
FROM ({_REQUESTS}) r JOIN ({B.QUESTIONS_SQL}) p
  ON p.question_type = r.question_type AND p.difficulty = r.difficulty
 AND p.is_complete AND NOT p.is_ai_generated AND list_contains(p.supported_methods, r.method)
 AND (r.topic = 'general' OR list_contains(p.tags, r.topic))
"""


@query(
    f"""
    SELECT quiz_id, (slot - start % available + available) % available + 1 AS position,
           question_id, method,
           CASE WHEN (slot - start % available + available) % available < coding_items
                THEN 'coding' ELSE 'mcq' END AS answer_format
    FROM ({_MATCHING})
    WHERE available >= total_items
      AND (slot - start % available + available) % available < total_items
    """
)
def quiz_assembly(spark, sf_dir):
    return P.assemble_quizzes(_quiz_requests(spark, sf_dir), B.questions(spark, sf_dir), SEED)


_SOURCES = "CASE quiz_id % 3 WHEN 0 THEN 'dataset' WHEN 1 THEN 'ai_generated' ELSE 'mixed' END"
_GENERATED = _MATCHING.replace("NOT p.is_ai_generated", "p.is_ai_generated")
_DRAWN = "SELECT quiz_id, question_id, method, (slot - start % available + available) % available + 1 AS draw_no FROM"
_SIZED = f"""
SELECT r.*, CASE WHEN question_source <> 'ai_generated' THEN coalesce(c.n, 0) ELSE 0 END AS curated,
       CASE WHEN question_source <> 'dataset' THEN coalesce(g.n, 0) ELSE 0 END AS generated
FROM (SELECT *, {_SOURCES} AS question_source FROM ({_REQUESTS})) r
LEFT JOIN (SELECT quiz_id, count(*) AS n FROM ({_MATCHING}) GROUP BY quiz_id) c USING (quiz_id)
LEFT JOIN (SELECT quiz_id, count(*) AS n FROM ({_GENERATED}) GROUP BY quiz_id) g USING (quiz_id)
"""


def _mixed_requests(spark, sf_dir):
    third = F.col("quiz_id") % 3
    source = F.when(third == 0, "dataset").when(third == 1, "ai_generated").otherwise("mixed")
    return _quiz_requests(spark, sf_dir).withColumn("question_source", source)


@query(
    f"""
    WITH coins AS (
        SELECT *, ('0x' || substr(md5(quiz_id || '-' || k || ':{SEED}'), 1, 8))::bigint / 4294967296.0 < 0.5 AS heads
        FROM (SELECT *, unnest(generate_series(1, total_items)) AS k FROM ({_SIZED}) WHERE curated + generated >= total_items)
    ), counted AS (
        SELECT *, count_if(heads) OVER (PARTITION BY quiz_id ORDER BY k) AS ai FROM coins
    ), placed AS (
        SELECT quiz_id, k, coding_items,
               CASE WHEN k - ai > curated THEN 'ai_generated' WHEN ai > generated THEN 'dataset'
                    WHEN heads THEN 'ai_generated' ELSE 'dataset' END AS source,
               CASE WHEN k - ai > curated THEN k - curated WHEN ai > generated THEN k - generated
                    WHEN heads THEN ai ELSE k - ai END AS draw_no
        FROM counted
    ), drawn AS (
        SELECT 'dataset' AS source, * FROM ({_DRAWN} ({_MATCHING}))
        UNION ALL SELECT 'ai_generated', * FROM ({_DRAWN} ({_GENERATED}))
    )
    SELECT quiz_id, k AS position, source, question_id, method,
           CASE WHEN k <= coding_items THEN 'coding' ELSE 'mcq' END AS answer_format
    FROM placed JOIN drawn USING (quiz_id, source, draw_no)
    """
)
def quiz_assembly_mixed(spark, sf_dir):
    return P.assemble_mixed(_mixed_requests(spark, sf_dir), B.questions(spark, sf_dir), SEED)


@query(
    f"""
    SELECT quiz_id, question_source, total_items, curated + generated AS available
    FROM ({_SIZED}) WHERE curated + generated < total_items
    """
)
def quiz_shortages_mixed(spark, sf_dir):
    return P.mixed_shortages(_mixed_requests(spark, sf_dir), B.questions(spark, sf_dir))


@query(
    f"""
    SELECT r.quiz_id, r.total_items, count(m.question_id) AS available
    FROM ({_REQUESTS}) r LEFT JOIN ({_MATCHING}) m USING (quiz_id)
    GROUP BY r.quiz_id, r.total_items HAVING count(m.question_id) < r.total_items
    """
)
def quiz_shortages(spark, sf_dir):
    return P.shortages(_quiz_requests(spark, sf_dir), B.questions(spark, sf_dir))


@query(
    """
    SELECT l_orderkey AS quiz_id, l_partkey AS question_id,
           CASE WHEN l_linenumber > 3 AND p_size > 25 THEN p_name ELSE 'old' END AS prompt_snapshot,
           CASE WHEN l_linenumber > 3 AND p_size > 25 THEN p_brand END AS correct_option_id
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey
    """
)
def filled_choice_items(spark, sf_dir):
    items = B.quiz_items(spark, sf_dir).select(
        "quiz_id",
        "question_id",
        "answer_format",
        F.lit("old").alias("prompt_snapshot"),
        F.lit(None).cast("string").alias("options"),
        F.lit(None).cast("string").alias("correct_option_id"),
        F.lit(None).cast("string").alias("explanation"),
    )
    parts = B.table(spark, sf_dir, "part").filter(F.col("p_size") > 25)
    content = (
        items.select("quiz_id", "question_id")
        .distinct()
        .join(parts, F.col("question_id") == F.col("p_partkey"))
        .select(
            "quiz_id",
            "question_id",
            F.col("p_name").alias("prompt"),
            F.col("p_type").alias("options"),
            F.col("p_brand").alias("correct_option_id"),
            F.col("p_name").alias("explanation"),
        )
    )
    filled = P.save_choice_content(items, content)
    return filled.select("quiz_id", "question_id", "prompt_snapshot", "correct_option_id")


@query(
    """
    WITH items AS (
      SELECT l_orderkey, count(*) AS items,
             count(CASE WHEN l_linenumber > 3 AND l_tax > 0.04 THEN 1 END) AS unfilled
      FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS quiz_id,
           CASE WHEN items IS NULL THEN 'reselect' WHEN unfilled > 0 THEN 'refill'
                ELSE 'ready' END AS action
    FROM orders LEFT JOIN items ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'
    """
)
def retry_plan(spark, sf_dir):
    quizzes = B.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("quiz_id"),
        F.when(F.col("o_orderstatus") == "P", "preparation_error").alias("status"),
    )
    items = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("quiz_id"),
        F.when(F.col("l_linenumber") > 3, "mcq").otherwise("coding").alias("answer_format"),
        F.when(F.col("l_tax") <= 0.04, F.col("l_returnflag")).alias("options"),
    )
    return P.retry_plan(quizzes, items)


# --- Quiz scoring ------------------------------------------------------------

_PER_QUIZ = f"""
SELECT o_orderkey AS quiz_id, o_orderpriority AS difficulty, count(i.quiz_id) AS items,
       CASE WHEN count(i.quiz_id) > 0 AND count(i.score) = count(i.quiz_id)
            THEN round(sum(i.score) / count(*), 2) END AS percentage_correct,
       CASE WHEN count(i.quiz_id) = 0 THEN 'preparing'
            WHEN count(i.score) = count(i.quiz_id) THEN 'completed'
            ELSE 'evaluation_error' END AS status
FROM orders LEFT JOIN ({B.QUIZ_ITEMS_SQL}) i ON i.quiz_id = o_orderkey GROUP BY ALL
"""


def _scored_quizzes(spark, sf_dir):
    quizzes = B.quizzes(spark, sf_dir).select("quiz_id", "difficulty")
    return P.score_quizzes(quizzes, P.score_items(B.quiz_items(spark, sf_dir)))


@query(f"SELECT *, percentage_correct >= 80 AS passed FROM ({_PER_QUIZ})")
def quiz_scores(spark, sf_dir):
    return _scored_quizzes(spark, sf_dir)


@query(
    f"""
    SELECT difficulty, count(*) AS quizzes, count(percentage_correct) AS completed,
           count(CASE WHEN percentage_correct >= 80 THEN 1 END) AS passed
    FROM ({_PER_QUIZ}) GROUP BY difficulty
    """
)
def quiz_pass_rate(spark, sf_dir):
    return (
        _scored_quizzes(spark, sf_dir)
        .groupBy("difficulty")
        .agg(
            F.count("*").alias("quizzes"),
            F.count("percentage_correct").alias("completed"),
            F.count_if("passed").alias("passed"),
        )
    )


@query(
    f"""
    SELECT answer_format, score, count(*) AS n, count(CASE WHEN score IS NULL THEN 1 END) AS errors
    FROM ({B.QUIZ_ITEMS_SQL}) GROUP BY answer_format, score
    """
)
def choice_scores(spark, sf_dir):
    return (
        P.score_items(B.quiz_items(spark, sf_dir))
        .groupBy("answer_format", F.col("percentage_correct").alias("score"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("item_status") == "error").alias("errors"))
    )


@query(
    """
    SELECT o_orderkey AS item_id, coalesce(e.value, o_totalprice) AS percentage_correct,
           CASE WHEN e.value IS NOT NULL THEN 'scored' ELSE 'pending' END AS item_status,
           coalesce(CASE WHEN e.event_type = 'click' THEN 'new' END, o_orderpriority) AS provider
    FROM orders LEFT JOIN events e ON e.event_id = o_orderkey
    """
)
def score_updates(spark, sf_dir):
    items = B.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"),
        F.col("o_totalprice").alias("percentage_correct"),
        F.lit("pending").alias("item_status"),
        F.col("o_orderpriority").alias("provider"),
        F.lit(None).cast("string").alias("model_id"),
    )
    updates = B.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("item_id"),
        F.col("value").alias("percentage_correct"),
        F.when(F.col("event_type") == "click", "new").alias("provider"),
        F.lit(None).cast("string").alias("model_id"),
    )
    return P.rescored(items, updates).drop("model_id")


_QUIZ_STATUS = """CASE event_type WHEN 'view' THEN 'preparing' WHEN 'click' THEN 'in_progress'
  WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'evaluation_error' ELSE event_type END"""


@query(
    f"""
    SELECT user_id AS quiz_id, status, status = 'signup' AS illegal_status,
           CASE WHEN status = 'evaluation_error' THEN props END AS error_details
    FROM (SELECT user_id, props, {_QUIZ_STATUS} AS status,
                 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
          FROM events) WHERE n = 1
    """
)
def quiz_states(spark, sf_dir):
    status = (
        F.when(F.col("event_type") == "view", "preparing")
        .when(F.col("event_type") == "click", "in_progress")
        .when(F.col("event_type") == "purchase", "completed")
        .when(F.col("event_type") == "error", "evaluation_error")
    )
    events = B.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("quiz_id"),
        F.col("ts").alias("event_ts"),
        F.col("event_id").alias("seq"),
        status.otherwise(F.col("event_type")).alias("status"),
        F.col("props").alias("error"),
    )
    return P.quiz_states(events)


@query(
    f"""
    WITH latest AS (SELECT l_orderkey, max_by(l_returnflag, {B.LINE_ID_SQL}) AS value
                    FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS item_id,
           CASE WHEN o_orderstatus = 'F' THEN value END AS answer_text,
           CASE WHEN o_orderstatus <> 'F' THEN value END AS selected_option_id
    FROM orders LEFT JOIN latest ON l_orderkey = o_orderkey
    """
)
def saved_drafts(spark, sf_dir):
    items = B.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"),
        F.when(F.col("o_orderstatus") == "F", "coding").otherwise("mcq").alias("answer_format"),
        F.lit(None).cast("string").alias("answer_text"),
        F.lit(None).cast("string").alias("selected_option_id"),
    )
    drafts = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item_id"),
        B.line_id().alias("seq"),
        F.col("l_returnflag").alias("value"),
    )
    return P.save_drafts(items, drafts).drop("answer_format")


@query(
    f"""
    SELECT z.quiz_id, z.status, i.item_id AS position, q.title, i.answer_format
    FROM ({B.QUIZZES_SQL}) z JOIN ({B.QUIZ_ITEMS_SQL}) i ON i.quiz_id = z.quiz_id
    JOIN ({B.QUESTIONS_SQL}) q ON q.id = i.question_id
    """
)
def loaded_quizzes(spark, sf_dir):
    items = B.quiz_items(spark, sf_dir).select(
        "quiz_id", "question_id", "answer_format", F.col("item_id").alias("position")
    )
    none = F.lit(None).cast("string")
    questions = B.questions(spark, sf_dir).withColumns({"constraints": none, "examples": none})
    quizzes = B.quizzes(spark, sf_dir).select("quiz_id", "status")
    return P.load_quizzes(quizzes, items, questions).select(
        "quiz_id", "status", "position", "title", "answer_format"
    )


@query(
    f"""
    SELECT learner_id, quiz_id, started_at, status FROM (
      SELECT *, row_number() OVER (PARTITION BY learner_id
                                   ORDER BY started_at DESC, quiz_id DESC) AS n
      FROM ({B.QUIZZES_SQL}) WHERE status <> 'completed') WHERE n = 1
    """
)
def latest_unfinished_quiz(spark, sf_dir):
    return P.latest_unfinished(B.quizzes(spark, sf_dir))


# --- Sessions ----------------------------------------------------------------


@query(
    """
    WITH t AS (SELECT conv_id AS session_id, turn + 1 AS position,
                      CASE WHEN conv_id % 2 = 0 THEN ['theory', 'coding'] ELSE NULL END AS formats
               FROM conversations),
    p AS (SELECT *, CASE WHEN formats IS NULL THEN ['theory', 'coding', 'mcq'][(position - 1) % 3 + 1]
                         ELSE formats[(position - 1) % 2 + 1] END AS answer_format FROM t)
    SELECT session_id, position, answer_format,
           ['sets', 'graphs', 'strings', 'joins'][(position - 1) % 4 + 1] AS topic,
           CASE WHEN answer_format = 'coding' THEN ['java', 'sql'][(position - 1) % 2 + 1] END AS method,
           CASE session_id % 4 WHEN 0 THEN 'Easy' WHEN 1 THEN 'Hard' WHEN 2 THEN 'Very Hard'
                ELSE 'Medium' END AS difficulty,
           'scenario' AS prompt_style,
           session_id % 3 = 0 OR (session_id % 3 = 1 AND position % 2 = 1) AS use_local
    FROM p
    """
)
def session_plan(spark, sf_dir):
    key = F.col("session_id")

    def words(*values):
        return F.array(*[F.lit(v) for v in values])

    def one_of(*values):
        return F.get(words(*values), (key % len(values)).cast("int"))

    planned = B.turns(spark, sf_dir).select(
        "session_id",
        "position",
        F.when(key % 2 == 0, words("theory", "coding")).alias("formats"),
        words("sets", "graphs", "strings", "joins").alias("topics"),
        words("java", "sql").alias("languages"),
        one_of("Junior", "senior", "STAFF", "other").alias("level"),
        one_of("local", "mixed", "ai").alias("source_mode"),
    )
    return P.plan_turns(planned)


_LEVEL = """CASE o_orderpriority WHEN '1-URGENT' THEN 'Beginner' WHEN '2-HIGH' THEN 'Easy'
  WHEN '3-MEDIUM' THEN 'Medium' WHEN '4-NOT SPECIFIED' THEN 'Hard' ELSE 'Very Hard' END"""
_TOPIC = "CASE WHEN o_orderstatus = 'F' THEN 'red' ELSE 'ring' END"


@query(
    f"""
    WITH pool AS (SELECT id, difficulty, title,
        row_number() OVER (PARTITION BY difficulty ORDER BY h, id) - 1 AS slot,
        count(*) OVER (PARTITION BY difficulty) AS size
      FROM (SELECT *, md5(id::varchar || ':pick') AS h FROM ({B.QUESTIONS_SQL}))),
    topical AS (SELECT id, difficulty, topic,
        row_number() OVER (PARTITION BY difficulty, topic ORDER BY h, id) - 1 AS slot,
        count(*) OVER (PARTITION BY difficulty, topic) AS size
      FROM (SELECT id, difficulty, split_part(title, ' ', 2) AS topic,
                   md5(id::varchar || ':pick') AS h FROM ({B.QUESTIONS_SQL}))),
    asked AS (SELECT o_orderkey AS session_id, {_LEVEL} AS difficulty, {_TOPIC} AS topic,
        ('0x' || substr(md5(o_orderkey::varchar || ':pick'), 1, 12))::bigint AS start FROM orders),
    used AS (SELECT DISTINCT l_orderkey AS session_id, l_partkey AS id FROM lineitem),
    free AS (
      SELECT a.session_id, t.id, 'topic' AS match, 1 AS tier,
             (t.slot - a.start % t.size + t.size) % t.size AS step
      FROM asked a JOIN topical t USING (difficulty, topic)
      WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.session_id = a.session_id AND u.id = t.id)
      UNION ALL
      SELECT a.session_id, p.id, 'any', 2, (p.slot - a.start % p.size + p.size) % p.size
      FROM asked a JOIN pool p USING (difficulty)
      WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.session_id = a.session_id AND u.id = p.id))
    SELECT session_id, id AS item_id, match FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY tier, step) AS n FROM free)
    WHERE n = 1
    """
)
def next_item_unused(spark, sf_dir):
    level = F.lit("Very Hard")
    for priority, name in (
        ("1-URGENT", "Beginner"),
        ("2-HIGH", "Easy"),
        ("3-MEDIUM", "Medium"),
        ("4-NOT SPECIFIED", "Hard"),
    ):
        level = F.when(F.col("o_orderpriority") == priority, name).otherwise(level)
    sessions = B.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_id"),
        level.alias("difficulty"),
        F.when(F.col("o_orderstatus") == "F", "red").otherwise("ring").alias("topic"),
    )
    used = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("item_id")
    )
    items = B.questions(spark, sf_dir).select(
        F.col("id").alias("item_id"), "difficulty", F.get("tags", F.lit(1)).alias("topic")
    )
    return P.next_items(sessions, used, items, ["difficulty"], "pick")


_LAST3 = f"""
SELECT session_id, position, answer_text, score,
       row_number() OVER (PARTITION BY session_id ORDER BY position DESC) AS recency
FROM ({B.TURNS_SQL}) WHERE status = 'scored'
"""


@query(
    f"""
    SELECT session_id, position, score, recency, answer_text AS answer
    FROM ({_LAST3}) WHERE recency <= 3
    """
)
def last3_turns(spark, sf_dir):
    recent = P.last_scored_turns(B.turns(spark, sf_dir))
    return recent.select("session_id", "position", "score", "recency", "answer")


@query(
    f"""
    WITH told AS (
        SELECT session_id, string_agg(position || '=' || score::int, ',' ORDER BY position) AS recent
        FROM ({_LAST3}) WHERE recency <= 3 GROUP BY session_id
    )
    SELECT session_id, 'blueprint ' || session_id AS blueprint, coalesce(recent, '') AS recent
    FROM (SELECT DISTINCT conv_id AS session_id FROM conversations) LEFT JOIN told USING (session_id)
    """
)
def adaptive_context(spark, sf_dir):
    none = F.lit(None)
    turns = B.turns(spark, sf_dir).withColumns(
        {"method": none.cast("string"), "feedback": none.cast("struct<gaps:array<string>,next_focus:string>")}
    )
    shown = F.transform(
        "recent_scored_turns",
        lambda t: F.concat_ws("=", t["position"].cast("string"), t["score"].cast("int").cast("string")),
    )
    sessions = B.sessions(spark, sf_dir).withColumn("blueprint", F.concat_ws(" ", F.lit("blueprint"), "session_id"))
    documents = P.adaptive_context(turns, sessions=sessions)
    return documents.select("session_id", "blueprint", F.array_join(shown, ",").alias("recent"))


@query(
    f"""
    SELECT session_id, max(position) AS position, max(item_id) AS item_id
    FROM ({B.TURNS_SQL}) WHERE status = 'pending' GROUP BY session_id
    """
)
def pending_items(spark, sf_dir):
    return P.pending_items(B.turns(spark, sf_dir))


@query(
    """
    SELECT q.conv_id AS session_id, q.turn AS item_id,
           CASE WHEN q.role = 'user' AND a.turn IS NOT NULL THEN 'scored'
                WHEN q.role = 'user' THEN 'pending'
                WHEN q.role = 'assistant' THEN 'scored' ELSE 'skipped' END AS status,
           CASE WHEN q.role = 'user' THEN
                  CASE WHEN a.turn IS NOT NULL THEN (length(a.text) % 101)::double END
                ELSE (length(q.text) % 101)::double END AS score
    FROM conversations q
    LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
      AND a.role = 'assistant'
    """
)
def submitted_answers(spark, sf_dir):
    none = F.lit(None)
    turns = B.turns(spark, sf_dir).withColumns(
        {"correct_option": none.cast("string"), "answered_at": none.cast("timestamp")}
    )
    answers = (
        B.table(spark, sf_dir, "conversations")
        .filter(F.col("role") == "assistant")
        .select(
            F.col("conv_id").alias("session_id"),
            (F.col("turn") - 1).alias("item_id"),
            F.col("text").alias("answer"),
            (F.length("text") % 101).cast("double").alias("assessed_score"),
            none.cast("timestamp").alias("answered_at"),
        )
    )
    return P.submit_answers(turns, answers).select("session_id", "item_id", "status", "score")


@query(
    f"""
    SELECT session_id, position,
           CASE WHEN status = 'pending' THEN 'skipped' ELSE status END AS status,
           CASE WHEN status = 'pending' THEN 0.0 ELSE score END AS score
    FROM ({B.TURNS_SQL})
    """
)
def skip_pending(spark, sf_dir):
    skipped = P.skip_pending(B.turns(spark, sf_dir))
    return skipped.select("session_id", "position", "status", "score")


@query(
    f"""
    SELECT s.session_id, count(t.score) AS scored_turns,
           CASE WHEN count(t.score) = 0 THEN 0.0 ELSE round(avg(t.score), 6) END AS overall_score,
           CASE WHEN count(t.score) = 0 THEN 'No answers were submitted.' END AS summary,
           CASE WHEN count(t.score) = 0 THEN 'No assessed answers' END AS gaps,
           'completed' AS status
    FROM (SELECT DISTINCT conv_id AS session_id FROM conversations) s
    LEFT JOIN (SELECT * FROM ({B.TURNS_SQL}) WHERE status = 'scored') t USING (session_id)
    GROUP BY s.session_id
    """
)
def closed_sessions(spark, sf_dir):
    closed = P.close_sessions(B.sessions(spark, sf_dir), B.turns(spark, sf_dir))
    return closed.select(
        "session_id",
        "scored_turns",
        F.round("overall_score", 6).alias("overall_score"),
        "summary",
        F.array_join("gaps", ",").alias("gaps"),
        "status",
    )


@query(
    f"""
    SELECT session_id, position, prompt, status,
           count(*) OVER (PARTITION BY session_id) AS turns FROM ({B.TURNS_SQL})
    """
)
def session_transcript(spark, sf_dir):
    turns = B.turns(spark, sf_dir)
    headers = turns.groupBy("session_id").agg(F.count("*").alias("turns"))
    return P.transcript(headers, turns).select("session_id", "position", "prompt", "status", "turns")


@query(
    """
    SELECT o_orderkey AS session_id, o_orderdate + to_minutes(minutes) AS deadline_at,
           greatest(0, date_diff('second', o_orderdate + INTERVAL 50 MINUTE,
                                 o_orderdate + to_minutes(minutes))) AS remaining
    FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 45
                         WHEN '3-MEDIUM' THEN 60 ELSE 90 END AS minutes FROM orders)
    """
)
def deadline_remaining(spark, sf_dir):
    minutes = F.lit(90)
    for priority, length in (("1-URGENT", 30), ("2-HIGH", 45), ("3-MEDIUM", 60)):
        minutes = F.when(F.col("o_orderpriority") == priority, length).otherwise(minutes)
    checked_at = F.col("o_orderdate") + F.make_dt_interval(mins=F.lit(50))
    timed = B.table(spark, sf_dir, "orders").withColumn(
        "deadline_at", deadline(F.col("o_orderdate"), minutes)
    )
    return timed.select(
        F.col("o_orderkey").alias("session_id"),
        "deadline_at",
        remaining_seconds(F.col("deadline_at"), checked_at).alias("remaining"),
    )


@query(
    """
    WITH new AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n
                 FROM conversations WHERE role = 'assistant'),
    old AS (SELECT conv_id, count(*) AS stored FROM conversations WHERE role <> 'assistant'
            GROUP BY conv_id)
    SELECT new.conv_id AS session_id, turn AS item_id, n + coalesce(stored, 0) AS position
    FROM new LEFT JOIN old ON old.conv_id = new.conv_id
    """
)
def appended_positions(spark, sf_dir):
    turns = B.turns(spark, sf_dir).select("session_id", "item_id", "status")
    incoming = turns.filter(F.col("status") == "scored").drop("status")
    existing = turns.filter(F.col("status") != "scored")
    return append_positions(
        existing, incoming, "session_id", ["item_id"], F.floor(F.col("item_id") / 65536)
    )


# --- Backfills ---------------------------------------------------------------


@query(
    """
    SELECT o_orderkey AS id,
           coalesce(CASE WHEN o_totalprice > 250000 THEN 'completed' END,
                    'legacy_' || CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' END)
             AS assessment_status,
           'legacy:' || o_orderkey AS source_key, 'not_run' AS deterministic_test_result
    FROM orders
    """
)
def backfill_status(spark, sf_dir):
    none = F.lit(None).cast("string")
    result = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "failed")
    attempts = B.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_totalprice") > 250000, "completed").alias("assessment_status"),
        result.alias("test_result"),
        none.alias("source_key"),
        none.alias("deterministic_test_result"),
    )
    return BF.default_test_result(BF.legacy_source_key(BF.legacy_status(attempts))).drop("test_result")


@query(
    """
    SELECT p_partkey AS id,
           CASE WHEN p_type = 'SMALL' AND p_brand <> 'Brand#13'
                THEN 'python,javascript/typescript,java,cpp' ELSE p_brand END AS supported_methods
    FROM part
    """
)
def backfill_methods(spark, sf_dir):
    questions = B.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_type") == "SMALL", "algorithm").alias("question_type"),
        (F.col("p_brand") == "Brand#13").alias("is_ai_generated"),
        F.array("p_brand").alias("supported_methods"),
    )
    expanded = BF.expand_methods(questions)
    return expanded.select("id", F.array_join("supported_methods", ",").alias("supported_methods"))


@query("SELECT coalesce(max(p_size), 0) AS version FROM part")
def schema_version(spark, sf_dir):
    versions = B.table(spark, sf_dir, "part").select(F.col("p_size").alias("version"))
    return BF.schema_version(versions)
