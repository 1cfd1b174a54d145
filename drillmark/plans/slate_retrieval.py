"""Registered queries: reference retrieval and context assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from drillmark.functions.payload import nested_rows
from drillmark.functions.scoring import render_template
from drillmark.operators.barrier import dealt
from drillmark.operators.predicates import shared_assets
from drillmark.plans import bindings as B
from drillmark.plans import retrieval as R
from drillmark.plans.registry import query

# One request per line of the comparison SQL below.
REQUESTS = [
    R.Request("en", "Medium", "that"),
    R.Request("en", "Very Hard", "general"),
    R.Request("fr", "Hard", "leaux"),
    R.Request("de", "Easy", "src3"),
    R.Request("es", "Beginner", "nosuchtopic"),
]
_REQUESTS_SQL = "VALUES " + ", ".join(
    f"({no}, '{r.question_type}', '{r.difficulty}', '{r.topic}')"
    for no, r in enumerate(REQUESTS, 1)
)

_SCORED = f"""
SELECT r.request_no, r.topic, d.*, s.dataset_name,
       CASE WHEN d.difficulty = r.difficulty THEN 2 ELSE 0 END
       + CASE WHEN r.topic <> 'general' AND contains(lower(d.title || ' ' || d.problem_statement
              || ' ' || to_json(d.tags)::varchar), lower(r.topic)) THEN 4 ELSE 0 END AS score
FROM ({B.CORPUS_SQL}) d JOIN ({B.CORPUS_SOURCES_SQL}) s ON s.id = d.source_id
JOIN ({_REQUESTS_SQL}) r(request_no, question_type, difficulty, topic)
  ON r.question_type = d.question_type
WHERE NOT d.is_ai_generated
"""
_TOP = f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY request_no ORDER BY score DESC, title, id) AS place
  FROM ({_SCORED})) WHERE place <= 3
"""
_CLIP = "CASE WHEN length({0}) <= {1} THEN {0} ELSE left({0}, {1} - 1) || '…' END"
_STATEMENT = _CLIP.format("problem_statement", 600)


@query(
    f"""
    SELECT id AS question_id, dataset_name, title, difficulty,
           {_STATEMENT} AS problem_statement, score
    FROM ({_TOP}) WHERE request_no = 1
    """
)
def relevance_topk(spark, sf_dir):
    top = R.top_references(B.corpus(spark, sf_dir), B.corpus_sources(spark, sf_dir), REQUESTS[0])
    return top.select(
        "question_id", "dataset_name", "title", "difficulty", "problem_statement", "score"
    )


def _references(spark, sf_dir):
    return R.top_references_batch(
        B.corpus(spark, sf_dir), B.corpus_sources(spark, sf_dir), REQUESTS
    )


@query(f"SELECT request_no, id AS question_id, score, place FROM ({_TOP})")
def relevance_topk_batch(spark, sf_dir):
    return _references(spark, sf_dir).select("request_no", "question_id", "score", "place")


def _assets(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "schema").otherwise("starter_code")
    return B.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("question_id"),
        F.col("turn").alias("id"),
        kind.alias("asset_type"),
        F.lit(None).cast("string").alias("method"),
        F.col("text").alias("content"),
    )


def _solutions(spark, sf_dir):
    method = F.when(F.col("role") == "assistant", "sql").otherwise("pandas")
    return B.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("question_id"),
        F.col("turn").alias("id"),
        method.alias("method"),
        F.col("text").alias("code"),
    )


_FIRSTS = """
SELECT conv_id, min_by(CASE WHEN role = 'user' THEN text END, turn)
         FILTER (WHERE role = 'user') AS schema_sql,
       min_by(text, turn) FILTER (WHERE role = 'assistant') AS code
FROM conversations GROUP BY conv_id
"""


@query(
    f"""
    SELECT d.doc_id AS question_id,
           CASE WHEN f.schema_sql IS NULL THEN '' ELSE {_CLIP.format('f.schema_sql', 400)} END
             AS schema_sql,
           CASE WHEN f.code IS NULL THEN '' ELSE {_CLIP.format('f.code', 300)} END
             AS reference_solution
    FROM documents d LEFT JOIN ({_FIRSTS}) f ON f.conv_id = d.doc_id
    """
)
def first_asset_join(spark, sf_dir):
    ids = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"))
    return R.with_first_assets(ids, _assets(spark, sf_dir), _solutions(spark, sf_dir))


_MEMBERS = f"""
SELECT request_no, place, id AS question_id,
       '{{"title":' || to_json(title)::varchar || ',"difficulty":' || to_json(difficulty)::varchar
       || ',"problem_statement":' || to_json({_STATEMENT})::varchar
       || ',"tags":' || to_json(tags)::varchar
       || CASE WHEN f.schema_sql IS NULL THEN '' ELSE
            ',"schema_sql":' || to_json({_CLIP.format('f.schema_sql', 400)})::varchar END
       || CASE WHEN f.code IS NULL THEN '' ELSE
            ',"reference_solution":' || to_json({_CLIP.format('f.code', 300)})::varchar END
       || '}}' AS reference,
       4 + 3 + 1 + CASE WHEN f.schema_sql IS NULL THEN 0 ELSE 2 END
       + CASE WHEN f.code IS NULL THEN 0 ELSE 2 END AS blanks
FROM ({_TOP}) t LEFT JOIN ({_FIRSTS}) f ON f.conv_id = t.id
"""


@query(
    f"""
    WITH m AS (SELECT *, length(reference) + blanks AS chars FROM ({_MEMBERS})),
    r AS (SELECT *, 2 + 2 * (place - 1)
                 + sum(chars) OVER (PARTITION BY request_no ORDER BY place) AS running FROM m)
    SELECT request_no, count(*) AS "references",
           '[' || string_agg(reference, ', ' ORDER BY place) || ']' AS context
    FROM r WHERE running <= 1500 GROUP BY request_no
    """
)
def budget_packed_context(spark, sf_dir):
    return R.context_documents(
        B.corpus(spark, sf_dir),
        B.corpus_sources(spark, sf_dir),
        _assets(spark, sf_dir),
        _solutions(spark, sf_dir),
        REQUESTS,
        budget=1500,
    )


@query(
    f"""
    WITH shown AS (SELECT request_no, lower(concat_ws(' ', title, difficulty, {_STATEMENT},
                          source_tags)) AS body
                   FROM (SELECT *, array_to_string(tags, ' ') AS source_tags FROM ({_TOP})))
    SELECT r.request_no, r.topic, count(s.body) AS local_references,
           count(s.body) < 3 AS few_references,
           r.topic <> 'general' AND NOT coalesce(bool_or(contains(s.body, lower(r.topic))), false)
             AS topic_missing
    FROM ({_REQUESTS_SQL}) r(request_no, question_type, difficulty, topic)
    LEFT JOIN shown s ON s.request_no = r.request_no GROUP BY r.request_no, r.topic
    """
)
def research_needed(spark, sf_dir):
    requests = R.request_frame(spark, REQUESTS)
    flags = R.needs_research(requests, _references(spark, sf_dir))
    return flags.select("request_no", "topic", "local_references", "few_references", "topic_missing")


@query(
    f"""
    SELECT request_no, '[' || string_agg('{{"question_id":"' || id || '","dataset_name":"'
                                         || dataset_name || '"}}', ',' ORDER BY place) || ']'
             AS context_sources
    FROM ({_TOP}) GROUP BY request_no
    """
)
def context_provenance(spark, sf_dir):
    references = _references(spark, sf_dir).withColumn("source_url", F.lit(None).cast("string"))
    return R.provenance(references)


_ASSET_KIND = """CASE event_type WHEN 'view' THEN 'schema' WHEN 'click' THEN 'fixture_data'
  WHEN 'purchase' THEN 'expected_result' ELSE 'starter_code' END"""
_ASSET_METHOD = "CASE WHEN value < 5 THEN NULL WHEN value < 10 THEN 'shared' ELSE '2-HIGH' END"


def _event_assets(spark, sf_dir):
    kinds = F.when(F.col("event_type") == "view", "schema").when(
        F.col("event_type") == "click", "fixture_data"
    ).when(F.col("event_type") == "purchase", "expected_result")
    method = F.when(F.col("value") >= 10, "2-HIGH").when(F.col("value") >= 5, "shared")
    return B.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("question_id"),
        F.col("event_id").alias("id"),
        kinds.otherwise("starter_code").alias("asset_type"),
        method.alias("method"),
        F.col("props").alias("content"),
    )


def _event_cases(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("question_id"),
        F.col("event_id").alias("id"),
        F.col("event_type").alias("input_data"),
        F.col("props").alias("expected_output"),
    )


def _with_examples(questions):
    """Customers with nested examples: 21 entries, the first with a long text and a long list.

    They are dealt while they are narrow: the whole table is one small file.
    """
    questions = dealt(questions)
    name = F.col("title")
    one = F.struct(F.lit(1).alias("n"), F.repeat(name, 200).alias("text"), F.struct(F.sequence(F.lit(1), F.lit(25)).alias("list")).alias("deep"))
    other = F.struct(F.lit(2).alias("n"), name.alias("text"), F.struct(F.sequence(F.lit(1), F.lit(2)).alias("list")).alias("deep"))
    return questions.withColumns(
        {
            "examples": F.to_json(F.concat(F.array(one), F.array_repeat(other, 20))),
            "expected_output_format": F.concat(F.lit("as a table of "), name),
        }
    )


def _order_solutions(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("question_id"),
        F.col("o_orderpriority").alias("method"),
        F.col("o_orderkey").alias("id"),
        F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("code"),
    )


@query(
    f"""
    WITH solution AS (SELECT o_custkey, o_orderpriority,
           min_by(concat_ws(' ', o_orderstatus, o_orderpriority), o_orderkey) AS code
           FROM orders GROUP BY ALL),
    usable AS (SELECT p.o_custkey, p.o_orderpriority, e.event_id, {_ASSET_KIND} AS kind, e.props,
             row_number() OVER (PARTITION BY p.o_custkey, p.o_orderpriority ORDER BY e.event_id) AS n
           FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) p
           JOIN events e ON e.user_id = p.o_custkey
           WHERE {_ASSET_KIND} <> 'starter_code' AND ({_ASSET_METHOD} IS NULL
                 OR {_ASSET_METHOD} = 'shared' OR {_ASSET_METHOD} = p.o_orderpriority)),
    assets AS (SELECT o_custkey, o_orderpriority,
             string_agg(kind || props, ',' ORDER BY n) AS assets
           FROM usable WHERE n <= 10 GROUP BY ALL),
    cases AS (SELECT user_id, string_agg(event_type || props, ',' ORDER BY event_id) AS cases
           FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n
                 FROM events) WHERE n <= 10 GROUP BY user_id)
    SELECT o.o_orderkey AS submission_id, c.c_name AS title, s.code AS reference_solution,
           a.assets, k.cases, 21 AS examples, c.c_name AS last_example
    FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
    LEFT JOIN solution s USING (o_custkey, o_orderpriority)
    LEFT JOIN assets a USING (o_custkey, o_orderpriority)
    LEFT JOIN cases k ON k.user_id = o.o_custkey
    """
)
def review_context(spark, sf_dir):
    submissions = B.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("submission_id"),
        F.col("o_custkey").alias("question_id"),
        F.col("o_orderpriority").alias("method"),
    )
    context = R.review_context(
        submissions,
        _with_examples(B.customer_questions(spark, sf_dir)),
        _order_solutions(spark, sf_dir),
        _event_assets(spark, sf_dir),
        _event_cases(spark, sf_dir),
    )
    assets = F.transform("assets", lambda a: F.concat(a["type"], a["content"]))
    cases = F.transform("cases", lambda c: F.concat(c["input"], c["expected_output"]))
    return context.select(
        "submission_id",
        F.col("question.title").alias("title"),
        "reference_solution",
        F.array_join(assets, ",").alias("assets"),
        F.array_join(cases, ",").alias("cases"),
        F.json_array_length("question.examples").alias("examples"),
        F.get_json_object("question.examples", "$[20].text").alias("last_example"),
    )


@query(
    f"""
    WITH assets AS (SELECT user_id, string_agg(kind || ':' || content, ',' ORDER BY kind) AS assets
      FROM (SELECT user_id, {_ASSET_KIND} AS kind, max_by(props, event_id) AS content
            FROM events GROUP BY ALL) GROUP BY user_id),
    cases AS (SELECT user_id, string_agg(event_type || props, ',' ORDER BY n) AS cases
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
      WHERE n <= 20 GROUP BY user_id),
    solutions AS (SELECT o_custkey, string_agg(o_orderpriority || ':' || o_orderstatus, ','
                                               ORDER BY n) AS stored
      FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n
            FROM orders) WHERE n <= 12 GROUP BY o_custkey)
    SELECT c.c_custkey AS question_id, c.c_name AS title, assets, cases, stored, 20 AS examples,
           left(repeat(c.c_name, 200), 3000) AS first_example, 20 AS listed,
           'as a table of ' || c.c_name AS expected_output_format
    FROM customer c LEFT JOIN assets a ON a.user_id = c.c_custkey
    LEFT JOIN cases k ON k.user_id = c.c_custkey
    LEFT JOIN solutions s ON s.o_custkey = c.c_custkey
    """
)
def teaching_context(spark, sf_dir):
    context = R.teaching_context(
        _with_examples(B.customer_questions(spark, sf_dir)),
        _event_assets(spark, sf_dir),
        _event_cases(spark, sf_dir),
        _order_solutions(spark, sf_dir),
    )
    assets = F.transform(
        F.array_sort(F.map_entries("assets")), lambda a: F.concat_ws(":", a["key"], a["value"])
    )
    cases = F.transform("test_cases", lambda c: F.concat(c["input"], c["expected"]))
    stored = F.transform(
        "stored_references",
        lambda s: F.concat_ws(":", s["method"], F.substring_index(s["code"], " ", 1)),
    )
    return context.select(
        "question_id",
        "title",
        F.array_join(assets, ",").alias("assets"),
        F.array_join(cases, ",").alias("cases"),
        F.array_join(stored, ",").alias("stored"),
        F.json_array_length("examples").alias("examples"),
        F.get_json_object("examples", "$[0].text").alias("first_example"),
        F.json_array_length(F.get_json_object("examples", "$[0].deep.list")).alias("listed"),
        "expected_output_format",
    )


@query(
    f"""
    WITH numbered AS (
      SELECT quiz_id, item_id, question_id,
             row_number() OVER (PARTITION BY quiz_id ORDER BY item_id) AS n
      FROM ({B.QUIZ_ITEMS_SQL}) WHERE answer_format = 'mcq')
    SELECT quiz_id, (n - 1) // 10 AS document_no, count(*) AS items,
           string_agg(p_name || '/' || p_partkey, ',' ORDER BY n) AS contexts
    FROM numbered JOIN part ON p_partkey = question_id GROUP BY quiz_id, (n - 1) // 10
    """
)
def choice_contexts(spark, sf_dir):
    items = B.quiz_items(spark, sf_dir).select(
        "quiz_id",
        "question_id",
        "answer_format",
        F.col("item_id").alias("position"),
        F.lit("sql").alias("method"),
    )
    questions = B.questions(spark, sf_dir).withColumn("constraints", F.lit(None).cast("string"))
    documents = R.choice_contexts(items, questions, block=F.substring("position", 1, 8))
    shown = F.transform("contexts", lambda c: F.concat_ws("/", c["title"], c["question_id"]))
    return documents.select(
        "quiz_id", "document_no", "items", F.array_join(shown, ",").alias("contexts")
    )


# A page in another language stands for a search that returned plain text.
_HAS_ROWS = """regexp_extract(html, 'lang="([a-z]+)"', 1) IN ('en', 'fr', 'de')"""


def _web_reply():
    """Reply texts in the shapes that searches return, one per page."""
    row = F.struct(
        F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"),
        "url",
        F.col("html").alias("markdown"),
    )
    file_row = F.struct(F.col("url").alias("title"), F.lit("ftp://x").alias("url"))
    deep = F.to_json(F.struct(F.struct(F.array(row).alias("web")).alias("data")))
    flat = F.to_json(F.struct(F.array(row).alias("results")))
    bare = F.concat(F.lit("["), F.to_json(row), F.lit(","), F.to_json(file_row), F.lit("]"))
    lang = F.regexp_extract("html", 'lang="([a-z]+)"', 1)
    return (
        F.when(lang == "en", deep)
        .when(lang == "fr", flat)
        .when(lang == "de", bare)
        .otherwise(F.col("url"))
    )


@query(
    f"""
    SELECT page_id, url,
           left(coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)', 1)), ''), url), 300)
             AS title,
           least(length(trim(html)), 6000) AS excerpt_chars
    FROM pages WHERE {_HAS_ROWS}
    """
)
def web_reference_cleanup(spark, sf_dir):
    pages = B.table(spark, sf_dir, "pages").select("page_id", _web_reply().alias("reply"))
    cleaned = pages.select(
        "page_id", F.inline(R.clean_references(nested_rows(F.col("reply"))))
    )
    return cleaned.select("page_id", "url", "title", F.length("excerpt").alias("excerpt_chars"))


@query(
    """
    SELECT p_partkey AS id,
           'Write a ' || p_type || ' question about ' || p_name || ' (' || p_brand || ').' AS prompt
    FROM part
    """
)
def rendered_prompts(spark, sf_dir):
    prompt = render_template(
        "Write a {{kind}} question about {{topic}} ({{brand}}).",
        kind=F.col("p_type"),
        topic=F.col("p_name"),
        brand=F.col("p_brand"),
    )
    return B.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), prompt.alias("prompt")
    )


@query(
    f"""
    SELECT request_no, title, dataset_name, NULL AS url FROM ({_TOP})
    UNION ALL
    SELECT NULL, left(coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)', 1)), ''), url), 300),
           'web', url FROM pages WHERE {_HAS_ROWS}
    """
)
def local_and_web_references(spark, sf_dir):
    local = _references(spark, sf_dir).select("request_no", "title", "dataset_name")
    pages = B.table(spark, sf_dir, "pages").select(_web_reply().alias("reply"))
    web = pages.select(F.inline(R.clean_references(nested_rows(F.col("reply"))))).select(
        "title", "url", F.lit("web").alias("dataset_name")
    )
    return R.all_references(local, web)


@query(
    f"""
    SELECT event_id AS id, props AS content FROM events
    WHERE event_type = 'view' AND ({_ASSET_METHOD} IS NULL OR {_ASSET_METHOD} = 'shared')
    """
)
def shared_schema_assets(spark, sf_dir):
    return shared_assets(_event_assets(spark, sf_dir), "schema").select("id", "content")
