"""Reference retrieval and the assembly of bounded context documents."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drillmark import schemas as S
from drillmark.functions.bounded import bounded_json
from drillmark.functions.payload import as_text, field
from drillmark.functions.topics import mentioned
from drillmark.functions.text import (
    clip,
    clip_ellipsis,
    clip_marked,
    first_filled,
    non_empty,
    strip,
)
from drillmark.operators.barrier import staged
from drillmark.operators.joins import spread_join
from drillmark.operators.ordered import number_rows, top_per_key
from drillmark.operators.predicates import mentions_topic, relevant_asset

# Distinct topics looked for in one pass over a text; at most 100 characters each.
TOPICS_PER_SCAN = 50_000


@dataclass(frozen=True)
class Request:
    """One generation request."""

    question_type: str
    difficulty: str
    topic: str = S.ANY_TOPIC


def first_value(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """First value per key by id, as a pre-aggregate for a left join.

    ``value`` is clipped by the caller, so that no whole text is shuffled.
    """
    return rows.groupBy(*keys).agg(F.min_by(value, "id").alias(name))


def relevance(difficulty: str, topic: str) -> Column:
    """K8: 2 for the difficulty, 4 for a mention of the topic."""
    score = F.when(F.col("difficulty") == difficulty, 2).otherwise(0)
    if topic == S.ANY_TOPIC:
        return score
    tags = F.to_json("tags")
    hit = mentions_topic(F.col("title"), F.col("problem_statement"), tags, topic)
    return score + F.when(hit, 4).otherwise(0)


def _candidates(questions: DataFrame, *scores: Column) -> DataFrame:
    """Questions not generated, with their scores and what a reference shows.

    Texts are scored and clipped in the scan: the joins and sorts that follow
    carry rows of bounded length, never whole texts.
    """
    return questions.filter(~F.col("is_ai_generated")).select(
        F.col("id").alias("question_id"),
        "source_id",
        F.col("title").alias("sort_title"),
        clip_ellipsis(F.col("title"), 120).alias("title"),
        "difficulty",
        clip_ellipsis(F.col("problem_statement"), 600).alias("problem_statement"),
        F.transform(F.slice("tags", 1, 8), lambda t: clip_ellipsis(t, 40)).alias("tags"),
        "is_complete",
        *scores,
    )


def _with_source(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates that have a source."""
    origin = sources.select(F.col("id").alias("source_id"), "dataset_name")
    return candidates.join(origin, "source_id")


def _relevance_order() -> list[Column]:
    return [F.col("score").desc(), F.col("sort_title").asc_nulls_last(), F.col("question_id")]


def top_references(
    questions: DataFrame, sources: DataFrame, request: Request, n: int = S.MAX_REFERENCES
) -> DataFrame:
    """K8: the most relevant questions for one request."""
    typed = questions.filter(F.col("question_type") == request.question_type)
    score = relevance(request.difficulty, request.topic).alias("score")
    scored = _with_source(_candidates(typed, score), sources)
    return scored.orderBy(*_relevance_order()).limit(n)


def _with_topics(questions: DataFrame, topics: DataFrame) -> DataFrame:
    """The questions with ``topics``: those of the distinct topics (topic) they mention.

    A scan looks for ``TOPICS_PER_SCAN`` topics, about; only that many are ever on the driver.
    """
    body = F.lower(F.concat("title", F.lit(" "), "problem_statement", F.lit(" "), F.to_json("tags")))
    parts = max(1, -(-topics.count() // TOPICS_PER_SCAN))
    part = F.pmod(F.xxhash64("topic"), F.lit(parts))
    lists = [[r["topic"] for r in topics.filter(part == k).collect()] for k in range(parts)]
    found = [mentioned(body, some) for some in lists if some]
    every = F.concat(*found) if found else F.array().cast("array<string>")
    return questions.withColumn("topics", every)


def top_references_batch(
    questions: DataFrame, sources: DataFrame, requests: list[Request] | DataFrame, n: int = S.MAX_REFERENCES
) -> DataFrame:
    """K8 for a list or a table (request_no, question_type, difficulty, topic) of requests.

    One scan of the corpus scores, clips and writes its questions once.  A score
    is 0, 2, 4 or 6, so the first ``n`` of a request are among the first ``n`` by
    title of four groups: its type, its type and difficulty, the mentions of its
    topic in its type, and those of its difficulty.  Each group is ranked once,
    whatever the number of requests; equal requests share one choice.  Requests
    without a type, difficulty or topic have none.
    """
    spark = questions.sparkSession
    table = request_frame(spark, requests) if isinstance(requests, list) else requests
    columns = ["request_no", "question_type", "difficulty", "topic"]
    asked = staged(table.select(*columns).withColumn("_topic", F.lower("topic")))
    wanted = ["question_type", "difficulty", "topic", "_topic"]
    keys = asked.select(*wanted).distinct().withColumnRenamed("difficulty", "wanted")
    looked_for = asked.filter(F.col("topic") != S.ANY_TOPIC).select(F.col("_topic").alias("topic")).distinct()
    typed = questions.join(keys.select("question_type").distinct(), "question_type", "left_semi")
    scanned = _candidates(_with_topics(typed, looked_for), F.col("question_type"), F.col("topics"))
    corpus = staged(_with_source(scanned, sources))
    narrow = corpus.select("question_id", "sort_title", "question_type", "difficulty", "topics")
    hits = narrow.withColumn("_topic", F.explode("topics")).drop("topics")
    narrow = narrow.drop("topics")
    order = [F.col("sort_title").asc_nulls_last(), F.col("question_id")]
    found = None
    for rows, group, mention in (
        (narrow, ["question_type"], False),
        (narrow, ["question_type", "difficulty"], False),
        (hits, ["question_type", "_topic"], True),
        (hits, ["question_type", "difficulty", "_topic"], True),
    ):
        first = top_per_key(rows, group, order, n, "_n").drop("_n")
        named = [c for c in first.columns if c not in group or c == "difficulty"]
        right = first.select(*[F.col(c).alias(f"_r_{c}") for c in group], *[F.col(c).alias(f"_c_{c}") for c in named])
        own = {"difficulty": "wanted"}
        same = [keys[own.get(c, c)] == F.col(f"_r_{c}") for c in group]
        asks = keys.filter(F.col("topic") != S.ANY_TOPIC) if mention else keys
        met = asks.join(right, same).select(
            *keys.columns, *[F.col(f"_c_{c}").alias(c) for c in ("question_id", "sort_title", "difficulty")], F.lit(mention).alias("mention")
        )
        found = met if found is None else found.unionByName(met)
    # a mention that is not among the first of its group cannot be among the first of the request
    key = ["question_type", "wanted", "topic"]
    single = found.groupBy(*key, "question_id", "sort_title", "difficulty").agg(F.max("mention").alias("mention"))
    near = F.when(F.col("difficulty") == F.col("wanted"), 2).otherwise(0)
    scored = single.withColumn("score", near + F.when(F.col("mention"), 4).otherwise(0))
    chosen = top_per_key(scored, key, _relevance_order(), n, "place").select(*key, "question_id", "score", "place")
    shown = corpus.drop("source_id", "question_type", "topics")
    told = chosen.join(shown, "question_id")
    some = asked.select("request_no", "question_type", F.col("difficulty").alias("wanted"), "topic")
    return spread_join(some.dropna(subset=key), told, key, F.col("request_no")).drop(*key)


def request_frame(spark, requests: list[Request]) -> DataFrame:
    rows = [(no, *astuple(r)) for no, r in enumerate(requests, 1)]
    return spark.createDataFrame(
        rows, "request_no int, question_type string, difficulty string, topic string"
    )


def with_first_assets(references: DataFrame, assets: DataFrame, solutions: DataFrame) -> DataFrame:
    """First schema asset and first SQL solution of each reference.

    References are few, so the semi-join cuts assets and solutions before they
    are grouped.
    """
    chosen = references.select("question_id").distinct()
    schema = assets.filter(F.col("asset_type") == "schema").join(chosen, "question_id", "left_semi")
    sql = solutions.filter(F.col("method") == "sql").join(chosen, "question_id", "left_semi")
    first_schema = first_value(schema, ["question_id"], clip_ellipsis(F.col("content"), 400), "schema_sql")
    first_code = first_value(sql, ["question_id"], clip_ellipsis(F.col("code"), 300), "reference_solution")
    return (
        references.join(first_schema, "question_id", "left")
        .join(first_code, "question_id", "left")
        .withColumn("schema_sql", F.coalesce("schema_sql", F.lit("")))
        .withColumn("reference_solution", F.coalesce("reference_solution", F.lit("")))
    )


def public_reference() -> tuple[Column, Column]:
    """The JSON object a prompt shows, and its length when spaced as ``{"a": 1, "b": 2}``.

    Catalog keys stay out, empty members are dropped.
    """
    tags = F.when(F.size("tags") > 0, F.col("tags"))
    members = {
        "title": non_empty(F.col("title")),
        "difficulty": non_empty(F.col("difficulty")),
        "problem_statement": non_empty(F.col("problem_statement")),
        "tags": tags,
        "schema_sql": non_empty(F.col("schema_sql")),
        "reference_solution": non_empty(F.col("reference_solution")),
    }
    text = F.to_json(F.struct(*[c.alias(name) for name, c in members.items()]))
    filled = sum((c.isNotNull().cast("int") for c in members.values()), F.lit(0))
    # One blank after each colon, one after each comma between members and tags.
    blanks = filled + F.greatest(filled - 1, F.lit(0)) + F.coalesce(F.size(tags) - 1, F.lit(0))
    return text, F.length(text) + blanks


def pack_references(
    references: DataFrame, budget: int = S.MAX_CONTEXT_CHARS, n: int = S.MAX_REFERENCES
) -> DataFrame:
    """Keep references in order while the serialised list fits the budget.

    ``references`` holds at most ``n`` rows per request (``place`` from 1), so
    the running length is a window over at most ``n`` rows.
    """
    text, chars = public_reference()
    per_request = Window.partitionBy("request_no").orderBy("place")
    ranked = references.filter(F.col("place") <= n).select(
        "request_no", "place", "question_id", text.alias("reference"), chars.alias("chars")
    )
    running = F.sum("chars").over(per_request) + 2 * (F.col("place") - 1) + 2
    return ranked.withColumn("running_chars", running).filter(F.col("running_chars") <= budget)


def packed_context(packed: DataFrame) -> DataFrame:
    """One context document per request, from its at most three references."""
    listed = F.array_sort(F.collect_list(F.struct("place", "reference")))
    return packed.groupBy("request_no").agg(
        F.count("*").alias("references"),
        F.concat(F.lit("["), F.array_join(listed["reference"], ", "), F.lit("]")).alias("context"),
    )


def context_documents(
    questions: DataFrame,
    sources: DataFrame,
    assets: DataFrame,
    solutions: DataFrame,
    requests: list[Request] | DataFrame,
    budget: int = S.MAX_CONTEXT_CHARS,
) -> DataFrame:
    """The context document of every request.

    The references, three rows per request, are written once: choosing them
    takes a scan of the whole corpus.
    """
    references = staged(top_references_batch(questions, sources, requests))
    return packed_context(pack_references(with_first_assets(references, assets, solutions), budget))


def needs_research(requests: DataFrame, references: DataFrame) -> DataFrame:
    """Requests whose topic no local reference mentions, or with under three.

    ``references`` holds at most three rows per request.
    """
    names = [c for c in references.columns if c not in ("request_no", "score", "place", "sort_title")]
    shown = F.lower(F.to_json(F.struct(*names)))
    per_request = references.select("request_no", shown.alias("shown"))
    joined = requests.join(per_request, "request_no", "left")
    mentioned = F.contains(F.col("shown"), F.lower("topic"))
    return (
        joined.groupBy("request_no", "topic")
        .agg(
            F.count("shown").alias("local_references"),
            F.coalesce(F.max(mentioned), F.lit(False)).alias("topic_found"),
        )
        .withColumn("few_references", F.col("local_references") < S.MAX_REFERENCES)
        .withColumn("topic_missing", (F.col("topic") != S.ANY_TOPIC) & ~F.col("topic_found"))
    )


def all_references(local: DataFrame, web: DataFrame) -> DataFrame:
    """U8: local and web references as one bag."""
    return local.unionByName(web, allowMissingColumns=True)


def provenance(references: DataFrame) -> DataFrame:
    """Context sources of each request, empty keys left out."""
    source = F.struct(
        non_empty(F.col("question_id").cast("string")).alias("question_id"),
        non_empty(F.col("dataset_name")).alias("dataset_name"),
        non_empty(F.col("source_url")).alias("source_url"),
    )
    listed = F.array_sort(F.collect_list(F.struct("place", F.to_json(source).alias("source"))))
    return references.groupBy("request_no").agg(
        F.concat(F.lit("["), F.array_join(listed["source"], ","), F.lit("]")).alias("context_sources")
    )


def review_context(
    submissions: DataFrame, questions: DataFrame, solutions: DataFrame, assets: DataFrame, cases: DataFrame
) -> DataFrame:
    """Everything a reviewer sees for a submission, each part capped.

    The context is built once per (question, method) and meets the submissions
    after that: a question with very many submissions costs no more than any other
    until then.  The question's own texts, the largest part, come in the last join,
    so that they are shuffled once per question and not once per method and join.
    """
    pair = ["question_id", "method"]
    asked = submissions.select(*pair).distinct()
    code = clip_marked(F.col("code"), 12_000)
    solution = first_value(solutions, pair, code, "reference_solution")

    # Ten of the shared assets and ten of each method's own hold every choice.
    required = F.col("asset_type").isin(*S.REQUIRED_ANALYSIS_ASSETS)
    owned = assets.filter(required).select(
        "question_id",
        "id",
        "asset_type",
        F.col("method").alias("asset_method"),
        F.coalesce(F.nullif(F.col("method"), F.lit("shared")), F.lit("")).alias("_owner"),
        clip_marked(F.col("content"), 4_000).alias("content"),
    )
    leading = top_per_key(owned, ["question_id", "_owner"], ["id"], 10, "_n")
    usable = leading.join(asked, "question_id").filter(
        relevant_asset(F.col("method"), F.col("asset_method"))
    )
    ten_assets = top_per_key(usable, pair, ["id"], 10, "place")
    asset = F.struct(
        "place",
        F.col("asset_type").alias("type"),
        F.col("asset_method").alias("method"),
        "content",
    )
    asset_lists = ten_assets.groupBy(*pair).agg(
        F.array_sort(F.collect_list(asset)).alias("assets")
    )

    ten_cases = top_per_key(cases, ["question_id"], ["id"], 10, "place")
    case = F.struct("place", F.col("input_data").alias("input"), "expected_output")
    case_lists = ten_cases.groupBy("question_id").agg(
        F.array_sort(F.collect_list(case)).alias("cases")
    )

    shown = F.struct(
        "title",
        "question_type",
        "difficulty",
        clip_marked(F.coalesce("problem_statement", F.lit("")), 6_000).alias("problem_statement"),
        clip_marked(F.coalesce("constraints", F.lit("")), 3_000).alias("constraints"),
        F.coalesce(optional(questions, "examples"), F.lit("[]")).alias("examples"),
        "tags",
    )
    question = questions.select(F.col("id").alias("question_id"), shown.alias("question"))
    context = (
        asked.join(case_lists, "question_id", "left")
        .join(solution, pair, "left")
        .join(asset_lists, pair, "left")
    )
    found = spread_join(submissions, context, pair, F.col("submission_id"))
    shown_first = [*pair, *[c for c in submissions.columns if c not in pair], "question"]
    return found.join(question.hint("merge"), "question_id").select(
        *shown_first, "cases", "reference_solution", "assets"
    )


def teaching_context(
    questions: DataFrame, assets: DataFrame, cases: DataFrame, solutions: DataFrame
) -> DataFrame:
    """Last asset per type, first 20 cases, first 12 solutions of a question."""
    last = F.max_by(clip(F.col("content"), 20_000), "id").alias("content")
    per_type = assets.groupBy("question_id", "asset_type").agg(last)
    asset_maps = per_type.groupBy("question_id").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("asset_type", "content")))
        ).alias("assets")
    )

    def capped(rows: DataFrame, n: int, entry: Column, name: str) -> DataFrame:
        first = top_per_key(rows, ["question_id"], ["id"], n, "place")
        return first.groupBy("question_id").agg(F.array_sort(F.collect_list(entry)).alias(name))

    case = F.struct(
        "place", F.col("input_data").alias("input"), F.col("expected_output").alias("expected")
    )
    bounded_code = solutions.withColumn("code", clip(F.col("code"), 12_000))
    case_lists = capped(cases, 20, case, "test_cases")
    solution_lists = capped(bounded_code, 12, F.struct("place", "method", "code"), "stored_references")
    bounded = bounded_question(questions)
    return (
        bounded.join(asset_maps, "question_id", "left")
        .join(case_lists, "question_id", "left")
        .join(solution_lists, "question_id", "left")
    )


def optional(df: DataFrame, column: str) -> Column:
    """A text column that older tables lack."""
    return F.col(column).cast("string") if column in df.columns else F.lit(None).cast("string")


def bounded_question(questions: DataFrame, limit: int = S.MAX_BOUNDED_CHARS) -> DataFrame:
    """Texts bounded to ``limit``, list entries to half of it, 20 per list;
    ``examples`` and ``expected_output_format`` to any depth."""
    return questions.select(
        F.col("id").alias("question_id"),
        clip(F.col("title"), limit).alias("title"),
        clip(F.col("question_type"), limit).alias("question_type"),
        clip(F.col("difficulty"), limit).alias("difficulty"),
        F.transform(F.slice("tags", 1, S.MAX_BOUNDED_ITEMS), lambda t: clip(t, limit // 2)).alias("tags"),
        clip(F.col("problem_statement"), limit).alias("problem_statement"),
        bounded_json(optional(questions, "examples"), limit).alias("examples"),
        clip(F.col("constraints"), limit).alias("constraints"),
        bounded_json(optional(questions, "expected_output_format"), limit).alias("expected_output_format"),
    )


def choice_contexts(items: DataFrame, questions: DataFrame, block: Column | None = None) -> DataFrame:
    """The choice items of each quiz as documents of at most ten items.

    A quiz of the settings' size gives one document; a larger group gives as
    many as it needs, so that none is gathered whole.
    """
    choice = items.filter(F.col("answer_format") == "mcq")
    shown = questions.select(
        F.col("id").alias("question_id"),
        "title",
        clip(F.col("problem_statement"), 8_000).alias("problem_statement"),
        clip(F.coalesce("constraints", F.lit("")), 3_000).alias("constraints"),
    )
    order_block = F.floor(F.col("position") / 4096) if block is None else block
    numbered = number_rows(choice, ["quiz_id"], ["position", "question_id"], order_block, "choice_no")
    joined = numbered.join(shown, "question_id").withColumn(
        "document_no", F.floor((F.col("choice_no") - 1) / S.MAX_QUIZ_ITEMS)
    )
    entry = F.struct("choice_no", "question_id", "title", "problem_statement", "constraints", "method")
    return joined.groupBy("quiz_id", "document_no").agg(
        F.count("*").alias("items"), F.array_sort(F.collect_list(entry)).alias("contexts")
    )


def clean_references(rows: Column) -> Column:
    """Usable web rows: http(s) address, bounded title and excerpt, at most five.

    The cap comes first, as the search itself returns at most five rows.
    """
    def member(row: Column, *names: str) -> Column:
        return F.coalesce(strip(first_filled(*[as_text(field(row, n)) for n in names])), F.lit(""))

    def cleaned(row: Column) -> Column:
        url = member(row, "url")
        return F.struct(
            clip(strip(F.coalesce(non_empty(as_text(field(row, "title"))), url)), 300).alias("title"),
            url.alias("url"),
            clip(member(row, "description", "markdown", "content"), 6_000).alias("excerpt"),
        )

    first_five = F.slice(rows, 1, 5)
    return F.filter(F.transform(first_five, cleaned), lambda r: r["url"].rlike("^https?://"))
