"""Registered queries: batch validation and data quality.

Payload texts are built from the rows of a table; the size class of a part, or
the nation of a customer, says which rule its payload breaks, so that every
violation occurs in proportion to the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from drillmark import schemas as S
from drillmark.functions.payload import unfence, unfence_json
from drillmark.operators.barrier import dealt, staged
from drillmark.plans import bindings as B
from drillmark.plans import validation as V
from drillmark.plans.registry import query
from drillmark.sources import sinks


def _counts(spark, sf_dir, name, text, check, unwrap=unfence_json):
    return _counts_of(B.table(spark, sf_dir, name), text, check, unwrap)


def _counts_of(rows, text, check, unwrap=unfence_json):
    return V.violation_counts(V.checked(rows.withColumn("reply", text), "reply", check, unwrap))


def _words(*values):
    return F.array(*[F.lit(v) for v in values])


def _methods(code, skip=None):
    return F.struct(*[code.alias(m) for m in S.DATA_ANALYSIS_METHODS if m != skip])


def _truncated(text):
    return F.substring(text, 1, 40)


# --- Generated questions -----------------------------------------------------


def _size_class():
    """0 to 8 for sizes 1 to 50; classes 0 and 8 break no rule."""
    return F.floor((F.col("p_size") - 1) / 6)


def _algorithm_reply():
    case = _size_class()
    sample = F.struct(F.col("p_size").alias("input"), F.col("p_name").alias("output"))
    test = F.struct(F.col("p_size").alias("input"), F.col("p_name").alias("expected_output"))
    half_test = F.struct(F.col("p_size").alias("input"), F.lit(None).cast("string").alias("expected_output"))
    text = F.to_json(
        F.struct(
            F.lit("algorithm").alias("question_type"),
            F.when(case != 1, F.col("p_name")).alias("title"),
            F.col("p_name").alias("problem_statement"),
            F.when(case == 4, F.slice(F.array(sample), 1, 0)).otherwise(F.array(sample)).alias("examples"),
            F.lit("none").alias("constraints"),
            F.when(case == 3, "Easy").otherwise("Medium").alias("difficulty"),
            F.when(case == 6, _words(" ")).otherwise(F.split("p_name", " ")).alias("tags"),
            F.lit("def f(): pass").alias("starter_code"),
            F.when(case == 5, F.array(half_test)).otherwise(F.array(test, test)).alias("test_cases"),
            F.when(F.col("p_size") > 10, F.col("p_name")).alias("reference_solution"),
            F.when(case == 2, F.lit(1)).alias("extra"),
        )
    )
    fenced = F.concat(F.lit("```json\n"), text, F.lit("\n```"))
    return F.when(case == 7, _truncated(text)).when(case == 8, fenced).otherwise(text)


def _check_algorithm(value):
    return V.algorithm_question(value, F.lit("Medium"))


@query(
    """
    SELECT v AS violation, count(*) AS n FROM (
      SELECT unnest(CASE (p_size - 1) // 6 WHEN 1 THEN ['members', 'title'] WHEN 2 THEN ['members']
             WHEN 3 THEN ['difficulty'] WHEN 4 THEN ['examples'] WHEN 5 THEN ['test_cases']
             WHEN 6 THEN ['tags'] WHEN 7 THEN ['malformed_json'] ELSE [] END) AS v FROM part)
    GROUP BY v
    """
)
def algorithm_payloads(spark, sf_dir):
    return _counts(spark, sf_dir, "part", _algorithm_reply(), _check_algorithm, unfence)


def _analysis_reply():
    case = _size_class()
    row = F.struct(F.col("p_size").alias("size"), F.col("p_name").alias("name"))
    rows = F.to_json(F.array(row, row))
    uneven = F.concat(F.lit("["), F.to_json(row), F.lit(',{"size":1}]'))
    nested = F.lit('[{"size":[1],"name":"x"}]')
    table = F.when(case == 1, "CREATE VIEW items (size INT)").otherwise("CREATE TABLE items (size INT)")
    fixture = F.when(case == 2, uneven).when(case == 3, nested).otherwise(rows)
    methods = F.when(case == 4, _words("sql", "pandas", "pyspark")).otherwise(
        _words("polars", "sql", "pandas", "pyspark")
    )
    starter = F.when(case == 5, F.to_json(_methods(F.lit("code"), "polars"))).otherwise(
        F.to_json(_methods(F.lit("code")))
    )
    solved = F.to_json(_methods(F.when(case == 6, " ").otherwise("code")))
    head = F.to_json(
        F.struct(
            F.lit("data_analysis").alias("question_type"),
            F.col("p_name").alias("title"),
            F.col("p_name").alias("problem_statement"),
            F.lit("Medium").alias("difficulty"),
            F.split("p_name", " ").alias("tags"),
            table.alias("schema_sql"),
            F.when(case == 7, "others").otherwise("Items").alias("table_name"),
            methods.alias("supported_methods"),
        )
    )
    return F.concat(
        
        head.substr(F.lit(1), F.length(head) - 1),
        F.lit(',"fixture_data":'),
        fixture,
        F.lit(',"expected_result":'),
        rows,
        F.lit(',"starter_code":'),
        starter,
        F.lit(',"reference_solutions":'),
        solved,
        F.lit("}"),
    )


def _check_analysis(value):
    return V.analysis_question(value, F.lit("Medium"))


@query(
    """
    SELECT v AS violation, count(*) AS n FROM (
      SELECT unnest(CASE (p_size - 1) // 6 WHEN 1 THEN ['create_table'] WHEN 2 THEN ['fixture_data']
             WHEN 3 THEN ['fixture_data'] WHEN 4 THEN ['supported_methods']
             WHEN 5 THEN ['starter_code'] WHEN 6 THEN ['reference_solutions']
             WHEN 7 THEN ['table_in_schema'] ELSE [] END) AS v FROM part)
    GROUP BY v
    """
)
def analysis_payloads(spark, sf_dir):
    return _counts(spark, sf_dir, "part", _analysis_reply(), _check_analysis, unfence)


@query(
    """
    WITH q AS (SELECT *, p_type IN ('STANDARD', 'ECONOMY', 'PROMO') AS algorithm FROM part
               WHERE (p_size - 1) // 6 IN (0, 8))
    SELECT 'ai_generated_questions' AS "table", count(*) AS n FROM q
    UNION ALL SELECT 'question_assets', sum(CASE WHEN algorithm THEN 1 ELSE 7 END) FROM q
    UNION ALL SELECT 'question_test_cases', 2 * count(CASE WHEN algorithm THEN 1 END) FROM q
    UNION ALL SELECT 'questions', count(*) FROM q
    UNION ALL SELECT 'reference_solutions',
      sum(CASE WHEN NOT algorithm THEN 4 WHEN p_size > 10 THEN 1 ELSE 0 END) FROM q
    """
)
def generated_tables(spark, sf_dir):
    is_algorithm = F.col("p_type").isin(*B.ALGORITHM_TYPES)

    def sound(kind, method, wanted, reply, check):
        replies = B.table(spark, sf_dir, "part").filter(wanted).select(
            F.col("p_partkey").cast("string").alias("question_id"),
            F.lit(kind).alias("question_type"),
            F.lit(method).alias("method"),
            F.lit("p").alias("provider"),
            F.lit("m").alias("model_id"),
            F.lit("v1").alias("prompt_version"),
            F.lit("{}").alias("generation_metadata"),
            reply.alias("reply"),
        )
        return V.accepted(V.checked(replies, "reply", check))

    accepted = sound(
        "algorithm", "java", is_algorithm, _algorithm_reply(), _check_algorithm
    ).unionByName(sound("data_analysis", "sql", ~is_algorithm, _analysis_reply(), _check_analysis))
    accepted = staged(accepted).withColumn("reply", V.parse_strict(unfence(F.col("reply"))))
    counts = [
        df.agg(F.count("*").alias("n")).withColumn("table", F.lit(name))
        for name, df in sinks.generated_question_tables(accepted).items()
    ]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


# --- Choice sets -------------------------------------------------------------


def _choice(question_id, case):
    def option(name, text):
        return F.struct(F.lit(name).alias("id"), text.alias("text"))

    first = F.col("c_name")
    options = F.array(
        option("a", first),
        option("b", F.lit("two")),
        option("c", F.lit("three")),
        option("d", F.when(case == 6, F.upper(first)).otherwise("four")),
    )
    return F.struct(
        question_id.alias("question_id"),
        first.alias("prompt"),
        F.when(case == 5, F.slice(options, 1, 3)).otherwise(options).alias("options"),
        F.when(case == 7, "z").otherwise("a").alias("correct_option_id"),
        F.lit("because").alias("explanation"),
    )


@query(
    """
    SELECT c_custkey AS quiz_id,
           CASE WHEN c IN (2, 3, 4) THEN 1 ELSE 0 END AS missing,
           CASE WHEN c = 3 THEN 1 ELSE 0 END AS unexpected,
           CASE WHEN c = 4 THEN 1 ELSE 0 END AS repeated,
           CASE WHEN c IN (5, 6, 7) THEN 2 ELSE 0 END AS broken,
           CASE c WHEN 1 THEN 'status' WHEN 2 THEN 'missing' WHEN 3 THEN 'missing,unexpected'
                WHEN 4 THEN 'missing,repeated' WHEN 0 THEN '' WHEN 8 THEN '' ELSE 'broken' END
             AS violations
    FROM (SELECT *, c_nationkey // 3 AS c FROM customer)
    """
)
def choice_set_verdicts(spark, sf_dir):
    case = F.floor(F.col("c_nationkey") / 3)
    key = F.col("c_custkey").cast("string")
    first, second = F.concat(key, F.lit("-1")), F.concat(key, F.lit("-2"))
    other = F.when(case == 3, F.lit("elsewhere")).when(case == 4, first).otherwise(second)
    both = F.array(_choice(first, case), _choice(other, case))
    customers = B.table(spark, sf_dir, "customer")
    # the narrow rows of a small file are dealt before replies are written and read
    replies = dealt(customers.select("c_custkey", "c_name", "c_nationkey")).select(
        F.col("c_custkey").alias("quiz_id"),
        F.to_json(
            F.struct(
                F.when(case == 1, "bad").otherwise("ok").alias("status"),
                F.when(case == 2, F.slice(both, 1, 1)).otherwise(both).alias("questions"),
            )
        ).alias("reply"),
    )
    expected = customers.select(
        F.col("c_custkey").alias("quiz_id"), F.explode(F.array(first, second)).alias("question_id")
    )
    verdicts = V.choice_sets(replies, expected)
    return verdicts.withColumn("violations", F.array_join("violations", ","))


# --- Interview items, assessments, solutions, scores -------------------------


@query(
    """
    SELECT v AS violation, count(*) AS n FROM (
      SELECT unnest(list_concat(
        CASE WHEN lang = 'de' THEN ['difficulty'] ELSE [] END,
        CASE WHEN lang = 'fr' THEN ['rubric'] ELSE [] END,
        CASE WHEN lang = 'es' AND source <> 'src1' THEN ['method'] ELSE [] END,
        CASE WHEN lang = 'en' AND n_chars < 1000 THEN ['options'] ELSE [] END)) AS v FROM documents)
    GROUP BY v
    """
)
def item_payloads(spark, sf_dir):
    lang = F.col("lang")
    fmt = F.when(lang == "es", "coding").when(lang == "en", "mcq").otherwise("theory")
    four = F.transform(
        _words("a", "b", "c", "d"), lambda i: F.struct(i.alias("id"), F.concat(i, i).alias("text"))
    )
    head = F.to_json(
        F.struct(
            lang.alias("domain"),
            F.col("source").alias("topic"),
            fmt.alias("answer_format"),
            F.lit("direct").alias("prompt_style"),
            F.when(lang == "de", "Hard").otherwise("Medium").alias("difficulty"),
            F.col("text").alias("prompt"),
            F.col("source").alias("reference_answer"),
            F.when(lang == "fr", F.slice(F.array("source"), 1, 0))
            .otherwise(F.array("source"))
            .alias("rubric"),
            F.when(F.col("n_chars") < 1000, F.slice(four, 1, 3)).otherwise(four).alias("options"),
            F.lit("b").alias("correct_option"),
            F.array("source").alias("tags"),
        )
    )
    method = F.when(F.col("source") == "src1", F.lit('"sql"')).otherwise("null")
    reply = F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"method":'), method, F.lit("}"))

    def check(value):
        return V.interview_item(value, F.lit("Medium"), fmt, F.lit("direct"))

    return _counts(spark, sf_dir, "documents", reply, check)


@query(
    """
    SELECT v AS violation, count(*) AS n FROM (
      SELECT unnest(list_concat(
        CASE WHEN l_quantity * 4 > 100 OR l_returnflag = 'N' THEN ['percent'] ELSE [] END,
        CASE WHEN l_linenumber * 3 > 20 THEN ['mistakes'] ELSE [] END,
        CASE WHEN l_tax = 0 THEN ['explanation'] ELSE [] END,
        CASE WHEN l_discount = 0 THEN ['suggestion'] ELSE [] END,
        CASE WHEN l_linestatus = 'O' AND l_discount > 0.05 THEN ['members'] ELSE [] END)) AS v
      FROM lineitem) GROUP BY v
    """
)
def assessment_payloads(spark, sf_dir):
    mistakes = F.array_repeat(F.col("l_returnflag"), (F.col("l_linenumber") * 3).cast("int"))
    head = F.to_json(
        F.struct(
            mistakes.alias("identified_mistakes"),
            F.when(F.col("l_tax") == 0, " \n").otherwise("wrong bound").alias("explanation"),
            F.when(F.col("l_discount") == 0, F.repeat(F.lit("x"), 4001))
            .otherwise("")
            .alias("suggested_correction"),
            F.when((F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.05), 1).alias("extra"),
        )
    )
    percent = F.when(F.col("l_returnflag") == "N", F.lit("true")).otherwise(
        (F.col("l_quantity") * 4).cast("string")
    )
    reply = F.concat(
        head.substr(F.lit(1), F.length(head) - 1),
        F.lit(',"corrected_code":null,"estimated_percentage_correct":'),
        percent,
        F.lit("}"),
    )
    lines = B.table(spark, sf_dir, "lineitem")
    # the narrow rows of a file of few row groups are dealt before replies are written and read
    rows = dealt(lines.select("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))
    return _counts_of(rows, reply, V.assessment)


@query(
    """
    SELECT v AS violation, count(*) AS n FROM (
      SELECT unnest(CASE WHEN p_type = 'SMALL' THEN ['count']
        WHEN p_type = 'LARGE' THEN ['comments'] WHEN p_type = 'PROMO' THEN ['titles']
        WHEN p_type = 'MEDIUM' THEN ['meaningful'] WHEN p_type = 'ECONOMY' THEN ['solutions']
        ELSE [] END) AS v FROM part) GROUP BY v
    """
)
def teaching_payloads(spark, sf_dir):
    kind = F.col("p_type")
    token = F.when(kind == "LARGE", "").otherwise("// note ")

    def solution(title):
        return F.struct(
            title.alias("title"),
            F.concat(token, F.col("p_name")).alias("code"),
            F.when(kind == "ECONOMY", F.repeat(F.lit("y"), 4001)).otherwise("text").alias("explanation"),
            F.lit("theory").alias("theory"),
            F.lit("O(n)").alias("complexity"),
        )

    first = solution(F.col("p_name"))
    second = solution(F.when(kind == "PROMO", F.upper("p_name")).otherwise(F.col("p_brand")))
    both = F.array(first, second)
    solutions = F.when(kind == "SMALL", F.slice(both, 1, 0)).otherwise(both)
    head = F.to_json(
        F.struct(
            F.when(kind == "MEDIUM", "yes").alias("multiple_approaches_meaningful"),
            solutions.alias("solutions"),
        )
    )
    flag = F.when(kind == "MEDIUM", "").otherwise(',"multiple_approaches_meaningful":true')
    reply = F.concat(
        head.substr(F.lit(1), F.length(head) - 1), flag, F.lit(',"availability_note":null}')
    )

    def check(value):
        return V.teaching_solutions(value, F.lit("java"), F.lit("algorithm"))

    return _counts(spark, sf_dir, "part", reply, check)


@query(
    """
    SELECT "check", v AS violation, count(*) AS n FROM (
      SELECT 'score' AS "check", unnest(list_concat(
        CASE WHEN o_totalprice > 500000 * 0.9 THEN ['score'] ELSE [] END,
        CASE WHEN o_orderstatus = 'P' THEN ['feedback'] ELSE [] END)) AS v FROM orders
      UNION ALL SELECT 'plan', unnest(list_concat(
        CASE WHEN o_orderstatus = 'O' THEN ['topics'] ELSE [] END,
        CASE WHEN o_orderpriority = '5-LOW' THEN ['formats'] ELSE [] END)) FROM orders
      UNION ALL SELECT 'report', unnest(list_concat(
        CASE WHEN o_totalprice > 500000 * 0.9 THEN ['overall_score'] ELSE [] END,
        CASE WHEN o_orderstatus = 'F' THEN ['lists'] ELSE [] END)) FROM orders)
    GROUP BY "check", v
    """
)
def session_payloads(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders")
    score = F.when(F.col("o_totalprice") > 450000, 101).otherwise(50)
    status, one = F.col("o_orderstatus"), F.array("o_orderpriority")
    empty = F.slice(one, 1, 0)
    replies = {
        "score": (
            F.struct(score.alias("score"), F.when(status != "P", "fine").alias("feedback")),
            V.answer_score,
        ),
        "plan": (
            F.struct(
                F.when(status == "O", empty).otherwise(one).alias("topics"),
                F.when(F.col("o_orderpriority") == "5-LOW", one)
                .otherwise(_words("theory", "mcq"))
                .alias("formats"),
                empty.alias("languages"),
            ),
            V.interview_plan,
        ),
        "report": (
            F.struct(
                score.alias("overall_score"),
                F.lit("done").alias("summary"),
                one.alias("strengths"),
                one.alias("gaps"),
                F.when(status != "F", one).alias("recommendations"),
            ),
            V.final_report,
        ),
    }
    out = None
    for name, (reply, check) in replies.items():
        checked = V.checked(orders.withColumn("reply", F.to_json(reply)), "reply", check, unfence_json)
        counts = V.violation_counts(checked).withColumn("check", F.lit(name))
        out = counts if out is None else out.unionByName(counts)
    return out


# --- Submissions, settings, tables -------------------------------------------


@query(
    """
    SELECT lang, count(*) AS n, count(CASE WHEN length(text) > 12000 THEN 1 END) AS too_long,
           count(CASE WHEN lang IN ('de', 'es') THEN 1 END) AS unsupported,
           count(CASE WHEN length(text) <= 12000 AND lang NOT IN ('de', 'es') THEN 1 END) AS accepted
    FROM documents GROUP BY lang
    """
)
def submission_checks(spark, sf_dir):
    supported = _words("en", "fr")
    checked = B.table(spark, sf_dir, "documents").select(
        "lang", V.submission(F.col("text"), F.col("lang"), supported).alias("violations")
    )
    return checked.groupBy("lang").agg(
        F.count("*").alias("n"),
        F.count_if(F.array_contains("violations", "too_long")).alias("too_long"),
        F.count_if(F.array_contains("violations", "unsupported_method")).alias("unsupported"),
        F.count_if(F.size("violations") == 0).alias("accepted"),
    )


@query(
    """
    SELECT c_custkey AS request_id,
           concat_ws(',', CASE WHEN c_nationkey NOT BETWEEN 1 AND 10 THEN 'total_items' END,
                     CASE WHEN floor(c_acctbal / 1000) NOT BETWEEN 0 AND c_nationkey
                          THEN 'coding_items' END) AS violations
    FROM customer
    """
)
def quiz_setting_checks(spark, sf_dir):
    found = V.quiz_settings(F.col("c_nationkey"), F.floor(F.col("c_acctbal") / 1000))
    return B.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"), F.array_join(found, ",").alias("violations")
    )


@query(
    """
    SELECT p_partkey AS request_id,
           concat_ws(',', CASE WHEN p_type = 'SMALL' THEN 'question_type' END,
                     CASE WHEN p_size > 40 THEN 'difficulty' END,
                     CASE WHEN p_type NOT IN ('LARGE', 'PROMO') THEN 'method' END) AS violations,
           p_name AS topic
    FROM part
    """
)
def generation_request_checks(spark, sf_dir):
    from drillmark.functions.text import topic_or_any

    kind = (
        F.when(F.col("p_type") == "SMALL", "essay")
        .when(F.col("p_type") == "PROMO", "data_analysis")
        .otherwise("algorithm")
    )
    method = (
        F.when(F.col("p_type") == "PROMO", "polars").when(F.col("p_type") == "LARGE", "cpp").otherwise("sql")
    )
    level = F.when(F.col("p_size") > 40, "Extreme").otherwise("Hard")
    topic = topic_or_any(F.concat(F.lit("  "), F.col("p_name"), F.lit("\n")))
    found = V.generation_request(kind, level, method, topic)
    return B.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("request_id"),
        F.array_join(found, ",").alias("violations"),
        topic.alias("topic"),
    )


@query(
    """
    SELECT 'l_returnflag' AS rule, count(CASE WHEN l_returnflag NOT IN ('A', 'R') THEN 1 END)
      AS breaches FROM lineitem
    UNION ALL SELECT 'l_linestatus', count(CASE WHEN l_linestatus NOT IN ('F', 'O') THEN 1 END)
      FROM lineitem
    """
)
def dq_enums(spark, sf_dir):
    return V.enum_breaches(
        B.table(spark, sf_dir, "lineitem"), {"l_returnflag": ("A", "R"), "l_linestatus": ("F", "O")}
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    """
)
def dq_unique(spark, sf_dir):
    return V.duplicate_keys(B.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    """
    SELECT doc_id AS id, count(*) AS rows FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id
    """
)
def dq_orphans(spark, sf_dir):
    child = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return V.orphans(child, "id", B.table(spark, sf_dir, "labels"), "doc_id")


@query(
    """
    SELECT p_type AS question_type, count(*) AS n,
           count(CASE WHEN p_type IN ('STANDARD', 'ECONOMY', 'PROMO') AND p_size > 25 THEN 1 END)
             AS broken
    FROM part GROUP BY p_type
    """
)
def method_rule_checks(spark, sf_dir):
    kind = F.when(F.col("p_type").isin(*B.ALGORITHM_TYPES), "algorithm").otherwise("data_analysis")
    offered = (
        F.when(kind == "data_analysis", _words(*S.DATA_ANALYSIS_METHODS))
        .when(F.col("p_size") > 25, _words("python"))
        .otherwise(_words(*S.ALGORITHM_METHODS))
    )
    return (
        B.table(spark, sf_dir, "part")
        .groupBy(F.col("p_type").alias("question_type"))
        .agg(F.count("*").alias("n"), F.count_if(~V.method_rule(kind, offered)).alias("broken"))
    )
