"""Registered queries: raw records, normalisers, import outcomes.

Raw sources are derived from the driver's tables: JSON lines, JSON arrays,
typed rows and archives from documents, Markdown from pages.
"""

from __future__ import annotations

import io
import json
import tarfile

import pandas as pd
from pyspark.sql import functions as F

from drillmark.functions import text as X
from drillmark.functions.payload import decode
from drillmark.operators.barrier import staged
from drillmark.operators.ordered import first_per_key
from drillmark.operators.sections import numbered_lines
from drillmark.plans import bindings as B
from drillmark.plans.ingest import outcome_counts
from drillmark.plans.registry import query
from drillmark.sources import arrays, interviews, normalisers, sinks
from drillmark.sources.inspection import missing_fields
from drillmark.sources.readers import as_variant, manifest_of, parse_elements, parse_json_lines, source_manifest
from drillmark.sources.specs import PROMPT_CORPORA, allowed_only, choose, policy_frame

RUN = "run-1"


def _documents(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select(
        "*",
        F.lit("coding/documents.jsonl").alias("source_file"),
        F.col("doc_id").alias("record_index"),
        F.lit("r1").alias("source_revision"),
    )


def _lines(documents, **fields):
    """One JSON line per document; documents of one language are not JSON."""
    line = F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))
    broken = (F.col("lang") == "es") & (F.col("source") == "src3")
    return parse_json_lines(
        documents.select(
            "source_file",
            "record_index",
            "source_revision",
            F.when(broken, F.col("text")).otherwise(line).alias("value"),
        )
    )


def _usable(raw):
    return raw.filter(~F.col("rejected")).drop("rejected")


def _shape(normalised):
    """A flat view of normalised questions for the comparison."""
    return normalised.select(
        "source.source_key",
        "source.original_id",
        F.col("source.source_record_index").alias("record_index"),
        "title",
        "difficulty",
        F.length("problem_statement").alias("statement_chars"),
        F.array_join("tags", "|").alias("tags"),
        F.size("assets").alias("assets"),
        F.array_join(F.transform("solutions", lambda s: s["code"]), "|").alias("solutions"),
        F.array_join(
            F.transform(
                "test_cases", lambda c: F.concat(c["input_data"], F.lit("="), c["expected_output"])
            ),
            "|",
        ).alias("cases"),
        "is_complete",
    )


_NOT_BROKEN = "NOT (lang = 'es' AND source = 'src3')"


def _key(dataset: str, *parts: str) -> str:
    encoded = " || ', ' || ".join(f"to_json({p})::varchar" for p in parts)
    return f"sha256('[\"{dataset}\", ' || {encoded} || ']')"


# --- N1-N7 -------------------------------------------------------------------


def _coding_lines_a(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    case = F.struct(F.col("lang").alias("input"), F.col("n_chars").alias("output"))
    return _lines(
        documents,
        task_id=F.when(
            F.col("lang") != "de", F.concat_ws("-", F.lit("doc"), "source", F.col("doc_id").cast("string"))
        ),
        question_id=F.when(F.col("source") != "src5", F.col("doc_id")),
        problem_description=F.col("text"),
        difficulty=F.when(F.col("lang") == "en", "EASY").when(F.col("lang") == "fr", "extreme"),
        tags=F.array("source", "lang"),
        starter_code=F.when(F.col("lang") == "en", "def f(): pass").otherwise(""),
        completion=F.when(F.col("lang") != "fr", F.col("source")),
        input_output=F.array_repeat(case, F.least(F.col("n_chars") % 60, F.lit(55)).cast("int")),
    )


_A_ID = """CASE WHEN lang <> 'de' THEN concat_ws('-', 'doc', source, doc_id::varchar)
  WHEN source <> 'src5' THEN doc_id::varchar END"""


@query(
    f"""
    SELECT {_key('LeetCodeDataset', f"coalesce({_A_ID}, '')")} AS source_key,
           {_A_ID} AS original_id, doc_id AS record_index,
           CASE WHEN lang <> 'de' THEN 'Doc S' || source[2:] || ' ' || doc_id
                WHEN source <> 'src5' THEN doc_id::varchar ELSE '' END AS title,
           CASE lang WHEN 'en' THEN 'Easy' ELSE 'Medium' END AS difficulty,
           CASE WHEN {_A_ID} IS NULL THEN 0 ELSE length(text) END AS statement_chars,
           source || '|' || lang AS tags, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS assets,
           CASE WHEN lang <> 'fr' THEN source ELSE '' END AS solutions,
           rtrim(repeat('"' || lang || '"=' || n_chars || '|',
                        least(n_chars % 60, 55)::int), '|') AS cases,
           true AS is_complete
    FROM documents WHERE {_NOT_BROKEN}
    """
)
def normalise_coding_lines_a(spark, sf_dir):
    spec = choose(["leetcode"])[0]
    return _shape(normalisers.coding_lines_a(_usable(_coding_lines_a(spark, sf_dir)), spec, RUN))


_B_ID = "CASE WHEN lang = 'fr' THEN 'row:' || doc_id ELSE doc_id::varchar END"


@query(
    f"""
    SELECT {_key('apps', "'coding/documents.jsonl'", _B_ID)} AS source_key,
           CASE WHEN lang <> 'fr' THEN doc_id::varchar END AS original_id, doc_id AS record_index,
           CASE WHEN lang = 'en' THEN source ELSE 'APPS Problem ' || doc_id END AS title,
           CASE lang WHEN 'en' THEN 'Hard' WHEN 'de' THEN 'Easy' ELSE 'Medium' END AS difficulty,
           length(text) AS statement_chars, '' AS tags,
           CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS assets,
           CASE WHEN lang = 'de' THEN '' ELSE lang || '|' || source || '|fourth' END AS solutions,
           CASE WHEN lang = 'es' THEN '' ELSE '1="a"|2="b"' END AS cases, true AS is_complete
    FROM documents WHERE {_NOT_BROKEN}
    """
)
def normalise_coding_lines_b(spark, sf_dir):
    raw = _lines(
        _documents(spark, sf_dir),
        id=F.when(F.col("lang") != "fr", F.col("doc_id")),
        question=F.when(F.col("lang") != "de", F.col("text")).otherwise(""),
        problem=F.col("text"),
        name=F.when(F.col("lang") == "en", F.col("source")),
        difficulty=F.when(F.col("lang") == "en", "competition").when(
            F.col("lang") == "de", "Introductory"
        ),
        starter_code=F.when(F.col("lang") == "de", "x = 1"),
        solutions=F.when(F.col("lang") == "de", "[broken").otherwise(
            F.to_json(F.array(F.col("lang"), F.lit("  "), F.col("source"), F.lit("fourth")))
        ),
        input_output=F.when(F.col("lang") == "es", "[]").otherwise(
            F.lit('{"inputs": [1, 2, 3], "outputs": ["a", "b"]}')
        ),
    )
    spec = choose(["apps"])[0]
    return _shape(normalisers.coding_lines_b(_usable(raw), spec, RUN))


@query(
    f"""
    SELECT {_key('TACO', "CASE WHEN lang = 'de' THEN '' ELSE 'http://x/' || doc_id END")} AS source_key,
           CASE WHEN lang <> 'de' THEN 'http://x/' || doc_id END AS original_id,
           doc_id AS record_index,
           CASE WHEN lang = 'en' THEN source ELSE 'TACO Problem' END AS title,
           CASE lang WHEN 'en' THEN 'Very Hard' WHEN 'fr' THEN 'Beginner' ELSE 'Medium' END
             AS difficulty,
           CASE WHEN lang = 'de' THEN 0 ELSE length(text) END AS statement_chars,
           CASE lang WHEN 'es' THEN '' ELSE source || '|' || lang END AS tags,
           0 AS assets, 'print(1)' AS solutions, '[1, 2]=3' AS cases, true AS is_complete
    FROM documents
    """.replace("'[1, 2]=3'", "'[1,2]=3'")
)
def normalise_coding_table(spark, sf_dir):
    literal = F.concat(F.lit("['"), F.col("source"), F.lit("', '"), F.col("lang"), F.lit("']"))
    typed = _documents(spark, sf_dir).select(
        "source_file",
        "record_index",
        "source_revision",
        F.when(F.col("lang") != "de", F.concat(F.lit("http://x/"), F.col("doc_id"))).alias("url"),
        F.col("text").alias("question"),
        F.when(F.col("lang") == "en", F.col("source")).alias("name"),
        F.when(F.col("lang") == "en", "VERY_HARD")
        .when(F.col("lang") == "fr", "beginner")
        .alias("difficulty"),
        F.when(F.col("lang") == "en", F.to_json(F.array("source", "lang")))
        .when(F.col("lang") == "es", "not a list")
        .otherwise(literal)
        .alias("tags"),
        F.lit("{'inputs': [(1, 2)], 'outputs': [3, 4]}").alias("input_output"),
        F.lit('["print(1)"]').alias("solutions"),
    )
    spec = choose(["taco"])[0]
    return _shape(normalisers.coding_table(as_variant(typed).drop("rejected"), spec, RUN))


def _archives(documents):
    """A task archive per document, packed by the tasks; one language is broken."""

    def member(archive, name, text):
        data = text.encode("utf-8")
        info = tarfile.TarInfo(name)
        info.size = len(data)
        archive.addfile(info, io.BytesIO(data))

    def pack(row):
        if row.lang == "de":
            return b"not an archive"
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as archive:
            member(archive, "instruction.md", f"# {row.source}  \n{row.text}")
            member(archive, "task.toml", f'[metadata]\ndifficulty = "very_hard"\ntags = ["{row.lang}"]\n')
            tests = {"inputs": list(range(12)), "outputs": [row.lang] * 11}
            member(archive, "tests/test_data.json", json.dumps(tests))
        return out.getvalue()

    def batches(frames):
        for frame in frames:
            for start in range(0, len(frame), 100):
                part = frame.iloc[start : start + 100]
                packed = [pack(row) for row in part.itertuples()]
                kept = part[["source_file", "record_index", "source_revision", "path"]]
                yield kept.assign(task_binary=pd.Series(packed, index=part.index, dtype=object))

    return documents.withColumn("path", F.concat(F.lit("task-"), F.col("doc_id"))).mapInPandas(
        batches,
        "source_file string, record_index long, source_revision string, path string, task_binary binary",
    )


@query(
    f"""
    SELECT {_key('CodeContests', "'task-' || doc_id")} AS source_key,
           'task-' || doc_id AS original_id, doc_id AS record_index,
           CASE WHEN lang = 'de' THEN 'task-' || doc_id ELSE source END AS title,
           CASE WHEN lang = 'de' THEN 'Medium' ELSE 'Very Hard' END AS difficulty,
           CASE WHEN lang = 'de' THEN 0 ELSE length('# ' || source || '  ' || chr(10) || text) END
             AS statement_chars,
           CASE WHEN lang = 'de' THEN '' ELSE lang END AS tags, 0 AS assets, '' AS solutions,
           CASE WHEN lang = 'de' THEN '' ELSE array_to_string(
             list_transform(range(11), lambda i: i || '="' || lang || '"'), '|') END AS cases,
           true AS is_complete
    FROM documents
    """
)
def archive_decode(spark, sf_dir):
    spec = choose(["codecontests"])[0]
    return _shape(normalisers.coding_archives(_archives(_documents(spark, sf_dir)), spec, RUN))


_SQL_SHAPE = """'' AS tags, {assets} AS assets, {answer} AS solutions, '' AS cases,
           false AS is_complete, NULL::varchar AS original_id, doc_id AS record_index"""


@query(
    f"""
    SELECT {_key('spider', 'lang', 'text', 'source')} AS source_key,
           'SQL: ' || left(text, 60) AS title, 'Medium' AS difficulty,
           length('Database: **' || lang || '**' || chr(10) || chr(10) || '**Question:** ' || text)
             AS statement_chars,
           {_SQL_SHAPE.format(assets=0, answer='source')}
    FROM documents WHERE {_NOT_BROKEN}
    """
)
def normalise_sql_by_database(spark, sf_dir):
    raw = _lines(
        _documents(spark, sf_dir), db_id=F.col("lang"), question=F.col("text"), query=F.col("source")
    )
    spec = choose(["spider"])[0]
    return _shape(normalisers.sql_by_database(_usable(raw), spec, RUN))


@query(
    f"""
    SELECT {_key('sql-create-context', 'text', "CASE WHEN lang = 'en' THEN lang ELSE '' END", 'source')}
             AS source_key,
           'SQL: ' || left(text, 60) AS title, 'Easy' AS difficulty,
           length(text) AS statement_chars,
           {_SQL_SHAPE.format(assets="CASE WHEN lang = 'en' THEN 1 ELSE 0 END", answer='source')}
    FROM documents WHERE {_NOT_BROKEN}
    """
)
def normalise_sql_with_context(spark, sf_dir):
    raw = _lines(
        _documents(spark, sf_dir),
        input=F.col("text"),
        context=F.when(F.col("lang") == "en", F.col("lang")),
        output=F.col("source"),
    )
    spec = choose(["sqlctx"])[0]
    return _shape(normalisers.sql_with_context(_usable(raw), spec, RUN))


def _prompt_records(spark, sf_dir):
    """Text-to-SQL records whose identity repeats with the text of a document."""
    raw = _lines(
        _documents(spark, sf_dir),
        autotrain_text=F.when(F.col("lang") == "en", F.col("text")).otherwise(""),
        prompt=F.col("text"),
        schema=F.col("lang"),
        sql=F.lit("SELECT 1"),
    )
    return raw, normalisers.sql_from_prompt(_usable(raw), choose(["querypls"])[0], RUN)


@query(
    f"""
    SELECT {_key('querypls-prompt2sql-dataset', 'text', 'lang', "'SELECT 1'")} AS source_key,
           'SQL: ' || left(text, 60) AS title, 'Medium' AS difficulty,
           length(text) AS statement_chars,
           {_SQL_SHAPE.format(assets=1, answer="'SELECT 1'")}
    FROM documents WHERE {_NOT_BROKEN}
    """
)
def normalise_sql_from_prompt(spark, sf_dir):
    return _shape(_prompt_records(spark, sf_dir)[1])


# --- Import ------------------------------------------------------------------


@query(
    f"""
    WITH good AS (SELECT * FROM documents WHERE {_NOT_BROKEN}),
    kept AS (SELECT count(*) AS n FROM (SELECT DISTINCT lang, text FROM good))
    SELECT 1 AS pass, (SELECT count(*) FROM documents) AS records, n AS imported,
           (SELECT count(*) FROM documents) - n AS skipped FROM kept
    UNION ALL
    SELECT 2, (SELECT count(*) FROM documents), 0, (SELECT count(*) FROM documents)
    """
)
def jsonl_ingest_twice(spark, sf_dir):
    raw, normalised = _prompt_records(spark, sf_dir)
    nothing = normalised.select("source.*").limit(0)
    first = staged(sinks.new_questions(normalised, nothing).select("source.*"))
    second = sinks.new_questions(normalised, first)
    records = raw.agg(F.count("*").alias("records"))

    def counts(number, accepted):
        imported = accepted.agg(F.count("*").alias("imported"))
        return records.select(
            F.lit(number).alias("pass"), "records", imported.scalar().alias("imported")
        ).withColumn("skipped", F.col("records") - F.col("imported"))

    return counts(1, first).unionByName(counts(2, second))


@query(
    f"""
    WITH first AS (SELECT lang, min(doc_id) AS doc_id FROM documents WHERE {_NOT_BROKEN}
                   GROUP BY lang, text)
    SELECT 'question_sources' AS "table", count(*) AS n, NULL::bigint AS complete FROM first
    UNION ALL SELECT 'questions', count(*), 0 FROM first
    UNION ALL SELECT 'question_assets', count(*), NULL FROM first
    UNION ALL SELECT 'reference_solutions', count(*), NULL FROM first
    UNION ALL SELECT 'question_test_cases', 0, NULL
    """
)
def imported_tables(spark, sf_dir):
    normalised = _prompt_records(spark, sf_dir)[1]
    accepted = staged(sinks.new_questions(normalised, normalised.select("source.*").limit(0)))
    counts = []
    for name, df in sinks.question_tables(accepted).items():
        complete = F.count_if("is_complete") if name == "questions" else F.lit(None).cast("long")
        counts.append(
            df.agg(F.count("*").alias("n"), complete.alias("complete")).withColumn("table", F.lit(name))
        )
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


@query(
    f"""
    SELECT {_key('LeetCodeDataset', _A_ID)} AS source_key, doc_id AS record_index
    FROM documents d WHERE {_NOT_BROKEN} AND {_A_ID} IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    """
)
def new_after_legacy_import(spark, sf_dir):
    """Labelled documents were imported by an older release, under other keys."""
    spec = choose(["leetcode"])[0]
    normalised = normalisers.coding_lines_a(_usable(_coding_lines_a(spark, sf_dir)), spec, RUN)
    labelled = B.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_labelled"))
    stored = normalised.join(
        labelled, F.col("source.source_record_index") == F.col("_labelled"), "left_semi"
    ).select(
        "source.dataset_name",
        "source.original_id",
        F.concat(F.lit("legacy:"), F.col("source.source_record_index")).alias("source_key"),
        F.lit("D:\\Data\\DOCUMENTS.jsonl").alias("source_file"),
    )
    fresh = sinks.new_questions(normalised, stored)
    return fresh.select("source.source_key", F.col("source.source_record_index").alias("record_index"))


_NORMAL = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_HASH = f"sha256(lang || chr(0) || {_NORMAL})"


def _hashed(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", X.content_hash(F.col("lang"), F.col("text")).alias("content_hash")
    )


@query(
    f"""
    SELECT {_HASH} AS content_hash, min(doc_id) AS doc_id, count(*) AS copies
    FROM documents GROUP BY 1
    """
)
def content_hash_dedup(spark, sf_dir):
    return _hashed(spark, sf_dir).groupBy("content_hash").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")
    )


@query(
    f"""
    WITH h AS (SELECT doc_id, {_HASH} AS content_hash FROM documents),
    stored AS (SELECT content_hash FROM h JOIN labels USING (doc_id))
    SELECT content_hash, min(doc_id) AS doc_id FROM h
    WHERE doc_id NOT IN (SELECT doc_id FROM labels)
      AND content_hash NOT IN (SELECT content_hash FROM stored) GROUP BY content_hash
    """
)
def new_vs_existing_anti(spark, sf_dir):
    hashed = _hashed(spark, sf_dir)
    labels = B.table(spark, sf_dir, "labels").select("doc_id")
    stored = hashed.join(labels, "doc_id", "left_semi").select("content_hash").distinct()
    incoming = hashed.join(labels, "doc_id", "left_anti")
    first = first_per_key(incoming, ["content_hash"], ["doc_id"])
    return first.join(stored, "content_hash", "left_anti").select("content_hash", "doc_id")


@query(
    f"""
    SELECT doc_id, {_key('corpus', 'source', 'text')} AS source_key,
           sha256('corpus' || chr(0) || source || chr(0) || doc_id || chr(0) || text) AS item_key,
           sha256({_NORMAL}) AS prompt_key
    FROM documents
    """
)
def source_keys(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select(
        "doc_id",
        X.source_key(F.lit("corpus"), F.col("source"), F.col("text")).alias("source_key"),
        X.item_source_key(F.lit("corpus"), F.col("source"), F.col("doc_id"), F.col("text")).alias("item_key"),
        X.prompt_hash(F.col("text")).alias("prompt_key"),
    )


@query(
    """
    WITH kinds AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS a,
                          bool_or(l_returnflag = 'N') AS n, bool_or(l_returnflag = 'R') AS r
                   FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS question_id,
           concat_ws(',', CASE WHEN NOT coalesce(a, false) THEN 'schema' END,
                     CASE WHEN NOT coalesce(n, false) THEN 'fixture_data' END,
                     CASE WHEN NOT coalesce(r, false) THEN 'expected_result' END) AS missing_assets,
           coalesce(a AND n AND r, false) AS is_complete
    FROM orders LEFT JOIN kinds ON l_orderkey = o_orderkey
    """
)
def completeness(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "schema").when(
        F.col("l_returnflag") == "N", "fixture_data"
    )
    assets = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("question_id"), kind.otherwise("expected_result").alias("asset_type")
    )
    questions = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"))
    checked = sinks.asset_completeness(questions, assets)
    return checked.withColumn("missing_assets", F.array_join("missing_assets", ","))


@query(
    f"""
    WITH firsts AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_HASH})
    SELECT source, count(f.doc_id) AS imported, count(*) - count(f.doc_id) AS skipped
    FROM documents d LEFT JOIN firsts f ON f.doc_id = d.doc_id GROUP BY source
    """
)
def import_outcomes(spark, sf_dir):
    hashed = _hashed(spark, sf_dir)
    return outcome_counts(hashed, first_per_key(hashed, ["content_hash"], ["doc_id"]), "source")


@query(
    """
    SELECT event_type, count(*) AS n, sum((props->>'k')::bigint) AS k_sum,
           count(CASE WHEN (props->>'k')::bigint > 50 THEN 1 END) AS large
    FROM events GROUP BY event_type
    """
)
def json_prop_summary(spark, sf_dir):
    k = F.coalesce(decode(F.col("props"), "k bigint")["k"], F.lit(0))
    return (
        B.table(spark, sf_dir, "events")
        .select("event_type", k.alias("k"))
        .groupBy("event_type")
        .agg(
            F.count("*").alias("n"), F.sum("k").alias("k_sum"), F.count_if(F.col("k") > 50).alias("large")
        )
    )


@query(
    """
    SELECT event_type, 'z' AS missing, 'k' AS unexpected, count(*) AS n
    FROM events WHERE list_contains(json_keys(props), 'k') GROUP BY event_type
    """
)
def field_audit(spark, sf_dir):
    keys = F.json_object_keys("props")
    required, allowed = F.array(F.lit("k"), F.lit("z")), F.array(F.lit("z"))
    audited = B.table(spark, sf_dir, "events").select(
        "event_type",
        F.array_join(missing_fields(keys, required), ",").alias("missing"),
        F.array_join(missing_fields(allowed, keys), ",").alias("unexpected"),
    )
    return audited.groupBy("event_type", "missing", "unexpected").agg(F.count("*").alias("n"))


# --- Manifest and policy -----------------------------------------------------


@query(
    """
    SELECT url AS path, octet_length(encode(html)) AS bytes, sha256(html) AS sha256 FROM pages
    """
)
def file_manifest(spark, sf_dir):
    return manifest_of(B.table(spark, sf_dir, "pages"), "url", "html")


_SOURCE_ROWS = ", ".join(
    f"({i}, '{s.name}', {str(s.rights.importable).lower()})" for i, s in enumerate(PROMPT_CORPORA)
)


_REVISIONS = {s.name: f"rev-{s.name}" for s in PROMPT_CORPORA if s.rights.license}
_LICENCES = ", ".join(
    f"({i}, '{s.name}', {'NULL' if s.rights.license is None else repr(s.rights.license)}, {str(s.rights.importable).lower()})"
    for i, s in enumerate(PROMPT_CORPORA)
)


@query(
    f"""
    SELECT s.source || '/' || url AS path, octet_length(encode(html)) AS bytes, sha256(html) AS sha256,
           s.source AS source, CASE WHEN s.license IS NOT NULL THEN 'rev-' || s.source END AS revision,
           s.license AS license, CASE WHEN s.allowed THEN 'import' ELSE 'raw-only' END AS decision
    FROM pages JOIN (VALUES {_LICENCES}) s(no, source, license, allowed) ON s.no = page_id % 10
    """
)
def source_manifests(spark, sf_dir):
    """Every page as a file of one of the sources."""
    names = F.array(*[F.lit(s.name) for s in PROMPT_CORPORA])
    folder = F.get(names, (F.col("page_id") % len(PROMPT_CORPORA)).cast("int"))
    pages = B.table(spark, sf_dir, "pages").withColumn("path", F.concat_ws("/", folder, "url"))
    return source_manifest(manifest_of(pages, "path", "html"), policy_frame(spark), _REVISIONS)


@query(
    f"""
    SELECT s.source, CASE WHEN s.allowed THEN 'import' ELSE 'raw-only' END AS decision,
           count(*) AS files, sum(octet_length(encode(html))) AS bytes,
           CASE WHEN s.allowed THEN count(*) ELSE 0 END AS importable
    FROM pages JOIN (VALUES {_SOURCE_ROWS}) s(no, source, allowed) ON s.no = page_id % 10
    GROUP BY s.source, s.allowed
    """
)
def license_gate(spark, sf_dir):
    names = F.array(*[F.lit(s.name) for s in PROMPT_CORPORA])
    files = B.table(spark, sf_dir, "pages").select(
        F.get(names, (F.col("page_id") % len(PROMPT_CORPORA)).cast("int")).alias("source"),
        F.octet_length(F.encode("html", "UTF-8")).alias("length"),
    )
    policy = policy_frame(spark)
    kept = allowed_only(files, policy).groupBy("source").agg(F.count("*").alias("importable"))
    sizes = files.groupBy("source").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    decision = F.when(F.col("ingestion_allowed"), "import").otherwise("raw-only")
    return (
        sizes.join(policy, "source")
        .join(kept, "source", "left")
        .select(
            "source",
            decision.alias("decision"),
            "files",
            "bytes",
            F.coalesce("importable", F.lit(0)).alias("importable"),
        )
    )


# --- Lines and Markdown ------------------------------------------------------


@query(
    """
    SELECT doc_id, line_no - 1 AS line_no, line FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS line_no,
             len(string_split(text, chr(10))) AS n
      FROM documents) WHERE NOT (line_no = n AND line = '')
    """
)
def line_table(spark, sf_dir):
    return numbered_lines(B.table(spark, sf_dir, "documents"), "text", ["doc_id"])


def _markdown(spark, sf_dir, rewrites):
    """pages as Markdown files: tags become line marks, other tags go."""
    body = F.col("html")
    for pattern, replacement in [*rewrites, ("<[^>]*>", "")]:
        body = F.regexp_replace(body, pattern, replacement)
    return B.table(spark, sf_dir, "pages").select(
        "page_id", F.lit("r1").alias("source_revision"), body.alias("value")
    )


def _markdown_sql(rewrites) -> str:
    body = "html"
    for pattern, replacement in [*rewrites, ("<[^>]*>", "")]:
        body = f"regexp_replace({body}, '{pattern}', '{replacement}', 'g')"
    body = body.replace("\n", "' || chr(10) || '")
    return f"""
    SELECT page_id, line_no - 1 AS line_no, line FROM (
      SELECT page_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no, len(parts) AS n
      FROM (SELECT page_id, string_split({body}, chr(10)) AS parts FROM pages))
    WHERE NOT (line_no = n AND line = '')
    """


_TOPICS = [
    ("<h1>", "\n## "),
    ("<li>", "\n* Design a function "),
    ("<p>", "\n1. **How** does SQL "),
]


@query(
    f"""
    SELECT page_id, line_no, line,
           last_value(CASE WHEN regexp_matches(line, '^#{{2,4}}\\s+.+') THEN line END IGNORE NULLS)
             OVER (PARTITION BY page_id ORDER BY line_no) AS heading
    FROM ({_markdown_sql(_TOPICS)})
    """
)
def heading_carry(spark, sf_dir):
    return interviews.topic_lines(_markdown(spark, sf_dir, _TOPICS)).select(
        "page_id", "line_no", "line", "heading"
    )


_LISTED = "regexp_extract(line, '^\\s*(?:\\d+[.)]|[-*])\\s+(?:\\*\\*)?(.+?)(?:\\*\\*)?\\s*$', 1)"


@query(
    f"""
    WITH l AS (
      SELECT *, last_value(CASE WHEN regexp_matches(line, '^#{{2,4}}\\s+.+') THEN line END IGNORE NULLS)
               OVER (PARTITION BY page_id ORDER BY line_no) AS heading
      FROM ({_markdown_sql(_TOPICS)})),
    p AS (SELECT *, trim(regexp_replace({_LISTED}, '\\*\\*|`', '', 'g')) AS prompt FROM l
          WHERE NOT regexp_matches(line, '^#{{2,4}}\\s+.+'))
    SELECT sha256('set' || chr(0) || 'm/' || page_id || '-notes.md' || chr(0) || line_no || chr(0)
                  || prompt) AS source_key,
           line_no AS record_index, prompt,
           coalesce(trim(regexp_replace(regexp_replace(heading, '^#{{2,4}}\\s+', ''), '[*_`]', '', 'g')),
                    page_id || ' notes') AS topic,
           CASE WHEN regexp_matches(prompt, '(?i)\\b(code|implement|query|function|algorithm)\\b')
                THEN 'coding' ELSE 'theory' END AS answer_format,
           CASE WHEN regexp_matches(prompt, '(?i)^(design|tell me|imagine|suppose|you are)')
                THEN 'scenario' ELSE 'direct' END AS prompt_style,
           CASE WHEN regexp_matches(prompt, '(?i)\\bsql\\b') THEN 'sql' END AS method
    FROM p WHERE length(prompt) >= 15 AND (contains(prompt, '?')
      OR regexp_matches(prompt, '(?i)^(design|describe|explain|tell|how|what|why)'))
    """
)
def generic_markdown_items(spark, sf_dir):
    files = _markdown(spark, sf_dir, _TOPICS).select(
        F.concat(F.lit("m/"), F.col("page_id"), F.lit("-notes.md")).alias("source_file"),
        "source_revision",
        "value",
        F.lit("set").alias("dataset"),
        F.lit("MIT").alias("license"),
        F.lit("software").alias("domain"),
    )
    items = interviews.generic_markdown(files, RUN)
    return items.select(
        "source.source_key",
        F.col("source.source_record_index").alias("record_index"),
        "prompt",
        "topic",
        "answer_format",
        "prompt_style",
        "method",
    )


_QA = [
    ("<h1>", "\n### [LLM Fundamentals](x)\n- Short\n    - Answer: lost\n### *AI System Design*\n"),
    ("<p>", "\n- Your "),
    ("[.] ", "\n    - Answer: see [it](http://a.b) "),
    ("</article>", "\n### Unlisted\n- Never taken here"),
]


@query(
    f"""
    WITH l AS (
      SELECT *, CASE WHEN regexp_matches(line, '^###\\s+.+') THEN
                  trim(regexp_replace(regexp_replace(regexp_replace(line, '^###\\s+', ''),
                       '\\[([^]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[*_`]', '', 'g')) END AS head,
             regexp_matches(line, '^-\\s+.+') AS is_question
      FROM ({_markdown_sql(_QA)})),
    s AS (
      SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line_no) AS topic,
             sum(CASE WHEN head IS NOT NULL OR is_question THEN 1 ELSE 0 END)
               OVER (PARTITION BY page_id ORDER BY line_no) AS segment FROM l),
    a AS (SELECT page_id, segment, max_by(regexp_extract(line,
            '^\\s{{2,}}-\\s+Answer:\\s*(.+?)\\s*$', 1), line_no) AS answer
          FROM s WHERE regexp_matches(line, '^\\s{{2,}}-\\s+Answer:\\s*(.+?)\\s*$')
          GROUP BY page_id, segment),
    q AS (SELECT page_id, segment, line_no, topic,
                 trim(regexp_replace(regexp_replace(line, '^-\\s+', ''), '[*_`]', '', 'g')) AS prompt
          FROM s WHERE is_question AND topic IN ('LLM Fundamentals', 'AI System Design'))
    SELECT q.page_id, line_no AS record_index, prompt, topic,
           trim(regexp_replace(answer, '\\[([^]]+)\\]\\(([^)]+)\\)', '\\1 (\\2)', 'g'))
             AS reference_answer,
           CASE WHEN regexp_matches(prompt, '(?i)^({interviews.QA_SCENARIO})')
                THEN 'scenario' ELSE 'direct' END AS prompt_style,
           answer IS NOT NULL AS is_complete
    FROM q LEFT JOIN a USING (page_id, segment) WHERE length(prompt) >= 8
    """
)
def qa_markdown_items(spark, sf_dir):
    files = _markdown(spark, sf_dir, _QA).select(
        F.col("page_id").cast("string").alias("source_file"), "source_revision", "value"
    )
    items = interviews.qa_markdown(files, RUN)
    return items.select(
        F.col("source.source_file").cast("long").alias("page_id"),
        F.col("source.source_record_index").alias("record_index"),
        "prompt",
        "topic",
        "reference_answer",
        "prompt_style",
        sinks.item_complete().alias("is_complete"),
    )


_SECTIONED = [
    ("<nav>", "\n## Sources\n- Build nothing from these notes"),
    ("<h1>", "\n## Questions\n- Explain the first part\n### RAG Systems\n- "),
    ("<p><b>", "\n### Evaluation Criteria Found in Assignments\n- Skipped advice "),
    ("<p>", "\n- Design "),
    ("[.] ", "[^1]\n  - When "),
    ("</article>", "\n## Algorithm Rounds\n- Solve 75+ problems\n- Estimate  the   rest"),
]
_FILES = list(interviews.SECTIONS)
_FILE_ROWS = ", ".join(
    f"({i}, '{name}', {list(interviews.SECTIONS[name])}, '{rule[0]}', '{rule[1]}', '{rule[2]}')"
    for i, (name, rule) in enumerate(interviews.SECTION_FILES.items())
)


@query(
    f"""
    WITH l AS (
      SELECT *, CASE WHEN regexp_matches(line, '^##\\s+.+') THEN
                  trim(regexp_replace(regexp_replace(line, '^##\\s+', ''), '\\s+', ' ', 'g')) END AS h2,
             CASE WHEN regexp_matches(line, '^###\\s+.+') THEN
                  trim(regexp_replace(regexp_replace(line, '^###\\s+', ''), '\\s+', ' ', 'g')) END AS h3
      FROM ({_markdown_sql(_SECTIONED)})),
    s AS (SELECT *, sum(CASE WHEN h2 IS NOT NULL THEN 1 ELSE 0 END)
                      OVER (PARTITION BY page_id ORDER BY line_no) AS part FROM l),
    c AS (SELECT *, coalesce(first_value(h2 IGNORE NULLS) OVER (PARTITION BY page_id, part
                    ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS in_h2,
                 coalesce(last_value(h3 IGNORE NULLS) OVER (PARTITION BY page_id, part
                    ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS in_h3
          FROM s),
    b AS (SELECT c.*, f.*, trim(regexp_replace(regexp_replace(
             regexp_extract(line, '^\\s*-\\s+(.+?)\\s*$', 1), '\\[\\^.+?\\]', '', 'g'), '\\s+', ' ', 'g'))
             AS prompt
          FROM c JOIN (VALUES {_FILE_ROWS}) f(no, name, allowed, topic, fmt, style)
            ON f.no = page_id % 6
          WHERE in_h2 <> 'Sources' AND in_h3 <> 'Evaluation Criteria Found in Assignments'
            AND (list_contains(allowed, in_h2) OR list_contains(allowed, in_h3)))
    SELECT page_id, line_no AS record_index, prompt,
           CASE WHEN in_h3 <> '' THEN in_h3 ELSE in_h2 END AS topic, fmt AS answer_format,
           CASE WHEN regexp_matches(prompt,
                  '(?i)^(describe|tell|design|build|implement|refactor|debug|scale|estimate)')
                THEN 'scenario' ELSE style END AS prompt_style
    FROM b WHERE length(prompt) >= 8 AND NOT starts_with(prompt, 'Solve 75+')
    """
)
def section_markdown_items(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in _FILES])
    name = F.get(names, (F.col("page_id") % len(_FILES)).cast("int"))
    files = _markdown(spark, sf_dir, _SECTIONED).select(
        F.concat_ws("/", F.col("page_id").cast("string"), name).alias("source_file"),
        "source_revision",
        "value",
    )
    items = interviews.section_markdown(files, RUN)
    return items.select(
        F.substring_index("source.source_file", "/", 1).cast("long").alias("page_id"),
        F.col("source.source_record_index").alias("record_index"),
        "prompt",
        "topic",
        "answer_format",
        "prompt_style",
    )


@query(
    """
    WITH l AS (SELECT lang, regexp_extract(line, '^\\s*(?:\\d+[.)]|[-*])?\\s*(.*?)\\s*$', 1) AS prompt
               FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents))
    SELECT lang, count(*) AS lines,
           count(CASE WHEN length(prompt) >= 15 AND (contains(prompt, '?') OR
             regexp_matches(prompt, '(?i)^(design|describe|explain|tell|how|what|why)')) THEN 1 END)
             AS questions,
           count(CASE WHEN regexp_matches(prompt,
             '(?i)\\b(code|implement|query|function|algorithm)\\b') THEN 1 END) AS coding,
           count(CASE WHEN regexp_matches(prompt,
             '(?i)^(design|tell me|imagine|suppose|you are)') THEN 1 END) AS scenarios
    FROM l WHERE prompt <> '' GROUP BY lang
    """
)
def line_classifier(spark, sf_dir):
    lines = numbered_lines(B.table(spark, sf_dir, "documents"), "text", ["lang"])
    prompt = F.regexp_extract("line", r"^\s*(?:\d+[.)]|[-*])?\s*(.*?)\s*$", 1)
    prompts = lines.select("lang", prompt.alias("prompt")).filter(F.col("prompt") != "")
    text = F.col("prompt")
    return prompts.groupBy("lang").agg(
        F.count("*").alias("lines"),
        F.count_if(X.looks_like_question(text)).alias("questions"),
        F.count_if(X.answer_format(text) == "coding").alias("coding"),
        F.count_if(X.prompt_style(text, interviews.GENERIC_SCENARIO) == "scenario").alias("scenarios"),
    )


@query(
    """
    SELECT doc_id,
           CASE WHEN length(text) <= 80 THEN text ELSE left(text, 79) || '…' END AS preview,
           CASE WHEN length(text) <= 50 THEN text
                ELSE left(text, 50) || chr(10) || '[context truncated]' END AS context,
           source || ' (' || lang || '.org) and' AS cited, source || ' and bold' AS plain,
           'Two ' || upper(source[1]) || source[2:] || ' Sums' AS title
    FROM documents
    """
)
def text_cleanup(spark, sf_dir):
    link = F.concat(F.lit(" ["), F.col("source"), F.lit("]("), F.col("lang"), F.lit(".org) and "))
    emphasis = F.concat(link, F.lit("**bold**"))
    return B.table(spark, sf_dir, "documents").select(
        "doc_id",
        X.clip_ellipsis(F.col("text"), 80).alias("preview"),
        X.clip_marked(F.col("text"), 50).alias("context"),
        X.cited_markdown(link).alias("cited"),
        X.plain_markdown(emphasis).alias("plain"),
        X.slug_title(F.concat_ws("-", F.lit("two"), F.col("source"), F.lit("sums"))).alias("title"),
    )


# --- Interview items ---------------------------------------------------------


def _interview_raw(spark, sf_dir):
    return _lines(
        _documents(spark, sf_dir),
        question=F.col("text"),
        answer=F.when(F.col("lang") == "en", F.array("lang", "source")),
        expertise=F.col("n_chars") % 4,
        tags=F.when(F.col("lang") != "fr", F.array("source", "lang")),
    )


@query(
    f"""
    SELECT sha256('30-seconds-of-interviews' || chr(0) || 'coding/documents.jsonl' || chr(0) || doc_id
                  || chr(0) || trim(text, ' ' || chr(10))) AS source_key,
           CASE WHEN lang = 'fr' THEN 'general' ELSE source END AS topic,
           CASE n_chars % 4 WHEN 0 THEN 'Beginner' WHEN 2 THEN 'Hard' ELSE 'Medium' END AS difficulty,
           CASE WHEN lang = 'en' THEN lang || chr(10) || chr(10) || source END AS reference_answer,
           CASE WHEN lang = 'fr' THEN '' ELSE source || '|' || lang END AS tags,
           lang = 'en' AS is_complete
    FROM documents WHERE {_NOT_BROKEN}
    """
)
def interview_json_items(spark, sf_dir):
    items = interviews.interview_json(_interview_raw(spark, sf_dir), RUN)
    return items.select(
        "source.source_key",
        "topic",
        "difficulty",
        "reference_answer",
        F.array_join("tags", "|").alias("tags"),
        sinks.item_complete().alias("is_complete"),
    )


_ITEM_HASH = f"sha256('software-engineering' || chr(0) || {_NORMAL})"


@query(
    f"""
    WITH h AS (SELECT doc_id, {_ITEM_HASH} AS content_hash FROM documents WHERE {_NOT_BROKEN}),
    stored AS (SELECT content_hash FROM h JOIN labels USING (doc_id))
    SELECT content_hash, min(doc_id) AS record_index FROM h
    WHERE content_hash NOT IN (SELECT content_hash FROM stored) GROUP BY content_hash
    """
)
def item_import(spark, sf_dir):
    items = interviews.interview_json(_interview_raw(spark, sf_dir), RUN)
    labels = B.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_labelled"))
    known = items.join(
        labels, F.col("source.source_record_index") == F.col("_labelled"), "left_semi"
    ).select(X.content_hash(F.col("domain"), F.col("prompt")).alias("content_hash"))
    fresh = sinks.new_items(items, known, items.select("source.*").limit(0))
    return fresh.select("content_hash", F.col("source.source_record_index").alias("record_index"))


@query(
    f"""
    WITH h AS (SELECT doc_id, {_HASH} AS content_hash FROM documents),
    stored AS (SELECT content_hash, min(doc_id) AS id FROM h JOIN labels USING (doc_id)
               GROUP BY content_hash),
    asked AS (SELECT h.*, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) AS n FROM h
              WHERE doc_id NOT IN (SELECT doc_id FROM labels))
    SELECT a.doc_id AS request_id,
           coalesce(s.id::varchar, md5('item' || chr(0) || a.content_hash)) AS id,
           s.id IS NULL AND a.n = 1 AS is_new
    FROM asked a LEFT JOIN stored s USING (content_hash)
    """
)
def insert_or_get_items(spark, sf_dir):
    return _generated_items(spark, sf_dir).select("request_id", "id", "is_new")


def _generated_items(spark, sf_dir):
    """Unlabelled documents as generated items, labelled ones as the stored items."""
    documents = B.table(spark, sf_dir, "documents")
    labels = B.table(spark, sf_dir, "labels").select("doc_id")
    stored = (
        _hashed(spark, sf_dir)
        .join(labels, "doc_id", "left_semi")
        .groupBy("content_hash")
        .agg(F.min("doc_id").cast("string").alias("id"))
    )
    generated = documents.join(labels, "doc_id", "left_anti").select(
        F.col("doc_id").alias("request_id"),
        F.col("lang").alias("domain"),
        F.col("text").alias("prompt"),
        "source",
        "n_chars",
    )
    return sinks.insert_or_get(generated, stored)


@query(
    f"""
    WITH h AS (SELECT *, {_HASH} AS content_hash FROM documents),
    fresh AS (SELECT min(doc_id) AS doc_id, content_hash FROM h
      WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND content_hash NOT IN
        (SELECT content_hash FROM h JOIN labels USING (doc_id)) GROUP BY content_hash),
    asked AS (SELECT DISTINCT content_hash FROM h WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
    firsts AS (SELECT content_hash, min(doc_id) AS doc_id FROM h
      WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY content_hash)
    SELECT 'question_sources' AS "table",
           CASE WHEN n_chars > 1000 THEN 'http://x/' || source ELSE 'AI generated' END AS detail,
           count(*) AS n
    FROM fresh JOIN h USING (doc_id) GROUP BY ALL
    UNION ALL SELECT 'interview_items', lang, count(*) FROM fresh JOIN h USING (doc_id) GROUP BY ALL
    UNION ALL SELECT 'interview_item_generation',
                     CASE WHEN n_chars > 1000 THEN 'web' ELSE 'ai' END, count(*)
    FROM firsts JOIN h USING (doc_id) GROUP BY ALL
    """
)
def generated_item_tables(spark, sf_dir):
    none = F.lit(None)
    addresses = F.array(F.concat(F.lit("http://x/"), F.col("source")))
    items = _generated_items(spark, sf_dir).withColumns(
        {
            "web_sources": F.when(F.col("n_chars") > 1000, addresses).otherwise(F.slice(addresses, 1, 0)),
            "topic": F.col("source"),
            "answer_format": F.lit("theory"),
            "prompt_style": F.lit("direct"),
            "difficulty": F.lit("Medium"),
            "reference_answer": F.col("source"),
            "rubric": F.array("source"),
            "method": none.cast("string"),
            "options": none.cast("array<struct<id:string,text:string>>"),
            "correct_option": none.cast("string"),
            "tags": F.array("source"),
            "provider": F.lit("p"),
            "model_id": F.lit("m"),
            "prompt_version": F.lit("v1"),
        }
    )
    nothing = items.select(F.col("id").alias("interview_item_id")).limit(0)
    tables = sinks.generated_item_tables(staged(items), nothing)
    details = {
        "question_sources": "source_file",
        "interview_items": "domain",
        "interview_item_generation": "origin",
    }
    out = None
    for name, detail in details.items():
        counts = tables[name].groupBy(F.col(detail).alias("detail")).agg(F.count("*").alias("n"))
        counts = counts.withColumn("table", F.lit(name))
        out = counts if out is None else out.unionByName(counts)
    return out


@query(
    """
    SELECT source AS source_file, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS record_index,
           doc_id, length(coalesce(text, '')) AS chars, md5(coalesce(text, '')) AS digest
    FROM documents WHERE source IS NOT NULL
    """
)
def json_array_pieces(spark, sf_dir):
    """The documents of each source as one JSON array that is cut into pieces anywhere."""
    documents = B.table(spark, sf_dir, "documents").filter(F.col("source").isNotNull())
    ends = documents.groupBy(F.col("source").alias("of")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    element = F.to_json(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.array(F.lit("],[")).alias("odd")))
    before = F.when(F.col("doc_id") == F.col("first"), " [").otherwise(",\n")
    after = F.when(F.col("doc_id") == F.col("last"), "]\n").otherwise("")
    whole = documents.join(ends, F.col("source") == F.col("of")).select(
        "source", "doc_id", F.encode(F.concat(before, element, after), "UTF-8").alias("bytes")
    )
    # three pieces of unlike size, without regard to characters, strings or escapes
    places = [F.lit(0), *[F.expr(f"cast(pmod(xxhash64(doc_id, {k}), octet_length(bytes)) as int)") for k in (1, 2)], F.octet_length("bytes")]
    cuts = F.array_sort(F.array(*places))
    pieces = whole.withColumn("cuts", cuts).select(
        F.col("source").alias("source_file"), "doc_id", "bytes", "cuts", F.explode(F.array(*map(F.lit, range(3)))).alias("k")
    )
    pieces = pieces.select(
        "source_file",
        (F.col("doc_id") * 3 + F.col("k")).alias("part"),
        F.expr("doc_id div 300").alias("block"),
        F.expr("substring(bytes, cuts[k] + 1, cuts[k + 1] - cuts[k])").alias("value"),
    )
    found = parse_elements(arrays.array_elements(pieces)).filter(~F.col("rejected"))
    text = F.variant_get("record", "$.text", "string")
    return found.select(
        "source_file",
        "record_index",
        F.variant_get("record", "$.doc_id", "long").alias("doc_id"),
        F.length(text).alias("chars"),
        F.md5(text).alias("digest"),
    )
