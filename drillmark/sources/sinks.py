"""Idempotent tables: one row of a source fans out to several of them.

A catalog is a folder of parquet tables, each with one sub-folder per import
run.  Writing a run again replaces its own sub-folders and nothing else.  Rows
count only when the run's audit row says ``completed``: a run that dies half
way stays invisible to readers.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drillmark import schemas as S
from drillmark.functions.payload import field, list_field, text_field
from drillmark.functions.scoring import syntax_language
from drillmark.functions.text import content_hash, derived_id, file_name, is_blank
from drillmark.operators.barrier import staged
from drillmark.operators.joins import spread_join
from drillmark.operators.ordered import first_per_key
from drillmark.plans.validation import method_rule
from drillmark.sources import generations, stored_keys

# --- Which records are new ---------------------------------------------------


def storable(questions: DataFrame) -> DataFrame:
    """Records that have a statement and obey the method rule."""
    return questions.filter(
        ~is_blank(F.col("problem_statement"))
        & method_rule(F.col("question_type"), F.col("supported_methods"))
    )


def with_completeness(questions: DataFrame) -> DataFrame:
    """An analysis question is complete when it has all required assets.

    This overrides the flag of the source; ``missing_assets`` lists the rest.
    """
    required = F.array(*[F.lit(a) for a in S.REQUIRED_ANALYSIS_ASSETS])
    present = F.transform("assets", lambda a: a["asset_type"])
    missing = F.when(
        F.col("question_type") == "data_analysis", F.array_except(required, present)
    ).otherwise(F.array().cast("array<string>"))
    return questions.withColumn("missing_assets", missing).withColumn(
        "is_complete",
        F.when(F.col("question_type") == "data_analysis", F.size("missing_assets") == 0).otherwise(
            F.col("is_complete")
        ),
    )


_ROW = ["_file", "_row"]


def _numbered(records: DataFrame) -> DataFrame:
    """The records, written once, with the file and place each row lies at."""
    return staged(records).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def _firsts(narrow: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key, by source file and record index: one struct per key and map task."""
    rest = [c for c in narrow.columns if c not in (*keys, "file", "index", *_ROW)]
    first = narrow.groupBy(*keys).agg(F.min(F.struct("file", "index", *_ROW, *rest)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in ("file", "index", *_ROW, *rest)])


def _fetched(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The whole records of the chosen rows."""
    return rows.join(chosen.select(*_ROW), _ROW, "left_semi").drop(*_ROW)


def _unstored(narrow: DataFrame, key: Column, stored: DataFrame) -> DataFrame:
    """Rows whose key is not among the stored ones; a row without a key is not stored."""
    known = stored.select(F.col("key").alias("_known"))
    return narrow.withColumn("_key", key).join(known, F.col("_key") == F.col("_known"), "left_anti").drop("_key")


def new_questions(questions: DataFrame, stored_sources: DataFrame) -> DataFrame:
    """Storable records that are neither stored nor repeated.

    Older imports are recognised by original id and file name, record by record;
    of the rest the first record of a key wins, by file and record index.
    """
    return new_by_keys(questions, stored_keys.keys_of_sources(stored_sources))


def new_by_keys(questions: DataFrame, stored: DataFrame) -> DataFrame:
    """``new_questions`` against stored keys (key).

    The records are written once.  What decides are their keys and places alone;
    statements are read again for the records that are new.
    """
    rows = _numbered(storable(questions))
    narrow = rows.select(
        F.col("source.dataset_name").alias("dataset"),
        F.col("source.source_key").alias("key"),
        stored_keys.legacy_key(F.col("source.dataset_name"), F.col("source.legacy_original_id"), F.col("source.source_file")).alias("old"),
        F.col("source.source_file").alias("file"),
        F.col("source.source_record_index").alias("index"),
        *_ROW,
    )
    unknown = _unstored(narrow, F.col("old"), stored).drop("old")
    first = _firsts(unknown, ["dataset", "key"])
    return _fetched(rows, _unstored(first, stored_keys.source_key(F.col("dataset"), F.col("key")), stored))


def new_items(items: DataFrame, stored_items: DataFrame, stored_sources: DataFrame) -> DataFrame:
    """Interview items new by content hash and by source key."""
    sources = stored_keys.keys_of_sources(stored_sources)
    return new_items_by_keys(items, stored_keys.keys_of_items(stored_items).unionByName(sources))


def new_items_by_keys(items: DataFrame, stored: DataFrame) -> DataFrame:
    """``new_items`` against stored keys (key), decided on keys and places alone."""
    hashed = items.filter(~is_blank(F.col("prompt"))).withColumn(
        "content_hash", content_hash(F.col("domain"), F.col("prompt"))
    )
    rows = _numbered(hashed)
    narrow = rows.select(
        "content_hash",
        F.col("source.dataset_name").alias("dataset"),
        F.col("source.source_key").alias("key"),
        F.col("source.source_file").alias("file"),
        F.col("source.source_record_index").alias("index"),
        *_ROW,
    )
    by_source = _firsts(_firsts(narrow, ["content_hash"]), ["dataset", "key"])
    fresh = _unstored(by_source, stored_keys.source_key(F.col("dataset"), F.col("key")), stored)
    return _fetched(rows, _unstored(fresh, stored_keys.item_key(F.col("content_hash")), stored))


def same_items(pairs: DataFrame) -> DataFrame:
    """(content_hash, item): hashes that share requests, directly or by others, get their least hash.

    ``pairs``: distinct (content_hash, request_id).  Requests with one hash link
    nothing, so only the others are walked; a round shortens every chain by half
    its length or more, as labels also jump to the label of their label.
    """
    several = pairs.groupBy("request_id").agg(F.min("content_hash").alias("_least"), F.count("*").alias("_n"))
    several = several.filter(F.col("request_id").isNotNull() & (F.col("_n") > 1)).select("request_id")
    links = staged(pairs.join(several, "request_id", "left_semi"))
    labels = staged(links.select("content_hash").distinct().withColumn("item", F.col("content_hash")))
    changed = labels.count() > 0
    while changed:
        per_request = links.join(labels, "content_hash").groupBy("request_id").agg(F.min("item").alias("_least"))
        near = links.join(per_request, "request_id").groupBy("content_hash").agg(F.min("_least").alias("item"))
        jump = labels.select(F.col("content_hash").alias("item"), F.col("item").alias("_further"))
        new = near.join(jump, "item").select("content_hash", F.least("item", "_further").alias("_new"))
        both = staged(labels.join(new, "content_hash"))
        changed = not both.filter(F.col("item") != F.col("_new")).isEmpty()
        labels = both.select("content_hash", F.col("_new").alias("item"))
    return labels


def insert_or_get(generated: DataFrame, stored_items: DataFrame) -> DataFrame:
    """Generated items with their id: the stored one, or a new one.

    Content is compared by the domain form of the hash, like imported items.  Rows
    of one request are one item, so a request that was sent again finds the item of
    its first reply, and contents that share a request share an item.  ``is_new``
    is true for the one row to insert, the first by request id; all others of the
    item get the same id.  Several stored rows of an item give the least id.

    All is decided on hashes, one row each; the generated rows are shuffled once,
    by hash, frequent hashes spread.
    """
    rows = _numbered(generated.withColumn("content_hash", content_hash(F.col("domain"), F.col("prompt"))))
    narrow = rows.select("content_hash", "request_id", *_ROW)
    linked = same_items(narrow.select("content_hash", "request_id").distinct())
    firsts = narrow.groupBy("content_hash").agg(F.min(F.struct("request_id", *_ROW)).alias("_first"))
    ids = stored_items.groupBy("content_hash").agg(F.min("id").alias("_stored"))
    hashes = firsts.join(ids, "content_hash", "left").join(linked, "content_hash", "left")
    hashes = staged(hashes.withColumn("item", F.coalesce("item", "content_hash")))
    items = hashes.groupBy("item").agg(F.min("_first").alias("_begin"), F.min("_stored").alias("_known"))
    told = hashes.select("content_hash", "item").join(items, "item")
    place = F.xxhash64(*_ROW)
    known = spread_join(rows, told, ["content_hash"], place, counted=narrow)
    inserted = F.col("_known").isNull() & (F.col("_begin._file") == F.col("_file")) & (F.col("_begin._row") == F.col("_row"))
    return (
        known.withColumn("id", F.coalesce("_known", derived_id(F.lit("item"), F.col("item"))))
        .withColumn("is_new", inserted)
        .drop("item", "_begin", "_known", *_ROW)
    )


# Provenance of generated interview items.
GENERATED_DATASET = "runtime-generated-interview"
GENERATED_FILE = "AI generated"
GENERATED_ATTRIBUTION = "AI-generated interview question; web citations stored separately."


def generated_item_tables(items: DataFrame, stored_generation: DataFrame) -> dict[str, DataFrame]:
    """Rows to insert for the result of ``insert_or_get``.

    ``items`` also carries the item columns, ``web_sources`` (addresses),
    provider, model_id and prompt_version.
    """
    key = F.concat(F.lit("runtime:"), F.col("content_hash"))
    none = F.lit(None).cast("string")
    new = items.filter("is_new").withColumn(
        "source_id", derived_id(F.lit("source"), F.lit(GENERATED_DATASET), key)
    )
    sources = new.select(
        F.col("source_id").alias("id"),
        F.lit(GENERATED_DATASET).alias("dataset_name"),
        F.col("content_hash").alias("original_id"),
        key.alias("source_key"),
        F.coalesce(F.get("web_sources", F.lit(0)), F.lit(GENERATED_FILE)).alias("source_file"),
        none.alias("source_revision"),
        F.lit(None).cast("long").alias("source_record_index"),
        none.alias("license"),
        F.lit(GENERATED_ATTRIBUTION).alias("attribution"),
        none.alias("import_run_id"),
    )
    return {
        "question_sources": sources,
        "interview_items": new.withColumn("is_complete", F.lit(True)).select(
            *S.TABLES["interview_items"].names
        ),
        "interview_item_generation": generation_rows(items, stored_generation),
    }


def generation_rows(inserted: DataFrame, stored: DataFrame) -> DataFrame:
    """Provenance of generated items, written once per item."""
    wanted = first_per_key(inserted, ["id"], ["request_id"])
    return wanted.join(
        stored.select(F.col("interview_item_id").alias("id")).distinct(), "id", "left_anti"
    ).select(
        F.col("id").alias("interview_item_id"),
        F.when(F.size("web_sources") > 0, "web").otherwise("ai").alias("origin"),
        "provider",
        "model_id",
        "prompt_version",
        F.to_json("web_sources").alias("web_sources"),
    )


# --- Fan-out -----------------------------------------------------------------


def _child_id(question_id: Column, place: Column) -> Column:
    """Ids of a question's rows sort in the order of the source.

    Places have six digits; a longer one is led by a letter for its length,
    which sorts after all digits.
    """
    digits = place.cast("string")
    size = F.length(digits)
    long = F.concat(F.char(F.lit(ord("a") - 7) + size), digits)
    return F.concat_ws("-", question_id, F.when(size > 6, long).otherwise(F.lpad(digits, 6, "0")))


def question_tables(questions: DataFrame) -> dict[str, DataFrame]:
    """The child tables of normalised questions; ids come from the source key."""
    keyed = with_completeness(questions).select(
        "*",
        derived_id(
            F.lit("question"), F.col("source.dataset_name"), F.col("source.source_key")
        ).alias("id"),
        derived_id(
            F.lit("source"), F.col("source.dataset_name"), F.col("source.source_key")
        ).alias("source_id"),
    )

    def children(column: str) -> DataFrame:
        exploded = keyed.select(F.col("id").alias("question_id"), F.posexplode(column).alias("_no", "_row"))
        return exploded.select(
            _child_id(F.col("question_id"), F.col("_no")).alias("id"),
            "question_id",
            "_row.*",
        )

    return {
        "question_sources": keyed.select(F.col("source_id").alias("id"), *[
            F.col(f"source.{c}").alias(c)
            for c in S.TABLES["question_sources"].names
            if c != "id"
        ]),
        "question_assets": children("assets"),
        "reference_solutions": children("solutions").withColumn("is_from_dataset", F.lit(True)),
        "question_test_cases": children("test_cases"),
        "questions": keyed.select(
            *[
                F.lit(False).alias(c) if c == "is_ai_generated" else F.col(c)
                for c in S.TABLES["questions"].names
            ]
        ),
    }


def generated_question_tables(questions: DataFrame) -> dict[str, DataFrame]:
    """Tables of accepted generated questions.

    Rows hold (question_id, question_type, method, provider, model_id,
    prompt_version, generation_metadata) and the accepted VARIANT ``reply``.
    """
    is_algorithm = F.col("question_type") == "algorithm"
    reply = F.col("reply")
    algorithm, analysis = questions.filter(is_algorithm), questions.filter(~is_algorithm)
    analysis_methods = F.array(*[F.lit(m) for m in S.DATA_ANALYSIS_METHODS])

    def per_method(member: str) -> DataFrame:
        codes = F.try_variant_get(reply, f"$.{member}", "map<string,string>")
        return analysis.select("question_id", F.explode(codes).alias("method", "code"))

    def single(member: str) -> DataFrame:
        code = text_field(reply, member)
        return algorithm.select("question_id", "method", code.alias("code")).filter(
            ~is_blank(F.col("code"))
        )

    def shared(asset_type: str, content, content_type: str) -> DataFrame:
        return analysis.select(
            "question_id",
            F.lit(asset_type).alias("asset_type"),
            F.lit("shared").alias("method"),
            content.alias("content"),
            F.lit(content_type).alias("content_type"),
        )

    starters = single("starter_code").unionByName(per_method("starter_code"))
    fixture = F.to_json(F.create_map(text_field(reply, "table_name"), field(reply, "fixture_data")))
    assets = (
        starters.select(
            "question_id",
            F.lit("starter_code").alias("asset_type"),
            "method",
            F.col("code").alias("content"),
            F.lit("text").alias("content_type"),
        )
        .unionByName(shared("schema", text_field(reply, "schema_sql"), "sql"))
        .unionByName(shared("fixture_data", fixture, "json"))
        .unionByName(shared("expected_result", F.to_json(field(reply, "expected_result")), "json"))
    )
    solutions = single("reference_solution").unionByName(per_method("reference_solutions"))
    cases = algorithm.select(
        "question_id", F.posexplode(list_field(reply, "test_cases")).alias("_no", "_case")
    )
    return {
        "question_assets": assets.withColumn(
            "id", derived_id(F.col("question_id"), F.col("asset_type"), F.col("method"))
        ),
        "reference_solutions": solutions.select(
            derived_id(F.col("question_id"), F.col("method")).alias("id"),
            "question_id",
            "method",
            "code",
            syntax_language(F.col("method")).alias("language"),
            F.lit(False).alias("is_from_dataset"),
        ),
        "question_test_cases": cases.select(
            _child_id(F.col("question_id"), F.col("_no")).alias("id"),
            "question_id",
            F.to_json(field(F.col("_case"), "input")).alias("input_data"),
            F.to_json(field(F.col("_case"), "expected_output")).alias("expected_output"),
            F.lit(False).alias("is_example"),
        ),
        "ai_generated_questions": questions.select(
            "question_id", "provider", "model_id", "prompt_version", "generation_metadata"
        ),
        "questions": questions.select(
            F.col("question_id").alias("id"),
            text_field(reply, "title").alias("title"),
            text_field(reply, "difficulty").alias("difficulty"),
            text_field(reply, "problem_statement").alias("problem_statement"),
            text_field(reply, "constraints").alias("constraints"),
            F.to_json(field(reply, "examples")).alias("examples"),
            F.when(is_algorithm, F.array("method")).otherwise(analysis_methods).alias("supported_methods"),
            F.try_variant_get(reply, "$.tags", "array<string>").alias("tags"),
            F.lit(None).cast("string").alias("source_id"),
            F.lit(True).alias("is_ai_generated"),
            F.lit(True).alias("is_complete"),
            "question_type",
        ),
    }


def item_tables(items: DataFrame) -> dict[str, DataFrame]:
    """Source and item rows of new interview items."""
    keyed = items.select(
        "*",
        derived_id(F.lit("item"), F.col("content_hash")).alias("id"),
        derived_id(
            F.lit("source"), F.col("source.dataset_name"), F.col("source.source_key")
        ).alias("source_id"),
    ).withColumn("is_complete", item_complete())
    return {
        "question_sources": keyed.select(F.col("source_id").alias("id"), *[
            F.col(f"source.{c}").alias(c)
            for c in S.TABLES["question_sources"].names
            if c != "id"
        ]),
        "interview_items": keyed.select(*S.TABLES["interview_items"].names),
    }


def item_complete():
    """It has an answer, or asks for code."""
    answered = F.coalesce(F.col("reference_answer") != "", F.lit(False))
    return answered | (F.col("answer_format") == "coding")


# --- Tables on storage -------------------------------------------------------


def run_path(catalog: str, table: str, run_id: str) -> str:
    return f"{catalog.rstrip('/')}/{table}/import_run={run_id}"


def write_run(tables: dict[str, DataFrame], catalog: str, run_id: str) -> None:
    """Write each table's part of a run; questions last, by type."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if name == "questions":
            writer = writer.partitionBy("question_type")
        writer.parquet(run_path(catalog, name, run_id))


def append_rows(df: DataFrame, catalog: str, table: str, run_id: str) -> None:
    """Append a batch of attempts, quizzes, sessions or turns.

    ``run_id`` names the batch; writing the same batch again replaces it.  Its
    rows are read as committed once the audit row behind them is written.
    """
    spark = df.sparkSession

    def audit(status: str, done: datetime | None, rows: int) -> None:
        row = [(run_id, table, started, done, rows, 0, status, None)]
        spark.createDataFrame(row, S.TABLES["import_runs"]).coalesce(1).write.mode("overwrite").parquet(
            run_path(catalog, "import_runs", run_id)
        )

    started = datetime.now(timezone.utc)
    if table == "import_runs":
        df.write.mode("overwrite").parquet(run_path(catalog, table, run_id))
        return
    seen = Observation()
    audit("running", None, 0)
    df.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").parquet(run_path(catalog, table, run_id))
    audit("completed", datetime.now(timezone.utc), seen.get["rows"])


def read_table(spark: SparkSession, catalog: str, table: str) -> DataFrame:
    """All rows of a table with their run, as ``import_run``.

    Batches that were compacted come from their generation, the others from
    their folders; of the audit table the last row of each run counts.
    """
    folders = _folders(spark, catalog, table)
    covered = generations.covered_runs(spark, catalog, table)
    if covered is None:
        return folders
    rows = generations.generation_rows(spark, catalog, table, _with_run(table))
    if table == "import_runs":
        both = folders.unionByName(rows.drop("generation"))
        age = F.struct("started_at", F.col("status") != "running", "completed_at")
        last = both.groupBy("id").agg(F.max_by(F.struct(*both.columns), age).alias("row"))
        return last.select("row.*")
    current = generations.current_runs(covered, read_table(spark, catalog, "import_runs"))
    moved = rows.join(current, ["import_run", "generation"], "left_semi").drop("generation")
    return folders.join(current, "import_run", "left_anti").unionByName(moved)


def _with_run(table: str) -> T.StructType:
    return T.StructType([*S.TABLES[table].fields, T.StructField("import_run", T.StringType())])


def _folders(spark: SparkSession, catalog: str, table: str) -> DataFrame:
    """The rows in the folders of the runs."""
    try:
        return spark.read.schema(_with_run(table)).parquet(f"{catalog.rstrip('/')}/{table}")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _with_run(table))


def read_committed(spark: SparkSession, catalog: str, table: str) -> DataFrame:
    """Rows of completed runs only."""
    completed = read_table(spark, catalog, "import_runs").filter(F.col("status") == "completed")
    runs = completed.select(F.col("id").alias("import_run"))
    return read_table(spark, catalog, table).join(runs, "import_run", "left_semi").drop("import_run")


def write_keys(tables: dict[str, DataFrame], catalog: str, run_id: str) -> None:
    """The keys of a run's sources and items, for later imports to probe."""
    keys = stored_keys.keys_of_sources(tables["question_sources"])
    if "interview_items" in tables:
        keys = keys.unionByName(stored_keys.keys_of_items(tables["interview_items"]))
    stored_keys.write_keys(keys, catalog, run_id)


def committed_keys(spark: SparkSession, catalog: str) -> DataFrame:
    """(key): of the records of completed runs.

    Runs that were written without keys, by hand or before there were any, are
    read from their tables.
    """
    completed = read_table(spark, catalog, "import_runs").filter(F.col("status") == "completed")
    names = sorted({r["id"] for r in completed.select("id").distinct().collect()})  # one per run
    keyed = stored_keys.runs_with_keys(spark, catalog)
    found = stored_keys.stored(spark, catalog, [n for n in names if n in keyed])
    if all(n in keyed for n in names):
        return found

    def others(table: str) -> DataFrame:
        rows = read_table(spark, catalog, table)
        return rows.filter(F.col("import_run").isin([n for n in names if n not in keyed]))

    found = found.unionByName(stored_keys.keys_of_sources(others("question_sources")))
    return found.unionByName(stored_keys.keys_of_items(others("interview_items")))


def asset_completeness(questions: DataFrame, assets: DataFrame) -> DataFrame:
    """A11 on the stored tables: missing required assets of every question.

    One flag per required type is aggregated, so no list of assets is built.
    """
    flags = [
        F.max(F.col("asset_type") == kind).alias(f"_has_{kind}") for kind in S.REQUIRED_ANALYSIS_ASSETS
    ]
    present = assets.groupBy("question_id").agg(*flags)
    absent = [
        F.when(~F.coalesce(F.col(f"_has_{kind}"), F.lit(False)), F.lit(kind))
        for kind in S.REQUIRED_ANALYSIS_ASSETS
    ]
    missing = F.filter(F.array(*absent), lambda m: m.isNotNull())
    return (
        questions.join(present, "question_id", "left")
        .withColumn("missing_assets", missing)
        .withColumn("is_complete", F.size("missing_assets") == 0)
        .drop(*[f"_has_{kind}" for kind in S.REQUIRED_ANALYSIS_ASSETS])
    )
