"""Readers, inspection, normalisers and the import run, on small files."""

import io
import json
import tarfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from drillmark.plans import ingest
from drillmark.plans.validation import table_report
from drillmark.sources import interviews, readers, sinks
from drillmark.sources.archives import decode_archives
from drillmark.sources.inspection import SIDE_CARS, inspect_dataset, require_sound, revisions
from drillmark.sources.literals import json_or_literal
from drillmark.sources.specs import allowed_only, choose, policy_frame
from drillmark.streaming.imports import import_batch, start_import


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    if isinstance(content, bytes):
        path.write_bytes(content)
    else:
        path.write_text(content, encoding="utf-8")
    return path


def json_lines(*records):
    return "\n".join(json.dumps(r) for r in records) + "\n"


def archive(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


TASK = {
    "instruction.md": b"# Sum two\nAdd the numbers.",
    "task.toml": b'[metadata]\ndifficulty = "very_hard"\ntags = ["math"]\n',
    "tests/test_data.json": json.dumps({"inputs": list(range(12)), "outputs": list(range(12))}).encode(),
}


# --- Readers -----------------------------------------------------------------


def test_line_numbers_hold_over_many_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 90) if i % 7 else "" for i in range(4000)]
    write(tmp_path / "a.txt", "\n".join(lines) + "\n")
    write(tmp_path / "b.txt", "only\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        df = readers.read_lines(spark, str(tmp_path))
        rows = df.collect()
        splits = spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert splits > 5
    got = sorted((r.record_index, r.value) for r in rows if r.source_file.endswith("a.txt"))
    assert got == list(enumerate(lines))
    assert [r.record_index for r in rows if r.source_file.endswith("b.txt")] == [0]


def test_json_lines_skip_blank_and_flag_bad(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"a": 1}\n\n   \nnot json\n[1]\n{"a": 2}\n')
    rows = readers.read_json_lines(spark, str(path)).collect()
    assert {(r.record_index, r.rejected) for r in rows} == {(0, False), (3, True), (4, True), (5, False)}


def test_markdown_lines_are_numbered_per_file(spark, tmp_path):
    write(tmp_path / "a.md", "# A\n\n- b\n")
    write(tmp_path / "c.md", "only")
    rows = readers.read_markdown_lines(spark, str(tmp_path)).collect()
    got = {(r.source_file.rsplit("/", 1)[1], r.line_no, r.line) for r in rows}
    assert got == {("a.md", 0, "# A"), ("a.md", 1, ""), ("a.md", 2, "- b"), ("c.md", 0, "only")}


def test_json_array_keeps_the_index(spark, tmp_path):
    path = write(tmp_path / "a.json", json.dumps([{"q": 1}, 5, {"q": 2}], indent=1))
    rows = readers.read_json_array(spark, str(path)).collect()
    assert {(r.record_index, r.rejected) for r in rows} == {(0, False), (1, True), (2, False)}


def test_parquet_reader_prunes_columns(spark, tmp_path):
    path = str(tmp_path / "a.parquet")
    pq.write_table(pa.table({"path": ["a", "b"], "task_binary": [b"1", b"2"], "unwanted": ["x", "y"]}), path)
    df = readers.read_parquet_records(spark, path, ["path", "task_binary"])
    assert {(r.path, r.record_index) for r in df.collect()} == {("a", 0), ("b", 1)}
    assert "unwanted" not in df._jdf.queryExecution().executedPlan().toString()


def test_an_unreadable_json_array_stops_the_job(spark, tmp_path):
    for name, text in (("cut.json", '[{"a": 1}, {"a"'), ("object.json", '{"a": 1}')):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="Not readable as one JSON array"):
            readers.read_json_array(spark, str(tmp_path / name)).collect()


def test_archives_report_errors_as_rows(spark):
    rows = [
        ("good", archive(TASK)),
        ("empty", None),
        ("broken", b"junk"),
        ("no tests", archive({k: v for k, v in TASK.items() if "tests" not in k})),
        ("too long", archive({**TASK, "instruction.md": b"x" * 2_000_001})),
    ]
    df = spark.createDataFrame(rows, "path string, task_binary binary")
    got = {r.path: r for r in decode_archives(df).collect()}
    assert got["good"].error is None and got["good"].tags == ["math"]
    assert got["good"].instruction.startswith("# Sum two")
    for name in ("empty", "broken", "no tests", "too long"):
        assert got[name].error and got[name].instruction is None


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("['Graph', 'DP']", ["Graph", "DP"]),
        ('["a", "b"]', ["a", "b"]),
        ("['it\\'s',]", ["it's"]),
        ("{'inputs': [(1, 2)]}", {"inputs": [[1, 2]]}),
        ("__import__('os')", None),
        ("('a',)", None),
        (None, None),
    ],
)
def test_json_or_literal(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "v string")
    got = df.select(F.to_json(json_or_literal(F.col("v"))).alias("j")).first().j
    assert (json.loads(got) if got else None) == expected


def test_manifest(spark, tmp_path):
    import hashlib

    write(tmp_path / "a" / "x.md", "hello")
    row = readers.file_manifest(spark, str(tmp_path), "*.md").first()
    assert row.bytes == 5 and row.sha256 == hashlib.sha256(b"hello").hexdigest()
    write(tmp_path / "a" / "an odd%20name#1.md", "odd")
    write(tmp_path / "a" / "long.md", "x" * 20_000_000)
    whole, streamed = (
        sorted(map(tuple, readers.file_manifest(spark, str(tmp_path), whole_below=n).collect())) for n in (10**9, 0)
    )
    assert len(whole) == 3 and whole == streamed


def test_digest_of_a_file_beyond_the_binary_reader(spark, tmp_path):
    import hashlib

    size = 3_000_000_000
    with open(tmp_path / "big.bin", "wb") as out:
        out.truncate(size)  # a sparse file takes no disk
    digest = hashlib.sha256()
    zeros = bytes(10_000_000)
    for _ in range(size // len(zeros)):
        digest.update(zeros)
    (row,) = readers.file_manifest(spark, str(tmp_path)).collect()
    assert (row.bytes, row.sha256) == (size, digest.hexdigest())


# --- Inspection --------------------------------------------------------------

LEET = "algorithm_problems/LeetCodeDataset/a.jsonl"


def test_inspection_errors(spark, tmp_path):
    leet, taco, sqlctx = choose(["leetcode", "TACO", "sqlctx"])
    write(tmp_path / LEET, '\n{"id": 1}\n')
    found = inspect_dataset(spark, leet, str(tmp_path))
    assert found.first().missing == ["problem_description", "task_id"]
    with pytest.raises(ValueError, match="lacks the fields"):
        require_sound(found, leet)
    write(tmp_path / "algorithm_problems/TACO/ALL/a.parquet", b"not parquet")
    with pytest.raises(ValueError, match="does not hold parquet"):
        require_sound(inspect_dataset(spark, taco, str(tmp_path)), taco)
    write(tmp_path / sqlctx.files.place, "[]")
    with pytest.raises(ValueError, match="does not hold json_array"):
        require_sound(inspect_dataset(spark, sqlctx, str(tmp_path)), sqlctx)


def test_revisions(spark, tmp_path):
    base = tmp_path / "algorithm_problems/apps"
    write(base / ".cache/huggingface/download/train.jsonl.metadata", " abc123 \netag\n")
    got = {r.source_file.rsplit("/", 1)[1]: r.source_revision for r in revisions(spark, str(tmp_path)).collect()}
    assert got == {"train.jsonl": "abc123"}
    for folder in ("", "a/", "a/b/c/", "a/b/c/d/e/"):
        write(tmp_path / f"{folder}sub/deep.jsonl", "{}")
        write(tmp_path / f"{folder}{SIDE_CARS}/sub/deep.jsonl.metadata", f"r{len(folder)}\n")
    found = {r.source_file.split(str(tmp_path))[1]: r.source_revision for r in revisions(spark, str(tmp_path)).collect()}
    assert found == {
        "/algorithm_problems/apps/train.jsonl": "abc123",
        "/sub/deep.jsonl": "r0",
        "/a/sub/deep.jsonl": "r2",
        "/a/b/c/sub/deep.jsonl": "r6",
        "/a/b/c/d/e/sub/deep.jsonl": "r10",
    }
    assert revisions(spark, str(tmp_path / "absent")).count() == 0


# --- Import runs -------------------------------------------------------------


def counts(results):
    return [(r["imported"], r["skipped"], r["status"]) for r in results]


def test_unknown_and_repeated_datasets():
    with pytest.raises(ValueError, match="No dataset is called"):
        choose(["nothing"])
    assert [s.short for s in choose(["taco", "TACO", "apps"])] == ["taco", "apps"]


def test_import_twice_skips_everything(spark, tmp_path):
    root, catalog = str(tmp_path / "data"), str(tmp_path / "catalog")
    record = {
        "task_id": "two-sum",
        "problem_description": "Find two numbers.",
        "difficulty": "easy",
        "tags": ["array"],
        "starter_code": "def f(): pass",
        "completion": "return 1",
        "input_output": [{"input": "1", "output": "2"}],
    }
    write(tmp_path / "data" / LEET, json_lines(record) + "\nbad line\n" + json_lines({"task_id": "x", "problem_description": ""}))
    assert counts(ingest.run_import(spark, root, catalog, "r1", ["leetcode"])) == [(1, 2, "completed")]
    assert counts(ingest.run_import(spark, root, catalog, "r2", ["leetcode"])) == [(0, 3, "completed")]
    names = ("import_runs", "question_sources", "questions", "question_assets", "reference_solutions")
    report = table_report({n: sinks.read_committed(spark, catalog, n) for n in names}).collect()
    assert len(report) == 8 and all(r.breaches == 0 for r in report)

    def table(name):
        return sinks.read_committed(spark, catalog, name).collect()

    (question,) = table("questions")
    assert (question.title, question.difficulty, question.question_type) == ("Two Sum", "Easy", "algorithm")
    assert question.supported_methods == ["python", "javascript/typescript", "java", "cpp"]
    (source,) = table("question_sources")
    assert source.id == question.source_id and source.source_file == LEET
    assert source.source_record_index == 0 and source.license == "Apache-2.0"
    (case,) = table("question_test_cases")
    assert (case.question_id, case.input_data, case.expected_output) == (question.id, '"1"', '"2"')
    assert len(table("question_assets")) == len(table("reference_solutions")) == 1


def test_same_id_in_two_files_is_two_questions(spark, tmp_path):
    root, catalog = str(tmp_path / "data"), str(tmp_path / "catalog")
    base = tmp_path / "data/algorithm_problems/apps"
    for name in ("train", "test"):
        write(
            base / f"{name}.jsonl",
            json_lines(
                {
                    "id": 1,
                    "question": f"Solve {name}",
                    "difficulty": "interview",
                    "solutions": json.dumps(["a", " ", "b", "c"]),
                    "input_output": json.dumps({"inputs": ["1", "2"], "outputs": ["3"]}),
                }
            ),
        )
        write(base / f".cache/huggingface/download/{name}.jsonl.metadata", f"rev-{name}\n")
    assert counts(ingest.run_import(spark, root, catalog, "r1", ["apps"])) == [(2, 0, "completed")]
    assert counts(ingest.run_import(spark, root, catalog, "r2", ["apps"])) == [(0, 2, "completed")]
    sources = sinks.read_committed(spark, catalog, "question_sources").collect()
    assert {s.source_revision for s in sources} == {"rev-train", "rev-test"}
    solutions = sinks.read_committed(spark, catalog, "reference_solutions").collect()
    assert sorted(s.code for s in solutions) == ["a", "a", "b", "b", "c", "c"]
    assert sinks.read_committed(spark, catalog, "question_test_cases").count() == 2


def test_parquet_sets(spark, tmp_path):
    root, catalog = str(tmp_path / "data"), str(tmp_path / "catalog")
    taco = tmp_path / "data/algorithm_problems/TACO/ALL"
    querypls = tmp_path / "data/data_analysis_problems/querypls-prompt2sql-dataset/data"
    contests = tmp_path / "data/algorithm_problems/CodeContests"
    for folder in (taco, querypls, contests):
        folder.mkdir(parents=True)
    pq.write_table(
        pa.table(
            {
                "url": ["http://x/1"],
                "question": ["Do it"],
                "name": ["Named"],
                "difficulty": ["VERY_HARD"],
                "tags": ["['Graph', 'DP']"],
                "starter_code": ["x = 1"],
                "input_output": ['{"inputs": [1], "outputs": [2]}'],
                "solutions": ['["s"]'],
            }
        ),
        taco / "a.parquet",
    )
    split = pa.table({"context": ["CREATE TABLE t"], "answer": ["SELECT 1"], "autotrain_text": ["Count"]})
    pq.write_table(split, querypls / "train.parquet")
    pq.write_table(split, querypls / "validation.parquet")
    pq.write_table(pa.table({"path": ["t1", "t2"], "task_binary": [archive(TASK), b"bad"]}), contests / "tasks.parquet")
    results = ingest.run_import(spark, root, catalog, "r1", ["taco", "querypls", "codecontests", "spider"])
    assert counts(results)[:3] == [(1, 0, "completed"), (1, 1, "completed"), (1, 1, "completed")]
    assert results[3]["status"] == "failed" and results[3]["error"]
    by_title = {q.title: q for q in sinks.read_committed(spark, catalog, "questions").collect()}
    assert by_title["Named"].difficulty == "Very Hard" and by_title["Named"].tags == ["Graph", "DP"]
    assert by_title["Sum two"].difficulty == "Very Hard"
    assert by_title["SQL: Count"].is_complete is False
    assert by_title["SQL: Count"].supported_methods == ["sql", "pandas", "pyspark", "polars"]
    runs = {r.dataset_name: r.status for r in sinks.read_table(spark, catalog, "import_runs").collect()}
    assert runs["spider"] == "failed" and runs["TACO"] == "completed"


def test_unfinished_runs_are_invisible(spark, tmp_path):
    root, catalog = str(tmp_path / "data"), str(tmp_path / "catalog")
    write(tmp_path / "data" / LEET, json_lines({"task_id": "a", "problem_description": "b"}))
    (spec,) = choose(["leetcode"])
    ingest.import_questions(spark, spec, root, catalog, "died")  # no audit row was written
    assert sinks.read_committed(spark, catalog, "questions").count() == 0
    assert counts(ingest.run_import(spark, root, catalog, "r1", ["leetcode"])) == [(1, 0, "completed")]
    assert sinks.read_committed(spark, catalog, "questions").count() == 1


def test_repeating_a_run_replaces_its_rows(spark, tmp_path):
    root, catalog = str(tmp_path / "data"), str(tmp_path / "catalog")
    write(tmp_path / "data" / LEET, json_lines({"task_id": "a", "problem_description": "b"}))
    for _ in range(2):
        assert counts(ingest.run_import(spark, root, catalog, "r1", ["leetcode"])) == [(1, 0, "completed")]
        assert sinks.read_committed(spark, catalog, "questions").count() == 1
    (spec,) = choose(["leetcode"])
    batch = spark.createDataFrame(
        [(json.dumps({"task_id": "z", "problem_description": "p"}), "x.jsonl")], "value string, source_file string"
    )
    for _ in range(2):  # a micro-batch replayed after a lost driver
        import_batch(batch, spec, root, catalog, "drops-000000007")
        assert sinks.read_committed(spark, catalog, "questions").count() == 2


def test_streamed_records_without_an_id_stay_apart(spark, tmp_path):
    catalog = str(tmp_path / "catalog")
    (spec,) = choose(["apps"])
    rows = [(json.dumps({"question": f"q{k % 5}"}), "train.jsonl") for k in range(6)]
    batch = spark.createDataFrame(rows, "value string, source_file string")
    for _ in range(2):
        import_batch(batch, spec, str(tmp_path), catalog, "drops-000000001")
        keys = [r.source_key for r in sinks.read_committed(spark, catalog, "question_sources").collect()]
        assert len(keys) == len(set(keys)) == 5


def test_selected_sections(spark, tmp_path):
    write(tmp_path / "05-behavioral.md", "## Common Behavioral Questions\n- Tell me about a conflict\n")
    write(tmp_path / "notes.md", "## Questions\n- What is not selected?\n")
    (row,) = ingest.selected_sections(spark, str(tmp_path), "run", "rev").collect()
    assert (row.prompt, row.prompt_style, row.source.source_revision) == ("Tell me about a conflict", "scenario", "rev")


def test_streaming_import_is_idempotent(spark, tmp_path):
    root, catalog = str(tmp_path / "data"), str(tmp_path / "catalog")
    (spec,) = choose(["leetcode"])

    def run():
        query = start_import(spark, spec, root, catalog, str(tmp_path / "checkpoint"), "drops")
        query.awaitTermination(120)

    write(tmp_path / "data/algorithm_problems/LeetCodeDataset/a.jsonl", json_lines({"task_id": "a", "problem_description": "p"}))
    run()
    write(
        tmp_path / "data/algorithm_problems/LeetCodeDataset/b.jsonl",
        json_lines({"task_id": "a", "problem_description": "p"}, {"task_id": "b", "problem_description": "q"}),
    )
    run()
    rows = sinks.read_committed(spark, catalog, "question_sources").collect()
    assert sorted(r.original_id for r in rows) == ["a", "b"]


# --- Interview sources -------------------------------------------------------


def files(spark, path, value):
    return spark.createDataFrame([(path, "r", value)], "source_file string, source_revision string, value string")


def test_interview_json(spark, tmp_path):
    path = write(
        tmp_path / "questions.json",
        json.dumps(
            [
                {"question": " What? ", "answer": ["a", "b"], "expertise": 2, "tags": ["js"]},
                {"question": "", "answer": "x"},
                {"question": "Why?", "answer": "because", "expertise": 9},
            ]
        ),
    )
    raw = readers.read_json_array(spark, str(path)).withColumn("source_revision", F.lit("r"))
    rows = interviews.interview_json(raw, "run").collect()
    got = [(r.prompt, r.reference_answer, r.difficulty, r.topic, r.source.source_record_index) for r in rows]
    assert got == [("What?", "a\n\nb", "Hard", "js", 0), ("Why?", "because", "Medium", "general", 2)]


def test_qa_markdown(spark):
    value = "\n".join(
        [
            "- [Navigation](#x)",
            "### LLM Fundamentals",
            "- What is a [token](u)?",
            "    - Answer: [Blog](http://b)",
            "- short",
            "    - Answer: lost",
            "- Your team ships a model. What now?",
            "### Unlisted",
            "- Never taken at all?",
        ]
    )
    rows = interviews.qa_markdown(files(spark, "README.md", value), "run").orderBy("source.source_record_index").collect()
    assert [(r.prompt, r.reference_answer, r.prompt_style) for r in rows] == [
        ("What is a token?", "Blog (http://b)", "direct"),
        ("Your team ships a model. What now?", None, "scenario"),
    ]
    assert rows[0].source.source_record_index == 2 and rows[0].topic == "LLM Fundamentals"


def test_section_markdown(spark):
    value = "\n".join(
        [
            "## LLM Practice",
            "- How do you cut   cost?[^1]",
            "## Interview Advice",
            "- How to dress well",
            "## Other",
            "### RAG Systems",
            "- Design a retriever",
            "## Sources",
            "- How this was found",
        ]
    )
    rows = interviews.section_markdown(files(spark, "q/01-theory.md", value), "run").orderBy("source.source_record_index").collect()
    assert [(r.prompt, r.topic, r.prompt_style, r.answer_format) for r in rows] == [
        ("How do you cut cost?", "LLM Practice", "direct", "theory"),
        ("Design a retriever", "RAG Systems", "scenario", "theory"),
    ]
    home = "## Assignment Examples\n- Build a chat service\n### Evaluation Criteria Found in Assignments\n- Keep the code tidy"
    (row,) = interviews.section_markdown(files(spark, "06-home-assignments.md", home), "run").collect()
    assert (row.prompt, row.answer_format, row.prompt_style) == ("Build a chat service", "coding", "scenario")
    assert row.source.original_id == "06-home-assignments:1"


def test_interview_import_by_policy_and_content(spark, tmp_path):
    root, catalog = tmp_path / "raw", str(tmp_path / "catalog")
    write(root / "30-seconds-of-interviews/data/questions.json", json.dumps([{"question": "What is CSS used for?", "answer": "style"}]))
    write(root / "ai-engineering-interview-questions/README.md", "### Multimodal AI\n- What is a vision encoder?\n")
    for key in ("data-science-interviews", "interview-questions", "tech-interview-handbook"):
        write(root / key / "README.md", "1. What does nobody read here?\n")
        write(root / key / "some-notes.md", "## Basics\n1. **What is a hash join?**\n2. too short?\n")
    records = ingest.interview_records(spark, str(root), "run", {"interview-questions": "rev"})
    assert set(records) == {
        "30-seconds-of-interviews",
        "ai-engineering-interview-questions",
        "data-science-interviews",
        "interview-questions",
        "tech-interview-handbook",
    }
    (generic,) = records["interview-questions"]().collect()
    assert (generic.topic, generic.prompt, generic.source.source_revision) == ("Basics", "What is a hash join?", "rev")
    first = ingest.run_interview_import(spark, str(root), catalog, "i1", {})
    assert {r["dataset_name"]: (r["imported"], r["skipped"]) for r in first} == dict.fromkeys(records, (1, 0))
    again = ingest.run_interview_import(spark, str(root), catalog, "i2", {})
    assert all((r["imported"], r["skipped"]) == (0, 1) for r in again)
    stored = sinks.read_committed(spark, catalog, "interview_items").collect()
    assert {(r.prompt, r.is_complete) for r in stored} == {
        ("What is CSS used for?", True),
        ("What is a vision encoder?", False),
        ("What is a hash join?", False),
    }
    # The same prompt counts once per domain.
    assert len(stored) == 5 and len({r.content_hash for r in stored}) == 5

    items = records["interview-questions"]()
    other = str(tmp_path / "other")
    doubled = items.unionByName(items)
    assert ingest.import_items(spark, doubled, other, "x") == (1, 1)
    (root / "interview-questions/some-notes.md").unlink()
    (root / "interview-questions/README.md").unlink()
    failed = ingest.run_interview_import(spark, str(root), catalog, "i3", {})
    assert {r["dataset_name"]: r["status"] for r in failed}["interview-questions"] == "failed"


def test_license_gate(spark):
    records = spark.createDataFrame([("interview-questions",), ("system-design",)], "source string")
    assert [r.source for r in allowed_only(records, policy_frame(spark)).collect()] == ["interview-questions"]


def test_generation_rows_once_per_item(spark):
    rows = [("i1", 1, ["http://a"]), ("i1", 2, []), ("i2", 3, []), ("i3", 4, [])]
    inserted = spark.createDataFrame(rows, "id string, request_id int, web_sources array<string>").withColumns(
        {"provider": F.lit("p"), "model_id": F.lit("m"), "prompt_version": F.lit("v")}
    )
    stored = spark.createDataFrame([("i3",)], "interview_item_id string")
    got = {(r.interview_item_id, r.origin) for r in sinks.generation_rows(inserted, stored).collect()}
    assert got == {("i1", "web"), ("i2", "ai")}


def test_all_tables_are_known(spark, tmp_path):
    from drillmark import schemas as S

    assert len(S.TABLES) == 18
    for name in S.TABLES:
        assert sinks.read_table(spark, str(tmp_path), name).count() == 0


def test_sessions_and_turns_are_stored_and_scored(spark, tmp_path):
    """A session's turns go through the sink and come back for scoring."""
    from drillmark import schemas as S
    from drillmark.plans import practice

    catalog = str(tmp_path)
    turn = ("s", 1, "i1", "Why?", None, None, None, None, None, None, [], "pending", None, "theory", None)
    turns = spark.createDataFrame([turn], S.TABLES["interview_turns"])
    sinks.append_rows(turns, catalog, "interview_turns", "b1")
    stored = sinks.read_table(spark, catalog, "interview_turns").drop("import_run")
    assert stored.schema == S.TABLES["interview_turns"]
    answers = spark.createDataFrame(
        [("s", "i1", "Because.", 70.0, None)],
        "session_id string, item_id string, answer string, assessed_score double, answered_at timestamp",
    )
    row = practice.submit_answers(stored, answers).first()
    assert (row.status, row.score, row.answer_text) == ("scored", 70.0, "Because.")
    assert practice.adaptive_context(practice.submit_answers(stored, answers)).count() == 1


def test_appended_batches_replace_themselves(spark, tmp_path):
    catalog = str(tmp_path)
    batch = spark.createDataFrame([("a",)], "id string")
    for _ in range(2):
        sinks.append_rows(batch, catalog, "attempts", "b1")
    assert sinks.read_table(spark, catalog, "attempts").count() == 1
    sinks.append_rows(batch, catalog, "attempts", "b2")
    assert sinks.read_committed(spark, catalog, "attempts").count() == 2
    audit = sinks.read_table(spark, catalog, "import_runs").collect()
    assert sorted((r.id, r.dataset_name, r.status, r.records_imported) for r in audit) == [
        ("b1", "attempts", "completed", 1),
        ("b2", "attempts", "completed", 1),
    ]


def test_child_ids_never_repeat_and_keep_the_order(spark):
    places = [0, 7, 999_999, 1_000_000, 1_000_005, 12_345_678]
    table = spark.createDataFrame([(p,) for p in places], "place long")
    ids = [r.id for r in table.select(sinks._child_id(F.lit("q"), F.col("place")).alias("id")).collect()]
    assert ids == sorted(set(ids)) and ids[0] == "q-000000"


def test_markdown_is_read_at_any_depth(spark, tmp_path):
    from drillmark.sources.readers import read_whole

    for name in ("a.md", "sub/b.md", "sub/deep/c.md", "sub/d.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    assert sorted(r.value for r in read_whole(spark, str(tmp_path), "*.md").collect()) == ["a.md", "sub/b.md", "sub/deep/c.md"]


def test_a_moved_file_is_a_legacy_source_but_other_files_are_not(spark):
    """The stored import of a file hides its record, not the same key from another file."""
    from drillmark import schemas as S

    def record(key, file, index):
        source = ("set", key, file, "7", None, index, None, "a", "r", "7")
        return ("t", "essay", "Easy", "text", None, None, [], [], source, [], [], [], True)

    rows = [record("k", "new/place/old.jsonl", 0), record("k", "new/place/other.jsonl", 0)]
    incoming = spark.createDataFrame(rows, S.NORMALISED_QUESTION)
    stored = spark.createDataFrame(
        [("set", "legacy:1", "7", "C:\\data\\OLD.jsonl")],
        "dataset_name string, source_key string, original_id string, source_file string",
    )
    (row,) = sinks.new_questions(incoming, stored).collect()
    assert row.source.source_file == "new/place/other.jsonl"
