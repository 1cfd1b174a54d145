"""Checks of raw files before any row is imported."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillmark.functions.payload import kind
from drillmark.functions.text import has_text, non_empty
from drillmark.sources.readers import list_files, read_lines, read_whole
from drillmark.sources.shipping import ship_by_value
from drillmark.sources.specs import QuestionCorpus

ship_by_value(__name__)


def missing_fields(fields, required):
    """U4: required fields that are not present."""
    return F.array_sort(F.array_except(required, fields))


def _footer_names(path: str) -> list[str] | None:
    """Column names of one parquet file, null when it lacks the magic bytes."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    uri = re.sub(r"^file:/(?!/)", "file:///", path)
    filesystem, local = fs.FileSystem.from_uri(uri)
    with filesystem.open_input_file(local) as stream:
        if stream.read(4) != b"PAR1":
            return None
        return pq.ParquetFile(stream).schema_arrow.names


def _parquet_fields(files: DataFrame) -> DataFrame:
    """Field names per file; the footers are read by the tasks."""

    def footers(batches):
        for batch in batches:
            yield batch.assign(fields=[_footer_names(p) for p in batch["path"]])

    return files.mapInPandas(footers, "path string, fields array<string>")


def inspect_dataset(spark: SparkSession, spec: QuestionCorpus, root: str) -> DataFrame:
    """(path, fields, missing) of every file of a dataset.

    ``fields`` is null for a file of the wrong format or without records.
    """
    required = F.array(*[F.lit(f) for f in spec.files.members])
    pattern = f"{root.rstrip('/')}/{spec.files.place}"
    files = list_files(spark, root, spec.files.place).select("path")
    if spec.files.format == "parquet":
        fields = _parquet_fields(files)
    elif spec.files.format == "jsonl":
        lines = read_lines(spark, pattern).filter(has_text(F.col("value")))
        first = lines.groupBy("source_file").agg(F.min_by("value", "record_index").alias("value"))
        fields = first.select(F.col("source_file").alias("path"), F.json_object_keys("value").alias("fields"))
    elif spec.files.format == "json_array":
        head = F.try_variant_get(F.try_parse_json("value"), "$[0]", "variant")
        keys = F.when(kind(head).startswith("OBJECT"), F.json_object_keys(F.to_json(head)))
        fields = read_whole(spark, pattern).select(F.col("source_file").alias("path"), keys.alias("fields"))
    else:
        raise ValueError(f"No reader for {spec.files.format} files")
    present = F.coalesce("fields", F.array().cast("array<string>"))
    return files.join(fields, "path", "left").select(
        "path", "fields", missing_fields(present, required).alias("missing")
    )


def require_sound(inspected: DataFrame, spec: QuestionCorpus) -> list[str]:
    """Sorted file paths, or an error before any row is read.

    The inspection has one row per file, which is what comes to the driver.
    """
    rows = sorted(inspected.collect(), key=lambda r: r.path)
    if not rows:
        raise FileNotFoundError(f"{spec.short}: nothing at {spec.files.place}")
    for row in rows:
        if row.fields is None:
            raise ValueError(f"{row.path} does not hold {spec.files.format} records")
        if row.missing:
            raise ValueError(f"{row.path} lacks the fields {', '.join(row.missing)}")
    return [row.path for row in rows]


SIDE_CARS = ".cache/huggingface/download"


def revisions(spark: SparkSession, root: str) -> DataFrame:
    """(source_file, source_revision) from the side-car files next to a download.

    ``<a>/.cache/huggingface/download/<rest>.metadata`` describes ``<a>/<rest>``,
    at any depth below the root; its first line is the revision.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        below = reader.load(root).select(
            F.size(F.split(F.regexp_replace("path", r"^[^/]*:(//[^/]*)?", ""), "/")).alias("parts")
        )
        deepest = below.agg(F.max("parts")).first()[0] or 0
        # The hidden folder has to be named: a recursive listing passes it over.  It lies
        # beside or above the files it describes, so no deeper than the deepest of them.
        depth = max(2, deepest - len([p for p in urlsplit(root).path.split("/") if p]) - 1)
        levels = ",".join("*/" * n for n in range(depth + 1))
        cars = reader.option("pathGlobFilter", "*.metadata").load(f"{root.rstrip('/')}/{{{levels}}}{SIDE_CARS}")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "source_file string, source_revision string")
    text = F.decode("content", "UTF-8")
    first = F.trim(F.split(text, r"\r\n|[\n\r]", 2).getItem(0))
    path = F.regexp_replace("path", r"/\.cache/huggingface/download/(.*)\.metadata$", "/$1")
    return (
        cars.select(path.alias("source_file"), first.alias("source_revision"))
        .withColumn("source_revision", non_empty(F.col("source_revision")))
    )


def with_revisions(records: DataFrame, known: DataFrame) -> DataFrame:
    """Records with the revision of their file, null when there is none.

    ``known`` has one row per downloaded file, its size is left to the optimizer.
    """
    return records.join(known, "source_file", "left")
