"""Scans of raw source files, with file, record index and reject flag."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drillmark.functions.payload import kind
from drillmark.functions.text import has_text
from drillmark.operators.barrier import once
from drillmark.operators.sections import numbered_lines
from drillmark.sources.arrays import read_array_elements
from drillmark.sources.shipping import ship_by_value

ship_by_value(__name__)

# Up to this many (file, split) pairs the split table is broadcast: about 20 MB.
MAX_BROADCAST_SPLITS = 100_000


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """Lines of text files as (source_file, record_index, value).

    ``record_index`` is the physical 0-based line number.  A file may be read as
    many splits: each split counts its own lines, and a line's number is its
    place in the split plus the lines of the splits before it.  The split table
    has one row per split.  The file listing bounds its size, and within the
    bound the lines themselves are never shuffled.
    """
    text = spark.read.text(paths)
    most_splits = len(text.inputFiles()) + text.rdd.getNumPartitions()
    raw = text.select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"),
    )
    per_file = Window.partitionBy("source_file").orderBy("_split")
    splits = (
        raw.groupBy("source_file", "_split")
        .agg(F.count("*").alias("_lines"), F.min("_row").alias("_first"))
        .select(
            "source_file",
            "_split",
            "_first",
            (F.sum("_lines").over(per_file) - F.col("_lines")).alias("_before"),
        )
    )
    if most_splits <= MAX_BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    return raw.join(splits, ["source_file", "_split"]).select(
        "source_file",
        (F.col("_row") - F.col("_first") + F.col("_before")).alias("record_index"),
        "value",
    )


def parse_json_lines(lines: DataFrame) -> DataFrame:
    """JSON lines as a VARIANT ``record``; blank lines go, bad ones are flagged."""
    filled = lines.filter(has_text(F.col("value")))
    parsed = once(filled, "record", F.try_parse_json("value")).drop("value")
    return _flag_rejects(parsed)


def _flag_rejects(parsed: DataFrame) -> DataFrame:
    usable = F.coalesce(kind(F.col("record")).startswith("OBJECT"), F.lit(False))
    return parsed.withColumn("rejected", ~usable)


def read_json_lines(spark: SparkSession, paths) -> DataFrame:
    return parse_json_lines(read_lines(spark, paths))


def parse_elements(elements: DataFrame) -> DataFrame:
    """Array elements (source_file, record_index, value) as VARIANT records,
    non-objects flagged.  An element that is no JSON stops the job: no file counts
    as read that lost a record."""
    # as an array of one: what follows a value would otherwise not be looked at
    parsed = F.coalesce(
        F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))), "$[0]", "variant"),
        F.raise_error(F.concat(F.lit("Not readable as one JSON array: "), F.col("source_file"))).cast("variant"),
    )
    return _flag_rejects(once(elements, "record", parsed).select("source_file", "record_index", "record"))


def read_whole(spark: SparkSession, paths, pattern: str | None = None) -> DataFrame:
    """Whole text files as (source_file, value); with a pattern, all files
    below the folder whose name matches it, at any depth."""
    reader = spark.read
    if pattern is not None:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    files = reader.text(paths, wholetext=True)
    if pattern is not None and not files.inputFiles():
        raise FileNotFoundError(f"no {pattern} below {paths}")
    return files.select(
        F.col("_metadata.file_path").alias("source_file"), "value"
    )


def read_json_array(spark: SparkSession, paths) -> DataFrame:
    """Elements of JSON-array files of any size, element index kept."""
    return parse_elements(read_array_elements(spark, paths))


def read_markdown_lines(spark: SparkSession, paths) -> DataFrame:
    """Numbered lines of Markdown files."""
    return numbered_lines(read_whole(spark, paths), "value", ["source_file"])


def read_parquet_records(spark: SparkSession, paths, columns=None) -> DataFrame:
    """Parquet rows with file and row index; only ``columns`` are read.

    ``_metadata.row_index`` is the row's place in its file, so no window and no
    shuffle is needed.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.parquet(*paths)
    kept = df.columns if columns is None else [c for c in columns if c in df.columns]
    return df.select(
        *kept,
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.row_index").alias("record_index"),
    )


def as_variant(df: DataFrame, meta=("source_file", "record_index", "source_revision")) -> DataFrame:
    """Typed rows as a VARIANT ``record`` beside their file and index."""
    kept = [c for c in meta if c in df.columns]
    fields = [c for c in df.columns if c not in kept]
    return df.select(
        *kept,
        F.to_variant_object(F.struct(*fields)).alias("record"),
        F.lit(False).alias("rejected"),
    )


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files below the root that match the pattern: (path, length).

    Only the listing is read; the content column is pruned.
    """
    return spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{pattern}").select("path", "length")


# The binary reader holds one file in one row; larger files are streamed.
READER_LIMIT_BYTES = 2_000_000_000
STREAM_CHUNK_BYTES = 8 * 1024 * 1024


def file_manifest(
    spark: SparkSession, root: str, pattern: str = "*", whole_below: int = READER_LIMIT_BYTES
) -> DataFrame:
    """Bytes and sha-256 of each file, of any size.

    Files below ``whole_below`` bytes are read by Spark's binary reader, others
    chunk by chunk in a task.  Both give the digest of all bytes.  Spark's reader
    passes over empty files, so they are not in the manifest.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    size = F.col("length").alias("bytes")
    small = files.filter(F.col("length") < whole_below).select("path", size, F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") >= whole_below).select("path", size)
    # A fixed number of tasks: the rows are tiny, so adaptive execution would put all files in one.
    spread = large.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return small.unionByName(spread.mapInArrow(_streamed_digests, "path string, bytes long, sha256 string"))


def _address(path: str) -> str:
    """The URI of a path as Spark names it: without escapes, local ones with a single slash."""
    scheme, _, rest = path.partition(":")
    return f"{scheme}:{quote(rest)}" if rest.startswith("//") else f"{scheme}://{quote(rest)}"


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the digest of each named file, reading one chunk at a time."""
    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            system, place = fs.FileSystem.from_uri(_address(path))
            digest = hashlib.sha256()
            with system.open_input_stream(place) as stream:
                while chunk := stream.read(STREAM_CHUNK_BYTES):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield batch.append_column("sha256", pa.array(digests, pa.string()))


def source_manifest(files: DataFrame, policy: DataFrame, revisions: dict[str, str]) -> DataFrame:
    """A manifest with each file's source, revision, licence and decision.

    The source is the first folder of the path.  ``policy`` has a few rows.
    Files of a source the policy does not know are not imported.
    """
    known = F.create_map(*[F.lit(x) for pair in revisions.items() for x in pair]) if revisions else None
    revision = F.lit(None).cast("string") if known is None else F.try_element_at(known, F.col("source"))
    allowed = F.coalesce(F.col("ingestion_allowed"), F.lit(False))
    rules = F.broadcast(policy.select("source", "license", "ingestion_allowed"))
    return (
        files.withColumn("source", F.substring_index("path", "/", 1))
        .join(rules, "source", "left")
        .select(
            "path", "bytes", "sha256", "source", revision.alias("revision"), "license",
            F.when(allowed, "import").otherwise("raw-only").alias("decision"),
        )
    )


def manifest_of(records: DataFrame, path: str, content: str) -> DataFrame:
    """The same manifest for contents held in a table."""
    body = F.encode(F.col(content), "UTF-8")
    return records.select(
        F.col(path).alias("path"),
        F.octet_length(body).cast("long").alias("bytes"),
        F.sha2(body, 256).alias("sha256"),
    )
