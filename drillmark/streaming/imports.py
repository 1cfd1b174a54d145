"""JSON-lines drops imported as they arrive, through the same idempotent sink.

The import contract (a record already stored is skipped) makes a micro-batch
safe to repeat: its run id comes from the batch number, so a batch replayed
after a lost driver replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from drillmark.functions.text import relative_path
from drillmark.plans.ingest import audited, import_records
from drillmark.sources.readers import parse_json_lines
from drillmark.sources.specs import QuestionCorpus


def import_batch(batch: DataFrame, spec: QuestionCorpus, root: str, catalog: str, run_id: str) -> None:
    """Import one micro-batch of (value, source_file) lines; a failure stops the stream.

    A line's number is not known here.  A number made from its file and text
    stands for it: records without an id stay apart, and a batch that is
    replayed finds the same keys.
    """
    spark = batch.sparkSession
    place = F.xxhash64("source_file", "value").bitwiseAND(F.lit((1 << 63) - 1))
    lines = batch.withColumns({"record_index": place, "source_revision": F.lit(None).cast("string")})
    raw = parse_json_lines(lines).withColumn("source_file", relative_path(F.col("source_file"), root))
    result = audited(
        spark,
        catalog,
        run_id,
        spec.name,
        lambda: import_records(spark, raw, spec, catalog, run_id),
    )
    if result["status"] == "failed":
        raise RuntimeError(f"{run_id}: {result['error']}")


def start_import(
    spark: SparkSession, spec: QuestionCorpus, root: str, catalog: str, checkpoint: str, name: str
) -> StreamingQuery:
    """Watch a JSON-lines dataset."""
    files = spark.readStream.text(f"{root.rstrip('/')}/{spec.files.place}").select(
        "value", F.col("_metadata.file_path").alias("source_file")
    )

    def write(batch: DataFrame, number: int) -> None:
        import_batch(batch, spec, root, catalog, f"{name}-{number:09d}")

    return (
        files.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
