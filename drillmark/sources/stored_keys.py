"""The keys of stored records, kept so that an import need not shuffle them.

Beside its tables a catalog holds one narrow table of keys: partitioned by run,
bucketed and sorted by key.  A record has a key of its data set and source key, and
one of original id and file name, by which older imports are recognised; an
interview item has its content hash.  An import sends its own keys to the buckets;
the stored side is read bucket by bucket where it lies.  Only keys of completed
runs count, as for all tables; a run written again replaces its keys.
"""

from __future__ import annotations

import hashlib
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drillmark.functions.text import file_name

#: Buckets of a catalog; fixed when its table is made.
BUCKETS = 64

_SEPARATOR = "\u0000"


def source_key(dataset: Column, key: Column) -> Column:
    """Missing parts give no key: they match nothing."""
    return F.concat(F.lit("key" + _SEPARATOR), dataset, F.lit(_SEPARATOR), key)


def legacy_key(dataset: Column, original: Column, file: Column) -> Column:
    name = F.lower(file_name(file))
    return F.concat(F.lit("old" + _SEPARATOR), dataset, F.lit(_SEPARATOR), original, F.lit(_SEPARATOR), name)


def item_key(content_hash: Column) -> Column:
    return F.concat(F.lit("item" + _SEPARATOR), content_hash)


def keys_of_sources(sources: DataFrame) -> DataFrame:
    """(key): of rows of ``question_sources``."""
    keys = F.array(
        source_key(F.col("dataset_name"), F.col("source_key")),
        legacy_key(F.col("dataset_name"), F.col("original_id"), F.col("source_file")),
    )
    return sources.select(F.explode(keys).alias("key")).filter(F.col("key").isNotNull())


def keys_of_items(items: DataFrame) -> DataFrame:
    return items.select(item_key(F.col("content_hash")).alias("key")).filter(F.col("key").isNotNull())


def _table(spark: SparkSession, catalog: str) -> str:
    """The name of the catalog's key table in this session, made known to it if need be."""
    folder = f"{catalog.rstrip('/')}/_keys"
    name = f"stored_keys_{hashlib.sha256(folder.encode()).hexdigest()[:16]}"
    if not spark.catalog.tableExists(name):  # nothing appended makes the folder if there is none
        none = spark.createDataFrame([], "key string, import_run string")
        none.write.mode("append").partitionBy("import_run").parquet(folder)
    place = folder.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (key STRING, import_run STRING) USING parquet "
        f"PARTITIONED BY (import_run) CLUSTERED BY (key) SORTED BY (key) INTO {BUCKETS} BUCKETS LOCATION '{place}'"
    )
    spark.catalog.recoverPartitions(name)
    return name


def write_keys(keys: DataFrame, catalog: str, run_id: str) -> None:
    """The keys of a run, in place of those it wrote before."""
    spark = keys.sparkSession
    name = _table(spark, catalog)
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        # one file per bucket
        rows = keys.distinct().withColumn("import_run", F.lit(run_id)).repartition(BUCKETS, "key")
        rows.write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(setting, before)


def runs_with_keys(spark: SparkSession, catalog: str) -> set[str]:
    """Runs whose keys are in the table: one name per partition."""
    shown = spark.sql(f"SHOW PARTITIONS {_table(spark, catalog)}").collect()
    return {unquote(r["partition"].removeprefix("import_run=")) for r in shown}


def stored(spark: SparkSession, catalog: str, runs: list[str]) -> DataFrame:
    """(key): the keys of the given runs, bucketed."""
    return spark.table(_table(spark, catalog)).filter(F.col("import_run").isin(runs)).select("key")
