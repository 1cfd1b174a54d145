"""Order-dependent operators that keep working when one key is very large.

Two shapes cover everything the engine needs:

* *keep a few rows per key*: ``row_number() <= n``.  Spark prunes each map task
  to ``n`` rows per key before the shuffle (WindowGroupLimit), so a key with a
  third of the table still sends only ``n`` rows per task.
* *number all rows of a key*: the key is cut into ordered blocks, rows are
  numbered inside their block, and the counts of the earlier blocks are added.
  No task ever sorts a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drillmark.operators.joins import spread_join


def top_per_key(df: DataFrame, keys, order, n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key, with their 1-based rank."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """First row of each key, first-wins de-duplication."""
    return top_per_key(df, keys, order, 1, "_first").drop("_first")


def latest_per_key(df: DataFrame, keys, order, columns) -> DataFrame:
    """The given columns of the greatest row of each key.

    An aggregate on one struct, so every map task sends one row per key.
    ``order`` names columns compared ascending; the greatest tuple wins.
    """
    best = F.max(F.struct(*order, *[c for c in columns if c not in order]))
    return df.groupBy(*keys).agg(best.alias("_best")).select(
        *keys, *[F.col(f"_best.{c}").alias(c) for c in columns]
    )


def block_sizes(df: DataFrame, keys, block: str) -> DataFrame:
    """Rows per (key, block), rows in the earlier blocks and in the whole key."""
    sizes = df.groupBy(*keys, block).agg(F.count("*").alias("_rows"))
    per_key = Window.partitionBy(*keys)
    running = per_key.orderBy(block).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sizes.select(
        *keys,
        block,
        (F.sum("_rows").over(running) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(per_key).alias("_total"),
    )


def number_rows(
    df: DataFrame, keys, order, block: Column, position: str = "position", total: str | None = None
) -> DataFrame:
    """Exact 1-based row numbers per key, the key split into blocks.

    ``block`` must not decrease along ``order`` within a key (a hash prefix for
    hash order, a time bucket for time order).  Keys must not be null.
    """
    keys = list(keys)
    tagged = df.withColumn("_block", block)
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    numbered = tagged.withColumn("_in_block", F.row_number().over(inner))
    # A row per block may be nearly a row per row: never broadcast by the size of a file.
    sizes = block_sizes(tagged, keys, "_block").hint("merge")
    out = numbered.join(sizes, [*keys, "_block"]).withColumn(
        position, (F.col("_in_block") + F.col("_before")).cast("long")
    )
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_block", "_in_block", "_before", "_total")


def append_positions(
    existing: DataFrame, incoming: DataFrame, key: str, order, block: Column
) -> DataFrame:
    """Positions of new rows continue after the rows already stored."""
    stored = existing.groupBy(key).agg(F.count("*").alias("_stored"))
    numbered = number_rows(incoming, [key], order, block)
    return (
        spread_join(numbered, stored, [key], F.col("position"), "left", counted=incoming)
        .withColumn("position", F.col("position") + F.coalesce("_stored", F.lit(0)))
        .drop("_stored")
    )
