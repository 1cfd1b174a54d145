"""Reproducible random picks, for one filter or for many requests at once.

Serving many requests from one pool must not pair every request with every
candidate.  Each pool group is therefore put once into a seeded shuffle with
slots ``0 .. size-1``; a request starts at its own hashed slot and walks on
around the circle.  A draw of ``n`` items is ``n`` equi-joins on (group, slot),
whatever the size of the group.

A pool is exploded from a small file into a row per group and item, so Spark's
estimate of its slots is far too low; joins with them are merges, which adaptive
execution splits where a slot is asked for very often, and never broadcasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drillmark.operators.joins import salted_join
from drillmark.operators.ordered import number_rows

# 16**3 shuffle blocks per pool group; each block is numbered on its own.
_BLOCK_DIGITS = 3


def seeded_hash(key: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(seed)))


def seeded_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """K9: ``n`` rows without replacement, the same ones on every run."""
    return df.orderBy(seeded_hash(F.col(key), seed), F.col(key)).limit(n)


def shuffled_slots(pool: DataFrame, groups, key: str, seed: str) -> DataFrame:
    """Seeded shuffle of each group: ``slot`` from 0 and ``pool_size``."""
    hashed = pool.withColumn("_hash", seeded_hash(F.col(key), seed))
    return (
        number_rows(
            hashed,
            groups,
            ["_hash", key],
            F.substring("_hash", 1, _BLOCK_DIGITS),
            position="_position",
            total="pool_size",
        )
        .withColumn("slot", F.col("_position") - 1)
        .drop("_position", "_hash")
    )


def start_slot(request_key: Column, pool_size: Column, seed: str) -> Column:
    """Where a request enters the circle of its group."""
    digest = seeded_hash(request_key, seed)
    number = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    return F.pmod(number, pool_size)


def pool_sizes(pool: DataFrame, groups) -> DataFrame:
    return pool.groupBy(*groups).agg(F.count("*").alias("pool_size"))


def draw(
    requests: DataFrame, pool: DataFrame, groups, request_key: str, item_key: str, wanted: str, seed: str
) -> DataFrame:
    """``wanted`` distinct items of its group for every request.

    One row per drawn item with ``draw_no`` from 1 and the group's
    ``pool_size``; a request that wants more than its group holds gets all of
    it.  ``wanted`` is a small number checked by the caller (a quiz holds at
    most ten items).
    """
    slots = shuffled_slots(pool.select(*groups, item_key), groups, item_key, seed)
    sized = salted_join(
        requests.filter(F.col(wanted) > 0), pool_sizes(pool, groups), groups, F.col(request_key)
    )
    size = F.col("pool_size")
    steps = F.sequence(F.lit(0), F.least(F.col(wanted), size).cast("int") - 1)
    start = start_slot(F.col(request_key), size, seed)
    probes = sized.withColumn("_step", F.explode(steps)).withColumn(
        "slot", F.pmod(start + F.col("_step"), size)
    )
    drawn = probes.join(slots.drop("pool_size").hint("merge"), [*groups, "slot"])
    return drawn.withColumn("draw_no", F.col("_step") + 1).drop("_step", "slot")


# Steps that are searched for a gap in one task.
_GAP_BLOCK = 65_536


def first_gap(steps: DataFrame, keys, step: str) -> DataFrame:
    """Smallest non-negative number missing from the distinct ``step`` of each key.

    A null step stands for a key without any.  The steps of a key are cut into
    blocks: a block is searched by counting its unbroken prefix, and the first
    block that is absent or not full holds the gap.
    """
    keys = list(keys)
    block = F.floor(F.col(step) / _GAP_BLOCK)
    tagged = steps.withColumn("_block", block)
    in_block = Window.partitionBy(*keys, "_block").orderBy(step)
    unbroken = F.col(step) - F.col("_block") * _GAP_BLOCK == F.row_number().over(in_block) - 1
    prefixes = (
        tagged.withColumn("_unbroken", unbroken)
        .groupBy(*keys, "_block")
        .agg(F.count_if("_unbroken").alias("_prefix"))
    )
    # Null sorts last and takes the place after the last block.
    over_blocks = Window.partitionBy(*keys).orderBy(F.col("_block").asc_nulls_last())
    placed = prefixes.withColumn("_no", F.row_number().over(over_blocks).cast("long") - 1)
    present = F.col("_block") == F.col("_no")
    full = F.coalesce(present & (F.col("_prefix") == _GAP_BLOCK), F.lit(False))
    found = F.col("_no") * _GAP_BLOCK + F.when(present, F.col("_prefix")).otherwise(0)
    blocks = F.count("_block") * _GAP_BLOCK
    return placed.groupBy(*keys).agg(F.coalesce(F.min(F.when(~full, found)), blocks).alias("gap"))


def next_unused(
    sessions: DataFrame, used: DataFrame, pool: DataFrame, groups, session_key: str, item_key: str, seed: str
) -> DataFrame:
    """For each session and group the next item it has not seen.

    The answer is the first gap in the used slots, counted from the session's
    start slot, so the work is linear in the used rows and no session meets more
    of the pool than it has used.  A session may ask for several groups, one row
    each; a group that is used up gives no row.
    """
    slots = shuffled_slots(pool.select(*groups, item_key), groups, item_key, seed)
    asked = [session_key, *groups]
    entered = salted_join(
        sessions.select(*asked).distinct(), pool_sizes(pool, groups), groups, F.col(session_key)
    ).withColumn("_start", start_slot(F.col(session_key), F.col("pool_size"), seed))
    circle = [*asked, "pool_size", "_start"]
    seen = used.select(session_key, item_key).distinct()
    taken = (
        entered.join(seen, session_key)
        .join(slots.select(*groups, item_key, "slot").hint("merge"), [*groups, item_key])
        .select(*circle, F.pmod(F.col("slot") - F.col("_start"), F.col("pool_size")).alias("_step"))
    )
    steps = taken.unionByName(entered.withColumn("_step", F.lit(None).cast("long")))
    return (
        first_gap(steps, circle, "_step")
        .filter(F.col("gap") < F.col("pool_size"))
        .withColumn("slot", F.pmod(F.col("_start") + F.col("gap"), F.col("pool_size")))
        .join(slots.select(*groups, item_key, "slot").hint("merge"), [*groups, "slot"])
        .select(*asked, item_key)
    )
