"""Joins on keys that are missing or very frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_join_known(left: DataFrame, right: DataFrame, keys, nullable: str) -> DataFrame:
    """Left join that keeps rows without a key out of the shuffle.

    Null keys match nothing but would all meet in one task; they are set aside
    and come back with nulls on the right.
    """
    present = left.filter(F.col(nullable).isNotNull()).join(right, keys, "left")
    absent = left.filter(F.col(nullable).isNull())
    return present.unionByName(absent, allowMissingColumns=True)


# Parts a frequent key of the larger side is split into.
SALTS = 64


def salted_join(
    large: DataFrame, small: DataFrame, keys, spread: Column, how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Inner or left join of many rows to a table of a few rows per key.

    The smaller side is repeated once per salt and the larger side draws its
    salt from ``spread``, so a key with a third of the rows goes to ``salts``
    tasks.  The estimate of the repeated side follows the size of a file, not the
    rows exploded from it, so it is merged and never broadcast.
    """
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("merge"), [*keys, "_salt"], how).drop("_salt")


# A key is frequent when it holds more than one row in a thousand, so there are
# fewer than a thousand frequent keys whatever the data.
_FREQUENT_SHARE = 1_000


def spread_join(
    large: DataFrame,
    small: DataFrame,
    keys,
    spread: Column,
    how: str = "inner",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Inner or left join that spreads the frequent keys of the larger side.

    Adaptive execution splits a skewed join only when both of its sides come
    straight from a shuffle.  Where one side is itself grouped or joined by the
    key, the frequent keys are found by a narrow count and salted; their list is
    small by its definition and is broadcast.  All other rows join as usual.
    ``counted`` may name a cheaper frame with the keys of ``large``.  Keys must
    not be null.
    """
    keys = list(keys)
    counts = (large if counted is None else counted).groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    above = counts.filter(F.col("_n") * _FREQUENT_SHARE > total)
    frequent = F.broadcast(above.select(*keys, F.lit(True).alias("_frequent")))
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    salted = large.join(frequent, keys, "left").withColumn(
        "_salt", F.when(F.col("_frequent"), salt).otherwise(0)
    )
    salts = F.when(F.col("_frequent"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = small.join(frequent, keys, "left").withColumn("_salt", F.explode(salts)).drop("_frequent")
    return salted.drop("_frequent").join(repeated, [*keys, "_salt"], how).drop("_salt")
