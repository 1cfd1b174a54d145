"""Document fingerprints: one-permutation MinHash with optimal densification.

The five-word shingles of a text are hashed once; the top bits of a hash choose
its bin, and each bin keeps its least hash.  An empty bin takes over the value
of another: it tries bins in an order that is a fixed function of its own number
(the same for all texts) until one is filled, so two texts agree in a filled-up
bin with the probability of their likeness.  After ``PROBES`` tries the filled
bin with the least hash for that number is taken, which ends the search for any
text.  Of each bin, hashed once more with its number, the low 4 bits are stored,
16 bins in a long.  Bins that differ agree in these bits by chance once in 16
times; ``likeness`` corrects for that.

Everything is built-in DataFrame functions.

Defined results: a missing text is empty; a text of fewer than five words is one
shingle, an empty one is one shingle of no words; equal texts have equal
fingerprints; repeated rows are documents of their own; rows without an id come
first in the order of documents, rows with equal ids follow by text; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drillmark.llm.shared import BLANK

SHINGLE = 5
BINS = 256  # chosen by the top 8 bits, as -128 to 127
PROBES = 8
#: Chance that two different bins agree in the bits kept.
CHANCE = 1 / 16
#: Blocks of neighbouring documents per shuffle partition.
BLOCKS = 4


def _bin(value: Column) -> Column:
    return F.shiftright(value, 56).cast("int")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the packed fingerprint of a text column: 16 longs of 16 bins."""
    columns = df.columns
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), f"[{BLANK}]+"), "")
    hashed = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    shingles = F.transform(
        F.slice("_h", F.lit(1), F.greatest(F.size("_h") - (SHINGLE - 1), F.lit(1))),
        lambda h, i: F.xxhash64(h, *[F.get("_h", i + k) for k in range(1, SHINGLE)]),  # beyond the end: null, left out
    )
    none = F.array(F.xxhash64(F.lit("")))
    ordered = hashed.withColumn("_s", F.sort_array(F.when(F.size("_h") > 0, shingles).otherwise(none)))
    least = ordered.withColumn(
        "_m", F.filter("_s", lambda s, i: (i == 0) | (_bin(F.get("_s", i - 1)) != _bin(s)))
    ).withColumn("_b", F.transform("_m", _bin))
    # _b is used again below, so that it is computed once and not inside the next function
    own = least.withColumn(
        "_o",
        F.transform(
            F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)),
            lambda j: F.get("_m", (F.array_position("_b", j) - 1).cast("int")),
        ),
    )

    def filled(value: Column, j: Column) -> Column:
        tried = [F.get("_o", F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
        last = F.array_min(F.zip_with("_b", "_m", lambda b, m: F.struct(F.xxhash64(j, b).alias("o"), m.alias("m"))))
        return F.xxhash64(F.coalesce(value, *tried, last["m"]), j)  # by bin, so that copies differ in their bits

    dense = own.withColumn("_d", F.transform("_o", filled))
    packed = F.transform(
        F.sequence(F.lit(0), F.lit(BINS // 16 - 1)),
        lambda g: F.aggregate(
            F.slice("_d", g * 16 + 1, 16),
            F.lit(0).cast("long"),
            lambda a, v: F.shiftleft(a, 4).bitwiseOR(v.bitwiseAND(F.lit(15))),
        ),
    )
    # the size keeps _d a column of its own
    return dense.withColumn(name, F.when(F.size("_d") == BINS, packed)).select(*[F.col(f"`{c}`") for c in columns], name)


def written(packed: Column) -> Column:
    """A fingerprint as 256 hex digits, one per bin."""
    return F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, from 0 to 1."""

    def apart(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for shift in (1, 2):  # any bit of a digit, gathered in its lowest
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))

    differing = F.aggregate(F.zip_with(a, b, apart), F.lit(0), lambda s, x: s + x)
    agree = 1 - differing / F.lit(float(BINS))
    return F.least(F.greatest((agree - CHANCE) / (1 - CHANCE), F.lit(0.0)), F.lit(1.0))


def with_next(df: DataFrame, id: str, carried: list[str]) -> DataFrame:
    """Each row with the ``carried`` columns of the next row as ``next_*``, by ascending
    id; after the last row comes the first.

    Rows are sorted in blocks cut at quantiles of the id.  The first rows of a
    block are also sent to the end of the block before, so no block looks into
    another and no task sorts everything.
    """
    spark = df.sparkSession
    blocks = BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(id).cast("long")
    cuts = [k / blocks for k in range(1, blocks)]
    found = df.select(key.alias("k")).agg(
        F.percentile_approx("k", cuts, 100 * blocks).alias("cuts"),
        F.min("k").alias("least"),
        F.max(F.col("k").isNull()).alias("missing"),
    ).first()
    bounds = F.split(F.lit(",".join(map(str, sorted(set(found["cuts"] or [0]))))), ",").cast("array<bigint>")
    last = len(set(found["cuts"] or [0]))
    first = F.col("_k").isNull() if found["missing"] else F.col("_k") == F.lit(found["least"])
    block = F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col("_k"))), F.lit(0))
    nowhere = F.array().cast("array<struct<b:int,tail:int>>")
    at = F.concat(
        F.array(F.struct(block.alias("b"), F.lit(0).alias("tail"))),
        F.when(F.array_contains(bounds, F.col("_k")), F.array(F.struct((block - 1).alias("b"), F.lit(1).alias("tail")))).otherwise(nowhere),
        F.when(first, F.array(F.struct(F.lit(last).alias("b"), F.lit(2).alias("tail")))).otherwise(nowhere),
    )
    sent = df.withColumn("_k", key).withColumn("_at", F.explode(at)).withColumns(
        {"_block": F.col("_at.b"), "_tail": F.col("_at.tail")}
    )
    order = Window.partitionBy("_block").orderBy("_tail", F.asc_nulls_first("_k"), *carried)
    led = sent.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return led.filter("_tail = 0").drop("_k", "_at", "_block", "_tail")


def edited_likeness(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text (the last quarter of
    the code points replaced by the beginning of the next document), and the
    likeness to the edited text and to the next document."""
    narrow = df.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    paired = with_next(with_fingerprint(narrow, "text", "own"), "doc_id", ["text", "own"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("next_text").substr(F.lit(1), cut))
    after = with_fingerprint(
        paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own"), "edited", "after"
    )
    return after.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("own")).alias("fingerprint"),
        written(F.col("after")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("after")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
