"""Removal of lines that repeat an earlier line, by an exact set-similarity join.

A line is the set of its words.  A line goes when an earlier line, by (document
id, line number), has a set of Jaccard similarity 4/5 or more; it does not
matter whether that one stays itself.

1. Words are ordered by length, the longest first, then by hash: long words are
   the rare ones, and nothing has to be counted.  Where that leaves lines crowded
   on the same keys (``CROWD``), words are ordered by rarity instead, from counts
   of all words in 65,536 classes.  Any order gives the same result.
2. Equal lines are one line at their first place; only it is compared.  A line
   is named by its text throughout (``same``); id and number only order lines,
   since rows without an id, or with a repeated one, share them.
3. A key of a line is a word and the one before it in this order (the first word:
   alone).  Sets of n and m words that share o and differ in d = n + m - 2o have at
   least o - d keys in common: a word in one set only breaks one at most.  For
   similar sets that is a third of n + m or more, so they share a key among the
   first ``n - ceil((n + ceil(4n/5)) / 3) + 1`` of each (prefix filter).  Lines meet
   on such keys, and go on if their sizes (length filter) and a parity sketch of
   both sets (an upper bound of the overlap) allow it.  The sketch has 64 to 256
   bits: one of 64 tells next to nothing of lines of 100 words.
4. Within the lines of one key, a line whose sketch is close to that of the
   first or of the one before it is paired with that one alone, so a group of g
   variants of a line does not give g*g pairs.
5. The pairs that are left are verified on the words themselves.  Lines that
   step 4 kept from other partners and that nothing matched are paired with all
   lines of their keys.

Everything is built-in DataFrame functions.  Fixed-size bit tables (``_bits``)
keep rows that cannot matter out of a shuffle; false positives in them cost time
only.

Defined results: a missing text stays missing and has no lines; lines without a
word always stay; a text of which no line stays becomes empty, its row stays;
rows without an id come before all others; repeated rows (equal id and text) are
one document and lose the same lines; lines of different rows with equal id and
number are equally early and do not remove each other unless they are equal sets
at other places; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drillmark.llm.shared import BLANK, kept
from drillmark.operators.barrier import once

#: Similarity, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
CLASS_BITS = 16
#: Bits of a word's place in the order that its length takes, the rest are its hash.
LENGTH_BITS = 5
#: Lines of one key from which it is crowded, and such keys a line, on average, from
#: which words are ordered by rarity.
CROWD, CROWDED_KEYS = 1000, 2
#: Earlier lines of a key that are tried before all others.
TRIED_BEFORE = 1
#: Sketches that differ in at most so many of their 64 bits are close.
CLOSE_BITS = 18
#: Words of a line from which its sketch has 128 and 256 bits.
WIDE, WIDER = 40, 100
FIRST_ID = -(1 << 63)
#: Size of the table of keys that occur again: 2**26 bits, 8 MB.
SHARED_BITS = 26


# ------------------------------------------------------------ fixed-size tables


def _numbers(values) -> Column:
    """A constant array, folded once per plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _bits(hashes: DataFrame, bits: int) -> DataFrame:
    """A bit table over the hashes in column ``h``: 2**bits bits in at most 2**(bits - 6) rows."""
    place = F.pmod("h", F.lit(1 << bits))
    return kept(
        hashes.select(F.shiftright(place, 6).cast("int").alias("_word"), place.bitwiseAND(F.lit(63)).cast("int").alias("_bit"))
        .groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_set")), "bits"
    )


def _again(hashes: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """As ``_bits``, over the hashes that several rows have; and the rows of crowded ones."""
    counts = hashes.groupBy("h").agg(F.count("*").alias("_n")).filter("_n > 1")
    place = F.pmod("h", F.lit(1 << bits))
    found = kept(
        counts.select(
            F.shiftright(place, 6).cast("int").alias("_word"), place.bitwiseAND(F.lit(63)).cast("int").alias("_bit"),
            F.when(F.col("_n") > CROWD, F.col("_n")).otherwise(F.lit(0)).alias("_many"),
        ).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_set"), F.sum("_many").alias("_many")), "bits"
    )
    return found.drop("_many"), found.agg(F.sum("_many")).first()[0] or 0


def _told(df: DataFrame, h: Column, table: DataFrame, bits: int) -> DataFrame:
    """``df`` with ``_in``: whether the bit of ``h`` is set.  The table is broadcast; its size is fixed."""
    place = F.pmod(h, F.lit(1 << bits))
    known = df.withColumn("_word", F.shiftright(place, 6).cast("int")).withColumn("_bit", place.bitwiseAND(F.lit(63)).cast("int"))
    joined = known.join(F.broadcast(table), "_word", "left")
    return joined.withColumn("_in", F.coalesce(F.getbit("_set", F.col("_bit")) == 1, F.lit(False))).drop("_word", "_bit", "_set")


# ----------------------------------------------------------------- lines, sets


def _narrow(df: DataFrame, id: str, text: str) -> DataFrame:
    return df.select(
        F.coalesce(F.col(id).cast("long"), F.lit(FIRST_ID)).alias("id"),
        F.xxhash64(F.col(id).cast("long"), F.col(text).cast("string")).alias("doc"),
        F.col(text).cast("string").alias("text"),
    )


def _lines(docs: DataFrame) -> DataFrame:
    """(id, doc, at, line, same): ``same`` names the line's text."""
    # an outer generator: else a filter in front of it splits every text once more
    found = docs.select("id", "doc", F.posexplode_outer(F.split("text", "\n")).alias("at", "line"))
    return found.filter("at is not null").withColumn("same", F.xxhash64("line"))


def _has_word() -> Column:
    return F.col("line").rlike(f"[^{BLANK}]")


def rarity(docs: DataFrame) -> Column:
    """Rank of each class of words, rarest first, as a constant array."""
    words = docs.select(F.explode_outer(F.split("text", f"[{BLANK}]+")).alias("word"))
    word_class = F.shiftrightunsigned(F.xxhash64("word"), 64 - CLASS_BITS)
    counts = words.groupBy(word_class.alias("c")).count().collect()  # at most 2**CLASS_BITS rows
    count = {r["c"]: r["count"] for r in counts}
    order = sorted(range(1 << CLASS_BITS), key=lambda c: (count.get(c, 0), c))
    rank = [0] * len(order)
    for k, c in enumerate(order):
        rank[c] = k ^ (1 << (CLASS_BITS - 1))  # so that longs led by it compare as ranks do
    return _numbers(rank)


def _by_length(word: Column) -> Column:
    """Place of a word in the order by length, the longest first."""
    low = 64 - LENGTH_BITS
    longest = 1 << LENGTH_BITS
    short = F.lit(longest // 2 - 1) - F.least(F.octet_length(word), F.lit(longest - 1))  # signed, as longs compare
    return F.shiftleft(short.cast("long"), low).bitwiseOR(F.xxhash64(word).bitwiseAND(F.lit((1 << low) - 1)))


def _by_rarity(word: Column, ranks: Column) -> Column:
    low = 64 - CLASS_BITS
    h = F.xxhash64(word)
    rank = F.coalesce(ranks[F.shiftrightunsigned(h, low).cast("int")], F.lit(0).cast("long"))
    return F.shiftleft(rank, low).bitwiseOR(h.bitwiseAND(F.lit((1 << low) - 1)))


def _with_set(lines: DataFrame, ranks: Column | None = None) -> DataFrame:
    """Adds the words as sorted longs, longest or rarest first, their number and their parity sketch."""
    blank = F.col("line")
    for c in "\t\x0b\x0c\r":  # a split at one plain character is the fast one; a line holds no newline
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    words = F.array_remove(F.split(blank, " "), "")
    ordered = F.transform(words, lambda w: _by_length(w) if ranks is None else _by_rarity(w, ranks))
    with_keys = once(lines, "keys", F.sort_array(F.array_distinct(ordered)))
    # never null, so that no null test tells the two sides of a later join apart
    found = with_keys.withColumn("n", F.coalesce(F.size("keys"), F.lit(0))).withColumn("parity", F.coalesce(_sketch(F.col("keys")), F.lit(0).cast("long")))
    for name, (least, *bits) in _PARTS.items():
        found = found.withColumn(name, F.when(F.col("n") >= least, _sketch(_chosen(*bits))).otherwise(F.lit(0).cast("long")))
    return found


def _sketch(keys: Column) -> Column:
    """For each of 64 classes of words, the parity of the number of words."""

    def flipped(a: Column, k: Column) -> Column:
        return a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int")))

    return F.aggregate(keys, F.lit(0).cast("long"), flipped)


def _chosen(mask: int, bits: int) -> Column:
    """The words whose bits under ``mask`` are ``bits``."""
    return F.filter("keys", lambda k: k.bitwiseAND(F.lit(mask).cast("long")) == F.lit(bits).cast("long"))


def _apart(x, y) -> Column:
    """Bits in which the sketches differ, of 64, 128 or 256: never more than words that only one line has."""
    parity, half, third, fourth = [x(c).bitwiseXOR(y(c)) for c in ("parity", *_PARTS)]
    other = parity.bitwiseXOR(half)
    two = F.bit_count(half) + F.bit_count(other)
    four = [third, half.bitwiseXOR(third), fourth, other.bitwiseXOR(fourth)]
    n = F.least(x("n"), y("n"))
    return F.when(n < WIDE, F.bit_count(parity)).when(n < WIDER, two).otherwise(sum(map(F.bit_count, four[1:]), F.bit_count(four[0])))


def _with_prefix(sets: DataFrame) -> DataFrame:
    """The lines with the keys of their prefix instead of all words."""
    least = F.expr(f"(n + (n * {NUMERATOR} + {DENOMINATOR - 1}) div {DENOMINATOR} + 2) div 3")
    size = (F.col("n") - least + 1).cast("int")
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.col("keys")[i - 1])
    return sets.select(*_LINE, F.transform(F.slice("keys", F.lit(1), size), lambda k, i: F.xxhash64(k, before(i))).alias("prefix"))


def _words_of(lines: DataFrame) -> DataFrame:
    """(token, same, id, at, n, parity): one row per key of the prefix."""
    return lines.select(*_LINE, F.explode_outer("prefix").alias("token")).filter("token is not null")


def _prefixes(sets: DataFrame) -> DataFrame:
    return _words_of(_with_prefix(sets))


def _least(x, y) -> Column:
    """Words that two similar lines share at least."""
    both = NUMERATOR + DENOMINATOR
    return F.expr("0") + F.floor(((x("n") + y("n")) * NUMERATOR + (both - 1)) / both)


def _may_match(x, y) -> Column:
    """Length and parity filters for two prefix rows of one key, y earlier than x."""
    total, least = x("n") + y("n"), _least(x, y)
    earlier = (y("id") < x("id")) | ((y("id") == x("id")) & (y("at") < x("at")))
    sizes = (x("n") * DENOMINATOR >= y("n") * NUMERATOR) & (y("n") * DENOMINATOR >= x("n") * NUMERATOR)
    apart = F.bit_count(x("parity").bitwiseXOR(y("parity")))
    return earlier & sizes & (apart <= total - 2 * least)


def _wide_match(x, y) -> Column:
    """The filter by the whole sketch, for what ``_may_match`` lets through: a join that
    tests it reads all parts for every two rows of a key."""
    return _apart(x, y) <= x("n") + y("n") - 2 * _least(x, y)


def _close(x, y) -> Column:
    return F.bit_count(x("parity").bitwiseXOR(y("parity"))) <= CLOSE_BITS


#: The sketches of words chosen by further bits; with ``parity``, the sketch of all
#: words, they give the sketches of the other words: two of 64 bits from WIDE words
#: on, four from WIDER on.  Each: least words, mask, bits.
_PARTS = {
    "half": (WIDE, 64, 0),
    "third": (WIDER, 192, 0),
    "fourth": (WIDER, 192, 64),
}
_LINE = ("same", "id", "at", "n", "parity", *_PARTS)
#: What is left of a line once the earlier one of a pair is known.
_END = ("same", "n")
_ENDS = [f"{s}_{c}" for s in "xy" for c in _END]


# ------------------------------------------------------------------ candidates


def _pairs(prefixes: DataFrame) -> DataFrame:
    """(x_same, x_n, y_same, y_n, alone): candidate pairs, y earlier; ``alone`` marks pairs of step 4."""
    # the tests a join would put before one side only: so both sides below are one exchange
    known = [F.col(c).isNotNull() for c in ("token", "n", "parity")]
    # without the parts of a sketch the 64 bits of all words decide
    prefixes = prefixes.withColumns({c: F.lit(0).cast("long") for c in _PARTS if c not in prefixes.columns})
    prefixes = prefixes.filter(known[0] & known[1] & known[2]).repartition("token")
    by_word = Window.partitionBy("token").orderBy("id", "at")
    me = F.struct(*_LINE)
    tried = [F.first(me).over(by_word), *[F.lag(me, k).over(by_word) for k in range(1, TRIED_BEFORE + 1)]]
    ahead = prefixes.select("*", *[t.alias(f"t{k}") for k, t in enumerate(tried)])

    def x(c):
        return F.col(c)

    def r(c):
        return F.col(f"r_{c}")

    def t(k):
        return lambda c: F.col(f"t{k}.{c}")

    looks = F.coalesce(*[F.when(_may_match(x, t(k)) & _wide_match(x, t(k)) & _close(x, t(k)), F.col(f"t{k}")) for k in range(len(tried))])
    left = ahead.withColumn("near", looks).select("token", *_LINE, "near")
    right = prefixes.select("token", *[F.col(c).alias(f"r_{c}") for c in _LINE])
    joined = left.join(
        right,
        (left["token"] == right["token"]) & F.col("near").isNull() & _may_match(x, r),
        "left",
    )
    y = [F.coalesce(F.col(f"near.{c}"), F.when(_wide_match(x, r), r(c))).alias(f"y_{c}") for c in _END]
    found = joined.select(*[F.col(c).alias(f"x_{c}") for c in _END], *y, F.col("near").isNotNull().alias("alone"))
    return found.filter("y_same is not null").groupBy(*_ENDS).agg(F.max("alone").alias("alone"))


def _all_pairs(some: DataFrame, prefixes: DataFrame) -> DataFrame:
    left = some.select("token", *_LINE)
    right = prefixes.select("token", *[F.col(c).alias(f"r_{c}") for c in _LINE])
    joined = left.join(right, (left["token"] == right["token"]) & _may_match(F.col, lambda c: F.col(f"r_{c}")))
    joined = joined.filter(_wide_match(F.col, lambda c: F.col(f"r_{c}")))
    found = joined.select(*[F.col(c).alias(f"x_{c}") for c in _END], *[F.col(f"r_{c}").alias(f"y_{c}") for c in _END])
    return found.distinct()


def _verified(pairs: DataFrame, compared: DataFrame) -> DataFrame:
    """(same) of the lines with a similar earlier line among ``pairs``."""
    ends = pairs.select(F.col("x_same").alias("h")).union(pairs.select("y_same"))
    wanted = _bits(ends, 22)
    sets = kept(_with_set(_told(compared, F.col("same"), wanted, 22).filter("_in")).select("same", "keys"), "sets")

    def side(s):
        return sets.select(F.col("same").alias(f"{s}_same"), F.col("keys").alias(f"{s}_keys"))

    both = pairs.join(side("x"), "x_same").join(side("y"), "y_same")
    shared = F.size(F.array_intersect("x_keys", "y_keys"))
    similar = both.filter(shared * (NUMERATOR + DENOMINATOR) >= (F.col("x_n") + F.col("y_n")) * NUMERATOR)
    return similar.select(F.col("x_same").alias("same")).distinct()


# -------------------------------------------------------------------- decision


def _keyed(compared: DataFrame, ranks: Column | None) -> tuple[DataFrame, DataFrame, bool]:
    """The lines with their keys, a bit table of the keys of several lines, whether these are crowded."""
    # one row per line: a row per key would be written, and read again, with its line's columns each time
    short = kept(_with_prefix(_with_set(compared, ranks)), "prefixes")
    # a key that one line alone has in its prefix brings it together with nothing
    shared, many = _again(_words_of(short).select(F.col("token").alias("h")), SHARED_BITS)
    return short, shared, many > CROWDED_KEYS * short.count()


def _kept_places(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All lines as (id, doc, at, same, words) and the (same, id, at) of those with words that stay."""
    lines = _lines(docs)
    narrow = kept(lines.select("id", "doc", "at", "same", _has_word().alias("words")), "lines")
    place = F.struct("id", "at")
    firsts = kept(
        narrow.filter("words").groupBy("same").agg(F.min(place).alias("p"), F.count("*").alias("c"))
        .select("same", "p.id", "p.at", (F.col("c") > 1).alias("again")), "firsts"
    )
    again = _bits(firsts.filter("again").select(F.col("same").alias("h")), 22)
    worded = _told(lines.filter(_has_word()), F.col("same"), again, 22)
    single = worded.filter(~F.col("_in"))
    more = worded.filter("_in").join(firsts.select("same", "id", "at"), ["same", "id", "at"], "left_semi")
    # several rows without an id may hold a line at its first place
    more = kept(more.groupBy("same").agg(*[F.first(c).alias(c) for c in ("id", "at", "line")]), "more")
    compared = single.select("same", "id", "at", "line").unionByName(more)  # one row per text
    short, shared, crowded = _keyed(compared, None)
    if crowded:
        short, shared, _ = _keyed(compared, rarity(docs))
    prefixes = _words_of(short)
    pairs = kept(_pairs(_told(prefixes, F.col("token"), shared, SHARED_BITS).filter("_in").drop("_in")), "pairs")
    matched = kept(_verified(pairs, compared), "matched")
    # lines that were paired with one line only, which then was not similar
    open_ = pairs.filter("alone").select(F.col("x_same").alias("same")).distinct().join(matched, "same", "left_anti")
    open_ = kept(open_, "open")
    at_open = _bits(open_.select(F.col("same").alias("h")), 18)
    maybe = _told(short, F.col("same"), at_open, 18).filter("_in").drop("_in")
    some = kept(_words_of(maybe.join(open_, "same", "left_semi")), "open")
    words_open = _bits(some.select(F.col("token").alias("h")), 20)
    others = _told(prefixes, F.col("token"), words_open, 20).filter("_in").drop("_in")
    rest = kept(_all_pairs(some, others), "pairs")
    late = _verified(rest, compared)
    gone = matched.unionByName(late)
    stay = firsts.select("same", "id", "at").join(gone, "same", "left_anti")
    return narrow, stay


def kept_lines(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, flags): for each document, named by id and text, which of its lines stay."""
    narrow, stay = _kept_places(_narrow(df, id, text))
    told = narrow.join(stay.withColumn("stays", F.lit(True)), ["same", "id", "at"], "left").select(
        "doc", F.struct("at", (~F.col("words") | F.col("stays").isNotNull()).alias("stays")).alias("line")
    )
    return told.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("lines")).select(
        "doc", F.col("lines.stays").alias("flags")
    )


def without_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", flags_as: str | None = None) -> DataFrame:
    """The rows of ``df`` with the lines left in ``text``; its columns keep their names and places.

    ``flags_as`` names a further column that says of each line whether it stays.
    """
    flags = kept(kept_lines(df, id, text), "flags")
    inner = df.columns
    keyed = df.select(
        F.xxhash64(F.col(id).cast("long"), F.col(text).cast("string")).alias("_doc"),
        *[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(inner)],
    )
    body = f"_c{inner.index(text)}"
    joined = keyed.join(flags.select(F.col("doc").alias("_doc"), F.col("flags").alias("_flags")), "_doc", "left")
    left = F.array_join(F.filter(F.split(body, "\n"), lambda x, i: F.col("_flags")[i]), "\n")
    return joined.withColumn(body, F.when(F.col(body).isNotNull(), left)).select(
        *[F.col(f"_c{k}").alias(c) for k, c in enumerate(inner)], *([F.col("_flags").alias(flags_as)] if flags_as else [])
    )
