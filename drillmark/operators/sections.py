"""Numbered lines and heading sections of whole texts, without a shuffle.

A text is one row.  Carrying a heading down to the lines below it would be a
window over the lines of the text; cutting the text at its headings inside the
row gives the same result as a narrow transformation, linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the line boundaries of a text file.
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
_MARK = "\u0000"


def lines_of(text: Column) -> Column:
    """The lines of a text, byte-order mark and the empty last line dropped."""
    unmarked = text.substr(F.lit(2), F.length(text))
    body = F.when(text.startswith("\ufeff"), unmarked).otherwise(text)
    ended = F.regexp_replace(body, rf"(?:{LINE_BREAK})\z", "")
    none = F.array().cast("array<string>")
    return F.when(body == "", none).otherwise(F.split(ended, LINE_BREAK, -1))


def numbered_lines(df: DataFrame, text: str, keep) -> DataFrame:
    """One row per line, with its 0-based ``line_no``."""
    return df.select(*keep, F.posexplode(lines_of(F.col(text))).alias("line_no", "line"))


def with_numbers(text: Column) -> Column:
    """The text with every line led by its number, as input of ``cut``."""
    numbered = F.transform(lines_of(text), lambda line, i: F.concat(i.cast("string"), F.lit(_MARK), line))
    return F.array_join(numbered, "\n")


def cut(df: DataFrame, body: str, line_start: str, head: str) -> DataFrame:
    """Cut a numbered text before every line that matches ``line_start``.

    One row per piece: ``body`` is the piece and ``head`` its first line, null
    for the piece before the first match.
    """
    starts = f"{_MARK}(?:{line_start})"
    pieces = df.withColumn(body, F.explode(F.split(F.col(body), rf"\n(?=\d+{starts})", -1)))
    first = F.split(F.col(body), "\n", 2).getItem(0)
    return pieces.withColumn(
        head, F.when(first.rlike(rf"\A\d+{starts}"), F.split(first, _MARK, 2).getItem(1))
    )


def explode_lines(df: DataFrame, body: str) -> DataFrame:
    """Lines of a numbered piece as ``line_no`` and ``line``; ``body`` is dropped."""
    one = F.split(F.col("_line"), _MARK, 2)
    return (
        df.withColumn("_line", F.explode(F.split(F.col(body), "\n", -1)))
        .withColumn("line_no", one.getItem(0).cast("int"))
        .withColumn("line", one.getItem(1))
        .drop("_line", body)
    )


def first_line_no(body: Column) -> Column:
    return F.substring_index(body, _MARK, 1).cast("int")


def last_match(body: Column, line_pattern: str) -> Column:
    """Group 1 of the last line of a piece that matches, else null."""
    found = F.regexp_extract_all(body, F.lit(rf"(?m)^\d+{_MARK}{line_pattern}$"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))
