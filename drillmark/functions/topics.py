"""F10 for many topics at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from drillmark.sources.shipping import ship_by_value

ship_by_value(__name__)


def mentioned(body: Column, topics: list[str]) -> Column:
    """Which of the topics a text holds, as a list without repeats.

    All topics are looked for in one pass over the text.  An empty topic is in
    every text, none is in a missing one.
    """

    @F.pandas_udf("array<string>")
    def found(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        words = ahocorasick.Automaton()
        for topic in topics:
            if topic:
                words.add_word(topic, topic)
        words.make_automaton()
        always = [""] if "" in topics else []

        def of(text: str | None) -> list[str]:
            if text is None:
                return []
            return always + sorted({t for _, t in words.iter(text)} if len(words) else ())

        for series in bodies:
            yield series.map(of)

    return found(body)
