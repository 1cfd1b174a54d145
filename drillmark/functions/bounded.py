"""Nested values cut to a bound at every level."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from drillmark import schemas as S
from drillmark.sources.shipping import ship_by_value

ship_by_value(__name__)


def bounded(value, limit: int, items: int = S.MAX_BOUNDED_ITEMS, keys: int = S.MAX_BOUNDED_KEYS, name: int = S.MAX_BOUNDED_KEY_CHARS):
    """A value with texts of at most ``limit`` characters, of lists and objects the
    first entries, and what lies in them bounded to half of the limit."""
    if isinstance(value, str):
        return value[:limit]
    if isinstance(value, list):
        return [bounded(v, limit // 2, items, keys, name) for v in value[:items]]
    if isinstance(value, dict):
        first = list(value.items())[:keys]
        return {k[:name]: bounded(v, limit // 2, items, keys, name) for k, v in first}
    return value


def bounded_text(text: str, limit: int) -> str:
    """The JSON of a bounded list or object; any other text is cut itself.

    A tree that is nested more deeply than a worker can follow is cut as text: at
    such a depth its limits are zero.
    """
    try:
        value = json.loads(text)
        if isinstance(value, (list, dict)):
            return json.dumps(bounded(value, limit), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        pass
    return text[:limit]


def bounded_json(text: Column, limit: int = S.MAX_BOUNDED_CHARS) -> Column:
    """T21 on JSON texts of any shape and depth; a missing one stays missing."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else bounded_text(t, limit))

    return cut(text.cast("string"))
