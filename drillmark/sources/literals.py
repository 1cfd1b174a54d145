"""Columns that hold JSON or a Python literal."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from drillmark.sources.shipping import ship_by_value

ship_by_value(__name__)


@F.pandas_udf(StringType())
def _literal_json(text: pd.Series) -> pd.Series:
    def convert(value):
        if value is None:
            return None
        try:
            literal = ast.literal_eval(value)
            return json.dumps(literal, ensure_ascii=False) if isinstance(literal, (list, dict)) else None
        except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
            return None

    return text.map(convert, na_action="ignore")


def json_or_literal(text: Column) -> Column:
    """VARIANT of a JSON or Python-literal text, null when it is neither.

    Only texts that are not JSON are sent to Python.
    """
    parsed = F.try_parse_json(text)
    residue = F.when(parsed.isNull() & text.isNotNull(), text)
    return F.coalesce(parsed, F.try_parse_json(_literal_json(residue)))
