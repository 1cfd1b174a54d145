"""JSON and VARIANT helpers for structured payload columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from drillmark.functions.text import strip

# A whole text wrapped in one Markdown code fence.
FENCED = r"(?s)\A```(?:json)?\s*(.*?)\s*```\z"
FENCED_JSON = r"(?is)\A```json\s*(.*?)\s*```\z"


def unfence(text: Column) -> Column:
    """The body of a fenced reply, or the trimmed text when not fenced.

    Question replies may be fenced with or without the ``json`` tag.
    """
    body = strip(text)
    return F.when(body.startswith("```"), F.regexp_extract(body, FENCED, 1)).otherwise(body)


def unfence_json(text: Column) -> Column:
    """The same for replies whose fence has to carry the ``json`` tag."""
    body = strip(text)
    # the first test spares plain replies the costlier one
    fenced = body.startswith("```") & body.rlike(FENCED_JSON)
    return F.when(fenced, F.regexp_extract(body, FENCED_JSON, 1)).otherwise(body)


def parse_strict(text: Column) -> Column:
    """VARIANT, null for malformed JSON, NaN, Infinity and repeated keys."""
    return F.try_parse_json(text)


def decode(text: Column, schema, default: Column | None = None) -> Column:
    """Tolerant decode; malformed text gives the default."""
    value = F.from_json(text, schema)
    return value if default is None else F.coalesce(value, default)


def keys_of(value: Column) -> Column:
    """Sorted top-level keys of a VARIANT object, null for any other value."""
    return F.sort_array(F.map_keys(entries(value)))


def field(value: Column, path: str) -> Column:
    """A member as VARIANT, null when absent."""
    return F.try_variant_get(value, f"$.{path}", "variant")


def kind(value: Column) -> Column:
    """Type text of a VARIANT: ``STRING``, ``BIGINT``, ``ARRAY<...>`` ..."""
    return F.schema_of_variant(value)


def text_field(value: Column, path: str) -> Column:
    """The member as text when it is a JSON string, else null."""
    member = field(value, path)
    return F.when(kind(member) == "STRING", F.try_variant_get(member, "$", "string"))


def number_field(value: Column, path: str) -> Column:
    """The member as double when it is a JSON number (a boolean is not), else null."""
    member = field(value, path)
    numeric = kind(member).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    return F.when(numeric, F.try_variant_get(member, "$", "double"))


def list_field(value: Column, path: str) -> Column:
    """The member as ``array<variant>`` when it is a JSON array, else null."""
    return F.try_variant_get(value, f"$.{path}", "array<variant>")


def texts_field(value: Column, path: str) -> Column:
    """The member as ``array<string>`` when it is a JSON list of strings, else null.

    A null entry stays null; one type test covers the whole list.
    """
    member = field(value, path)
    return F.when(
        kind(member).isin("ARRAY<STRING>", "ARRAY<VOID>"),
        F.try_variant_get(member, "$", "array<string>"),
    )


def as_text(element: Column) -> Column:
    """An array element as text when it is a JSON string, else null."""
    return F.when(kind(element) == "STRING", F.try_variant_get(element, "$", "string"))


def entries(value: Column) -> Column:
    """The members of a VARIANT object as ``map<string,variant>``, else null."""
    return F.try_variant_get(value, "$", "map<string,variant>")


# Members that hold the rows of a reply, in the order they are tried.
ENVELOPES = ("data", "results", "web")


def _objects(rows: Column) -> Column:
    return F.filter(F.try_variant_get(rows, "$", "array<variant>"), lambda r: kind(r).startswith("OBJECT"))


def _opened(payload: Column, depth: Column) -> Column:
    """The rows of the first envelope list that has any, searched level by level.

    ``open`` holds the envelopes still closed, each with the places of the
    members on the way to it; ``found`` the lists.  Members of an envelope after
    one that is a list are not looked at.  The smallest way is the one a search
    that goes down first would meet first.
    """
    node = "struct<way:string,value:variant>"
    nodes = f"array<{node}>"

    def members(envelope: Column) -> Column:
        values = [field(envelope["value"], name) for name in ENVELOPES]
        is_list = [F.coalesce(kind(v).startswith("ARRAY"), F.lit(False)) for v in values]
        taken, stopped = [], F.lit(False)
        for place, value in enumerate(values):
            inside = F.struct(F.concat(envelope["way"], F.lit(str(place))).alias("way"), value.alias("value"))
            taken.append(F.when(~stopped & value.isNotNull(), inside))
            stopped = stopped | is_list[place]
        return F.filter(F.array(*taken), lambda n: n.isNotNull()).cast(nodes)

    def of_kind(found: Column, wanted: str) -> Column:
        return F.filter(found, lambda n: kind(n["value"]).startswith(wanted))

    def step(seen: Column, _: Column) -> Column:
        below = F.flatten(F.transform(seen["open"], members))
        filled = F.filter(of_kind(below, "ARRAY"), lambda n: F.size(_objects(n["value"])) > 0)
        return F.struct(
            of_kind(below, "OBJECT").alias("open"), F.concat(seen["found"], filled).alias("found")
        )

    top = F.array(F.struct(F.lit("").alias("way"), payload.alias("value"))).cast(nodes)
    start = F.struct(of_kind(top, "OBJECT").alias("open"), of_kind(top, "ARRAY").alias("found"))
    lists = F.aggregate(F.sequence(F.lit(1), depth), start, step, lambda seen: seen["found"])
    first = F.array_min(F.transform(lists, lambda n: n["way"]))
    return _objects(F.get(F.filter(lists, lambda n: n["way"] == first), F.lit(0))["value"])


def nested_rows(text: Column) -> Column:
    """The row objects inside ``data`` / ``results`` / ``web`` envelopes of any depth.

    A bare array is taken as it is; of nested envelopes the first non-empty list
    wins; a reply that is not JSON becomes one row holding the raw text.
    """
    payload = F.try_parse_json(text)
    raw = F.array(
        F.try_parse_json(
            F.to_json(
                F.struct(
                    F.lit("Web result").alias("title"),
                    F.lit("").alias("url"),
                    strip(text).alias("description"),
                )
            )
        )
    )
    none = F.filter(raw, lambda _: F.lit(False))
    unreadable = payload.isNull() & (F.length(strip(text)) > 0)
    # an envelope takes an opening brace
    depth = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit(""))) + 1
    return F.when(unreadable, raw).otherwise(F.coalesce(_opened(payload, depth), none))
