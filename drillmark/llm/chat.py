"""Chat records of any known layout as one formatted text with a loss mask.

*Layout.*  A record is a JSON object.  Its layout is the tree of its field names
without the types and the number of list elements; the hash of that tree is the
record's fingerprint.  ``MAPPINGS`` says, per fingerprint, where the turns are;
a new layout is a new line there.

*Template.*  A turn is ``<|im_start|>role``, a new line, the text, ``<|im_end|>``
and a new line.  Control strings (of this and other common templates) inside a
text get a backslash after their first character and backslashes are doubled, so
no text can end a turn, and ``unescaped`` gives back every text exactly.

*Loss mask.*  Spans (code points, from and to) of the assistant texts.

Everything is built-in DataFrame functions.

Defined results: a missing text is empty, a missing role is an empty role; a
record that is no JSON object, or of a layout without a mapping, has no turns
(null) and keeps its row and fingerprint; a record is one row of at most 128 MiB
with strings of at most 20,000,000 characters (what Spark parses as one value);
conversations given as rows (``skeletons``, ``filled``) do not have these limits:
their texts stay out of the JSON, and a record that does not give its turns back
is an error; rows of a conversation with equal turn numbers
follow by role and text; repeated rows are turns of their own; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of chat templates (fixed values).
CONTROL = (
    START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
TURNS = "array<struct<role:string,text:string>>"
ASSISTANT = "assistant"
#: Turns of a conversation that make one record in ``skeletons``, and the longest role written there.
BLOCK_TURNS = 1_000
ROLE_CHARS = 1_000


# --------------------------------------------------------------------- layouts


@dataclass(frozen=True)
class Listed:
    """Turns in a list of objects."""

    path: str
    role: str
    text: str
    beside: tuple[str, ...] = ()  # other fields of the record
    names: dict[str, str] = field(default_factory=dict)  # roles that have other names here

    def layout(self) -> str:
        turn = f"OBJECT<{', '.join(sorted((self.role, self.text)))}>"
        fields = {self.path: f"{self.path}: ARRAY<{turn}>"} | {b: b for b in self.beside}
        return f"OBJECT<{', '.join(fields[k] for k in sorted(fields))}>"

    def turns(self, record: Column) -> Column:
        found = F.try_variant_get(record, f"$.{self.path}", f"array<struct<`{self.role}`:string,`{self.text}`:string>>")

        def role(t: Column) -> Column:
            out = F.coalesce(t[self.role], F.lit(""))
            for own, name in self.names.items():
                out = F.when(t[self.role] == own, name).otherwise(out)
            return out

        return F.transform(found, lambda t: F.struct(role(t).alias("role"), F.coalesce(t[self.text], F.lit("")).alias("text")))


@dataclass(frozen=True)
class Fields:
    """One field per turn; several fields of one role are joined by an empty line, empty ones left out."""

    order: tuple[tuple[str, tuple[str, ...]], ...]  # (role, fields)

    def layout(self) -> str:
        return f"OBJECT<{', '.join(sorted(f for _, fields in self.order for f in fields))}>"

    def turns(self, record: Column) -> Column:
        out = []
        for role, fields in self.order:
            values = [F.coalesce(F.try_variant_get(record, f"$.{f}", "string"), F.lit("")) for f in fields]
            text = values[0] if len(values) == 1 else F.array_join(F.array_remove(F.array(*values), ""), "\n\n")
            out.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
        return F.array(*out)


MAPPINGS = (
    Listed("messages", "role", "content"),
    Listed("messages", "role", "content", beside=("id",)),
    Listed("conversations", "from", "value", names={"human": "user", "gpt": "assistant"}),
    Listed("conversations", "from", "value", beside=("id",), names={"human": "user", "gpt": "assistant"}),
    Fields((("user", ("prompt",)), ("assistant", ("response",)))),
    Fields((("user", ("prompt",)), ("assistant", ("completion",)))),
    Fields((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Fields((("user", ("instruction",)), ("assistant", ("output",)))),
    Fields((("user", ("instruction", "input")), ("assistant", ("output",)))),
    Fields((("user", ("question",)), ("assistant", ("answer",)))),
)


def layout_of(record: Column) -> Column:
    """The tree of field names of a VARIANT."""
    kinds = "VOID|STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\\([0-9,]+\\)|DATE|TIMESTAMP(?:_NTZ)?|BINARY|UUID|VARIANT"
    return F.regexp_replace(F.schema_of_variant(record), f": (?:{kinds})(?=[,>])", "")


def fingerprint_of(layout: Column) -> Column:
    return F.substring(F.sha2(layout, 256), 1, 16)


def canonical(df: DataFrame, record: str) -> DataFrame:
    """``df`` with the ``fingerprint`` and the ``turns`` of its JSON records."""
    parsed = df.withColumn("_v", F.try_parse_json(F.col(record))).withColumn("fingerprint", fingerprint_of(layout_of(F.col("_v"))))
    turns = F.lit(None).cast(TURNS)
    for mapping in MAPPINGS:
        known = fingerprint_of(F.lit(mapping.layout()))
        turns = F.when(F.col("fingerprint") == known, mapping.turns(F.col("_v")).cast(TURNS)).otherwise(turns)
    return parsed.withColumn("turns", turns).drop("_v")


# -------------------------------------------------------------------- template


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescaped(text: Column) -> Column:
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark[0] + "\\" + mark[1:]), F.lit(mark))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def formatted(df: DataFrame, turns: str = "turns") -> DataFrame:
    """``df`` with the ``formatted`` text and its ``loss`` spans."""
    parts = F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(START), _role_out(F.coalesce(t["role"], F.lit(""))), F.lit("\n")).alias("head"),
            escaped(F.coalesce(t["text"], F.lit(""))).alias("body"),
            (t["role"] == ASSISTANT).alias("learn"),
        ),
    )
    tail = F.lit(END + "\n")
    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], tail)), "")
    spans = "array<struct<first:int,last:int>>"

    def add(seen: Column, p: Column) -> Column:
        begin = seen["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.array(F.struct(begin.alias("first"), end.alias("last"))).cast(spans)
        return F.struct((end + len(END) + 1).alias("at"), F.when(p["learn"], F.concat(seen["spans"], span)).otherwise(seen["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans"))
    loss = F.aggregate("_parts", start, add, lambda s: s["spans"])
    return df.withColumn("_parts", parts).withColumn("formatted", text).withColumn("loss", loss).drop("_parts")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(START) + 1))
        cut = F.instr(body, "\n")
        return F.struct(
            _role_in(F.substr(body, F.lit(1), cut - 1)).alias("role"), unescaped(F.substr(body, cut + 1)).alias("text")
        )

    return F.transform(turns, turn)


def learned(formatted: str, loss: str) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(loss, lambda s: unescaped(F.substr(formatted, s["first"] + 1, s["last"] - s["first"]))), ""
    )


def records(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, record): conversations as JSON records, in the layouts such data come in.

    A prompt with its response, or both with a system prompt, are written as
    fields, anything else as a list of messages.
    """
    return _gathered(turns, conversation, turn, role, text).select(conversation, _record("t").alias("record"))


def _gathered(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conversation, t): the turns of each conversation in order."""
    row = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("content"),
    )
    return turns.groupBy(F.col(conversation).alias(conversation)).agg(F.sort_array(F.collect_list(row)).alias("t"))


def _record(t: str) -> Column:
    """The turns in column ``t`` as a JSON record."""
    roles = F.transform(t, lambda x: x["role"])

    def content(k: int) -> Column:
        return F.get(t, F.lit(k))["content"]

    pair = F.to_json(F.struct(content(0).alias("prompt"), content(1).alias("response")))
    triple = F.to_json(F.struct(content(0).alias("system"), content(1).alias("prompt"), content(2).alias("response")))
    listed = F.to_json(F.struct(F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))
    return (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), pair)
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), triple)
        .otherwise(listed)
    )


def skeletons(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = BLOCK_TURNS) -> DataFrame:
    """(conversation, block, said, record): conversations in numbered blocks of at
    most ``size`` turns; ``said`` has the turns, and in the JSON ``record`` the
    place of a turn in ``said`` stands for its text, so records are of bounded size."""
    whole = _gathered(turns, conversation, turn, role, text)
    last = ((F.size("t") - 1) / size).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice("t", b * size + 1, F.lit(size)))
    cut = whole.select(conversation, F.posexplode(blocks).alias("block", "said"))
    bare = F.transform(
        "said",
        lambda x, k: F.struct(
            F.when(F.length(x["role"]) <= ROLE_CHARS, x["role"]).otherwise("").alias("role"), k.cast("string").alias("content")
        ),
    )
    return cut.withColumn("_bare", bare).withColumn("record", _record("_bare")).drop("_bare")


def filled(df: DataFrame, said: str = "said", turns: str = "turns") -> DataFrame:
    """``df`` with the texts of ``said`` in the ``turns`` read from its records; turns that are missing are an error."""

    def turn(t: Column) -> Column:
        own = F.element_at(said, t["text"].cast("int") + 1)
        return F.struct(
            F.when(F.length(own["role"]) <= ROLE_CHARS, t["role"]).otherwise(own["role"]).alias("role"), own["content"].alias("text")
        )

    same = F.coalesce(F.size(turns) == F.size(said), F.lit(False))
    lost = F.raise_error(F.concat(F.lit("a chat record did not give its turns back: "), F.substring("record", 1, 200)))
    return df.withColumn(turns, F.when(same, F.transform(turns, turn)).otherwise(lost.cast(TURNS)))
