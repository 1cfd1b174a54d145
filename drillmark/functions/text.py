"""Text clean-up, clipping, hashing and classification columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: line and prompt patterns ----------------------------------

LISTED_LINE = r"^\s*(?:\d+[.)]|[-*])\s+(?:\*\*)?(.+?)(?:\*\*)?\s*$"
BOLD_LINE = r"^\s*\*\*(.+?\??)\*\*\s*$"
LINK = r"\[([^\]]+)\]\([^)]+\)"
LINK_WITH_URL = r"\[([^\]]+)\]\(([^)]+)\)"
FOOTNOTE = r"\[\^.+?\]"
QUESTION_START = "(?i)^(design|describe|explain|tell|how|what|why)"
CODING_WORD = r"(?i)\b(code|implement|query|function|algorithm)\b"
SQL_WORD = r"(?i)\bsql\b"
MIN_PROMPT_CHARS = 15

# White space as Python's str.strip() sees it; Java's \s is ASCII only.
_WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def squeeze(text: Column) -> Column:
    """Collapse every run of white space into one blank and trim the ends."""
    return F.trim(F.regexp_replace(text, f"[{_SPACE}]+", " "))


def strip(text: Column) -> Column:
    """Drop white space of any kind from both ends."""
    return F.btrim(text, F.lit(_WHITE))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return ~has_text(text)


def has_text(text: Column) -> Column:
    """False for null, empty and white-space-only text."""
    # printable ASCII is no white space; the long class is slow and seldom asked this way
    return F.coalesce(text.rlike(f"[!-~]|[^{_SPACE}]"), F.lit(False))


def non_empty(text: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(text, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[non_empty(c) for c in columns])


def normalised(text: Column) -> Column:
    """White space collapsed, lower case: the form that content hashes compare."""
    return F.lower(squeeze(text))


def content_hash(domain: Column, prompt: Column) -> Column:
    """Sha-256 of domain, NUL, normalised prompt."""
    return F.sha2(F.concat(domain, F.lit("\0"), normalised(prompt)), 256)


def prompt_hash(prompt: Column) -> Column:
    """Sha-256 of the normalised prompt alone, as run-time items are keyed."""
    return F.sha2(normalised(prompt), 256)


def _json_text(value: Column) -> Column:
    wrapped = F.to_json(F.array(value.cast("string")))
    return wrapped.substr(F.lit(2), F.length(wrapped) - 2)


def source_key(dataset: Column, *identity: Column) -> Column:
    """Sha-256 of the JSON array ``["dataset", "part", ...]``."""
    parts = F.concat_ws(", ", *[_json_text(c) for c in (dataset, *identity)])
    return F.sha2(F.concat(F.lit("["), parts, F.lit("]")), 256)


def item_source_key(*parts: Column) -> Column:
    """Sha-256 of NUL-separated identity parts."""
    return F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256)


def derived_id(*parts: Column) -> Column:
    """A deterministic 32-hex id: the same row gets the same id on every run."""
    return F.md5(F.concat_ws("\0", *[p.cast("string") for p in parts]))


def relative_path(path: Column, root: str) -> Column:
    """T4: path below the root; a path outside it keeps only its file name."""
    prefix = root.rstrip("/") + "/"
    at = F.instr(path, prefix)
    return F.when(at > 0, path.substr(at + len(prefix), F.length(path))).otherwise(file_name(path))


def file_name(path: Column) -> Column:
    """Last path segment, back slashes counted as separators."""
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def clip(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def clip_ellipsis(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last one an ellipsis when cut."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - 1), F.lit("…"))
    )


def clip_marked(text: Column, limit: int, marker: str = "\n[context truncated]") -> Column:
    """``limit`` characters, then a marker when cut."""
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit(marker))
    )


def clip_error(text: Column) -> Column:
    """Stored error texts hold at most 2000 characters."""
    return clip(text, 2000)


def slug_title(slug: Column) -> Column:
    """``two-sum`` becomes ``Two Sum``."""
    return F.initcap(squeeze(F.translate(slug, "-", " ")))


def sql_title(question: Column) -> Column:
    """T8."""
    return F.concat(F.lit("SQL: "), F.substring(question, 1, 60))


def heading_title(markdown: Column) -> Column:
    """First line without leading ``#`` and blanks."""
    first = F.split(markdown, r"\r\n|[\n\r]", 2).getItem(0)
    return strip(F.regexp_replace(first, r"\A[# ]+", ""))


def plain_markdown(text: Column) -> Column:
    """Links become their text, emphasis marks go."""
    unlinked = F.regexp_replace(text, LINK, "$1")
    return strip(F.regexp_replace(unlinked, "[*_`]", ""))


def cited_markdown(text: Column) -> Column:
    """Links become ``text (url)``."""
    return strip(F.regexp_replace(text, LINK_WITH_URL, "$1 ($2)"))


def bullet_markdown(text: Column) -> Column:
    """Footnote marks go, links become their text, white space collapses."""
    unnoted = F.regexp_replace(text, FOOTNOTE, "")
    return squeeze(F.regexp_replace(unnoted, LINK, "$1"))


def starts_with_any(text: Column, prefixes) -> Column:
    """true when the text starts with one of the prefixes."""
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes])


def listed_prompt(line: Column) -> Column:
    """The text of a numbered, bulleted or all-bold line, else empty."""
    listed = F.regexp_extract(line, LISTED_LINE, 1)
    bold = F.regexp_extract(line, BOLD_LINE, 1)
    return strip(F.regexp_replace(F.coalesce(non_empty(listed), bold), r"\*\*|`", ""))


def looks_like_question(prompt: Column) -> Column:
    """T17."""
    asks = prompt.contains("?") | prompt.rlike(QUESTION_START)
    return (F.length(prompt) >= MIN_PROMPT_CHARS) & asks


def prompt_style(prompt: Column, scenario_starts: str) -> Column:
    """``scenario`` when the prompt starts with one of the alternatives."""
    return F.when(prompt.rlike(f"(?i)^({scenario_starts})"), "scenario").otherwise("direct")


def answer_format(prompt: Column) -> Column:
    """Does the prompt ask for code?"""
    coding = prompt.rlike(CODING_WORD)
    return F.when(coding, "coding").otherwise("theory")


def guessed_method(prompt: Column) -> Column:
    """T19."""
    return F.when(prompt.rlike(SQL_WORD), "sql")


def topic_or_any(topic: Column) -> Column:
    """Trimmed topic, ``general`` when empty."""
    return F.coalesce(non_empty(strip(topic)), F.lit("general"))


def split_list(text: Column) -> Column:
    """Comma list to trimmed, non-empty entries."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")
