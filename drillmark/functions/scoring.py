"""Scores, marks, deadlines and the other small rules of practice sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from drillmark import schemas as S
from drillmark.functions.text import is_blank, non_empty


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """Fixed map look-up as a literal map."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def method_label(method: Column) -> Column:
    return lookup(method, S.METHOD_LABELS, method)


def syntax_language(method: Column) -> Column:
    return lookup(method, S.SYNTAX_LANGUAGES, method)


def has_comment(code: Column, method: Column) -> Column:
    """Does the code hold a comment mark of its method?"""
    verdict = F.when(F.lit(False), F.lit(False))
    for name, tokens in S.COMMENT_TOKENS.items():
        found = F.lit(False)
        for token in tokens:
            found = found | code.contains(token)
        verdict = verdict.when(method == name, found)
    return F.coalesce(verdict, F.lit(False))


def level_difficulty(level: Column) -> Column:
    """T6."""
    return lookup(F.lower(F.coalesce(level, F.lit(""))), S.SESSION_LEVELS, F.lit("Medium"))


def difficulty_rank(difficulty: Column) -> Column:
    """1-based place on the difficulty scale."""
    return lookup(difficulty, {d: i for i, d in enumerate(S.DIFFICULTIES, 1)})


def is_solved(status: Column, percent: Column) -> Column:
    """Completed and at least 80 percent; null counts as not solved."""
    return F.coalesce((status == "completed") & (percent >= S.SOLVED_PERCENT), F.lit(False))


def marks(percent: Column) -> Column:
    """Marks out of ten, one decimal."""
    return F.round(percent / 10, 1)


def choice_score(selected: Column, correct: Column) -> Column:
    """Exact match scores 100; an item without a correct option scores 0."""
    return F.when(selected == correct, 100.0).otherwise(0.0)


def item_score(answer_format: Column, selected, correct, answer_text, reviewed) -> Column:
    """Choice by match, blank code 0, other code by its review."""
    return (
        F.when(answer_format == "mcq", choice_score(selected, correct))
        .when(is_blank(answer_text), 0.0)
        .otherwise(reviewed)
    )


def given_answer(answer_text: Column, selected: Column) -> Column:
    """T32."""
    return F.coalesce(non_empty(answer_text), selected)


def option_text(options: Column, option_id: Column, missing: Column) -> Column:
    """Text of an option, ``missing`` when the id is not among the options."""
    chosen = F.filter(options, lambda o: o["id"] == option_id)
    return F.coalesce(F.get(chosen, F.lit(0))["text"], missing)


def chosen_text(options: Column, option_id: Column) -> Column:
    return option_text(options, option_id, F.lit(S.NO_ANSWER))


def correct_text(options: Column, option_id: Column) -> Column:
    return option_text(options, option_id, option_id)


def deadline(started_at: Column, minutes: Column) -> Column:
    """Absolute deadline."""
    return started_at + F.make_dt_interval(mins=minutes)


def remaining_seconds(deadline_at: Column, reference_time: Column) -> Column:
    """Whole seconds left at an explicit reference time, never negative."""
    left = F.unix_seconds(deadline_at.cast("timestamp")) - F.unix_seconds(
        reference_time.cast("timestamp")
    )
    return F.greatest(F.lit(0), left)


def round_robin(choices: Column, position: Column) -> Column:
    """Entry for a 1-based position, the list repeated as needed."""
    return F.get(choices, F.pmod(position - 1, F.size(choices)).cast("int"))


def uses_local(source_mode: Column, position: Column) -> Column:
    """Mixed sessions take a local item on odd positions."""
    return (source_mode == "local") | ((source_mode == "mixed") & (position % 2 == 1))


def seeded_unit(key: Column, seed: str) -> Column:
    """A reproducible number in [0, 1) from a key."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(seed)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def mixed_source(has_dataset: Column, has_ai: Column, unit: Column) -> Column:
    """Coin flip when both sides have questions, else the side that has."""
    return (
        F.when(has_dataset & has_ai, F.when(unit < 0.5, "ai").otherwise("dataset"))
        .when(has_ai, "ai")
        .when(has_dataset, "dataset")
    )


def mean_or_zero(mean: Column) -> Column:
    """T43."""
    return F.round(F.coalesce(mean, F.lit(0.0)), 1)


def starter_code(stored: Column, method: Column, templates: dict) -> Column:
    """Stored starter code, else the method's template."""
    return F.coalesce(stored, lookup(method, templates))


def render_template(template: str, **values: Column) -> Column:
    """Fill ``{{name}}`` marks; names must match the template exactly."""
    pieces, names, rest = [], set(), template
    while "{{" in rest:
        head, _, tail = rest.partition("{{")
        name, _, rest = tail.partition("}}")
        names.add(name)
        if name in values:
            pieces += [F.lit(head), values[name].cast("string")]
    if names != set(values):
        raise ValueError(f"The template asks for {sorted(names)}, got {sorted(values)}")
    return F.concat(*pieces, F.lit(rest))
