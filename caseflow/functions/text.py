"""Columns over note text: cleaning, sections, counts and prompts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.fixed_values import CHARS_PER_TOKEN, NO_SECTION
from caseflow.functions.values import as_column

# Words end at Unicode blanks and at the four ASCII separators.
BLANKS = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E),
            *range(0x1C, 0x21),
            0x85,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ],
    )
)
PROMPT_OPEN = '  \n\n"""'
PROMPT_CLOSE = '"""'


def strip_newlines(c: Column | str) -> Column:
    """Newlines removed with nothing in their place."""
    return F.replace(as_column(c), F.lit("\n"), F.lit(""))


def squeeze_spaces(c: Column | str) -> Column:
    """Runs of blanks cut to one; tabs are left alone.

    Only runs of two or more are matched: most blanks stand alone and stay untouched.
    """
    return F.regexp_replace(as_column(c), " {2,}", " ")


def clean_text(c: Column | str) -> Column:
    return squeeze_spaces(strip_newlines(c))


def strip_commas(c: Column | str) -> Column:
    return F.replace(as_column(c), F.lit(","), F.lit(""))


def contains_any(c: Column | str, parts: Sequence[str]) -> Column:
    c = as_column(c)
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def first_position(c: Column | str, headings: Sequence[str]) -> Column:
    """1-based place where the earliest of the headings starts; NULL without any."""
    found = [F.nullif(F.instr(as_column(c), h), F.lit(0)) for h in headings]
    return F.least(*found) if len(found) > 1 else found[0]


def cut_between(c: Column | str, start: Column, end: Column, sentinel: str) -> Column:
    """Text from `start` up to `end`, both as found by `first_position`."""
    c = as_column(c)
    return (
        F.when(start.isNull() | end.isNull(), F.lit(sentinel))
        .when(end <= start, F.lit(""))
        .otherwise(F.substring(c, start, end - start))
    )


def cut_from(c: Column | str, start: Column, sentinel: str) -> Column:
    """Text from `start` to its end."""
    c = as_column(c)
    return F.when(start.isNull(), F.lit(sentinel)).otherwise(F.substring(c, start, F.length(c)))


def section_between(
    c: Column | str,
    starts: Sequence[str],
    ends: Sequence[str],
    sentinel: str = NO_SECTION,
) -> Column:
    """Text from the first start heading up to the first end heading.

    The sentinel when either is missing, '' when the end comes first.
    """
    return cut_between(c, first_position(c, starts), first_position(c, ends), sentinel)


def section_fallback(
    c: Column | str,
    starts: Sequence[str],
    ends: Sequence[str],
    other_ends: Sequence[str],
    sentinel: str = NO_SECTION,
) -> Column:
    """As `section_between`; `other_ends` close the section when no `ends` occurs."""
    end = F.coalesce(first_position(c, ends), first_position(c, other_ends))
    return cut_between(c, first_position(c, starts), end, sentinel)


def section_tail(
    c: Column | str,
    first: Sequence[str],
    second: Sequence[str],
    sentinel: str = NO_SECTION,
) -> Column:
    """Text from the `first` headings, else from the `second`, to its end."""
    start = F.coalesce(first_position(c, first), first_position(c, second))
    return cut_from(c, start, sentinel)


def token_count(c: Column | str) -> Column:
    """Estimated tokens: one per four characters, rounded up."""
    return F.ceil(F.length(as_column(c)) / F.lit(CHARS_PER_TOKEN)).cast("int")


def word_count(c: Column | str) -> Column:
    """Words between blanks; a missing text counts as one.

    Cutting at one plain blank takes half the time of matching words by a pattern.
    """
    parts = F.split(F.translate(as_column(c), BLANKS, " " * len(BLANKS)), " ")
    return F.coalesce(F.array_size(F.array_remove(parts, "")), F.lit(1))


def build_prompt(template: Column | str, history: Column | str, exam: Column | str) -> Column:
    """Instruction, then history and examination in three quotes."""
    return F.concat(
        as_column(template),
        F.lit(PROMPT_OPEN),
        as_column(history),
        F.lit(" "),
        as_column(exam),
        F.lit(PROMPT_CLOSE),
    )
