"""Columns for keys, flags, codes, ages and timestamps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.fixed_values import (
    DAYS_PER_YEAR,
    NO_ADMISSION,
    TIMESTAMP_FORMAT,
)

SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def string_key(c: Column | str) -> Column:
    """Key as text; a missing key stays NULL."""
    return as_column(c).cast("string")


def age_years(days: Column | str) -> Column:
    return as_column(days) / F.lit(DAYS_PER_YEAR)


def parse_timestamp(c: Column | str, fmt: str = TIMESTAMP_FORMAT) -> Column:
    """Text to a zone-free timestamp; text that does not fit the format is NULL.

    No session time zone is involved, so no clock change moves an hour. Text of the
    usual format is cast if it has the shape of one; other formats are read as UTC and
    rebuilt from their distance to 1970, which takes about twice as long.
    """
    c = as_column(c)
    if fmt == TIMESTAMP_FORMAT:
        return F.regexp_substr(c, F.lit(SHAPE)).try_cast("timestamp_ntz")
    return _timestamp_by_format(c, fmt)


def _timestamp_by_format(c: Column, fmt: str) -> Column:
    instant = F.try_to_timestamp(F.concat(c, F.lit("Z")), F.lit(f"{fmt}X"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)


def order_timestamp(date: Column | str, time: Column | str) -> Column:
    """Timestamp of a `yyyy-MM-dd` date and an `HH:mm` time held apart.

    The hour needs both digits: `9:05` is NULL, as is any missing part.
    """
    return parse_timestamp(
        F.concat(as_column(date), F.lit(" "), as_column(time), F.lit(":00"))
    )


def within_visit(t: Column | str, start: Column | str, end: Column | str) -> Column:
    """True when start <= t <= end."""
    return as_column(t).between(as_column(start), as_column(end))


def flag_not_sentinel(c: Column | str, sentinel: str = NO_ADMISSION) -> Column:
    """0 for the sentinel, 1 for everything else, a missing value included."""
    return F.when(as_column(c).eqNullSafe(F.lit(sentinel)), 0).otherwise(1)


def flag_present(c: Column | str) -> Column:
    """'Y' when a value is there, 'N' when it is NULL."""
    return F.when(as_column(c).isNull(), "N").otherwise("Y")


def _code_chain(c: Column, mapping: Mapping) -> Column:
    first, *rest = mapping.items()
    return reduce(
        lambda chain, kv: chain.when(c == F.lit(kv[0]), F.lit(kv[1])),
        rest,
        F.when(c == F.lit(first[0]), F.lit(first[1])),
    )


def map_codes(c: Column | str, mapping: Mapping) -> Column:
    """Mapped value; a code outside the mapping becomes NULL."""
    return _code_chain(as_column(c), mapping)


def replace_codes(c: Column | str, mapping: Mapping) -> Column:
    """Mapped value as text; a code outside the mapping is kept as it is."""
    c = as_column(c)
    return F.coalesce(_code_chain(c, mapping).cast("string"), c.cast("string"))


def starts_with_any(c: Column | str, prefixes: Sequence[str]) -> Column:
    """True when the text starts with one of the prefixes, letter case included.

    Each test is one the Parquet reader can evaluate itself.
    """
    c = as_column(c)
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])
