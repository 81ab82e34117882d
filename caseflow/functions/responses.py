"""Columns over model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.fixed_values import NO_RESPONSE
from caseflow.functions.values import as_column


_ANSWER = "array<struct<choices:array<struct<message:struct<content:string>>>>>"


def response_content(c: Column | str, sentinel: str = NO_RESPONSE) -> Column:
    """Answer text at choices[0].message.content, else the sentinel.

    The text must be exactly one JSON value: it is read as the first of two elements of an
    array, so that another value or other text after it makes it malformed. Of a key that
    an object repeats the last value counts.
    """
    pair = F.concat(F.lit("["), as_column(c), F.lit(",{}]"))
    parsed = F.from_json(pair, _ANSWER, {"allowSingleQuotes": "false"})
    first = F.get(F.get(parsed, F.lit(0))["choices"], F.lit(0))["message"]["content"]
    return F.coalesce(F.when(F.size(parsed) == 2, first), F.lit(sentinel))


def parse_label(
    c: Column | str, sentinel: str = NO_RESPONSE, strict: bool = False
) -> Column:
    """'0' for a text with a 0 in it, else '1' for one with a 1, else 'error' or
    'neither'. With `strict`, a text with both digits is 'both_present'.
    """
    c = as_column(c)
    zero, one = c.contains("0"), c.contains("1")
    label = F.when(zero & one, "both_present").when(zero, "0") if strict else F.when(zero, "0")
    return label.when(one, "1").when(c.contains(sentinel), "error").otherwise("neither")
