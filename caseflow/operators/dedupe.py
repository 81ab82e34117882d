"""One row per key, and the rows that share a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.values import as_column
from caseflow.operators.skew import MIN_HOT_ROWS, hot_keys, is_hot


def first_by(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order.

    The rank limit is applied before the shuffle too, so a key that holds a large
    share of the rows sends one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def drop_duplicates(
    df: DataFrame, subset: Sequence[str], order_by: Sequence[Column | str] | None = None
) -> DataFrame:
    """One row per `subset`: the first in `order_by`, or any row without it."""
    if order_by is None:
        return df.dropDuplicates(list(subset))
    return first_by(df, subset, [as_column(c) for c in order_by])


def first_note(
    df: DataFrame,
    key: str = "encounter_id",
    date: str = "service_date",
    text: str = "note_text_processed",
    tiebreak: str = "note_id",
    length: Column | str | None = None,
) -> DataFrame:
    """Earliest note of each encounter (a missing date comes last); on equal dates
    the longest text, then the smallest `tiebreak`.

    `length` stands for the length of the text where the text itself is not there.
    """
    size = F.length(text) if length is None else as_column(length)
    return first_by(
        df,
        [key],
        [F.col(date).asc_nulls_last(), size.desc_nulls_last(), F.col(tiebreak)],
    )


def duplicated_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n) for the keys on more than one row; missing keys count as equal."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def duplicated_rows(df: DataFrame, key: str) -> DataFrame:
    """How many rows share their key with another row, as one row."""
    return duplicated_keys(df, key).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("duplicated_rows")
    )


def show_duplicates(df: DataFrame, key: str, min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """The rows that share their key with another row.

    Keys are counted first. The rows of a hot key are known to share it and stay
    where they are; only the others are moved to be matched with the counted keys.
    """
    hot = hot_keys(df, key, min_rows)
    repeated = duplicated_keys(df, key).select(F.col(key).alias("_key"))
    rest = is_hot(df, key, hot, "left_anti")
    matched = rest.join(repeated, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return is_hot(df, key, hot, "left_semi").unionByName(matched)
