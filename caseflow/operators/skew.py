"""Joins that keep one hot key from landing in one task.

A key is hot when it holds more than `min_rows` rows. Every such key is found, however many
there are; each stands for more than `min_rows` rows, so their table, which is broadcast, has
less than a millionth of the rows at the default. Rows of a hot key are spread over salts by
a hash of their own row key, about `min_rows` to a salt; the rows they join to are copied
once per salt. Which keys are called hot never changes a result.

Adaptive skew handling does the same for a join on its own, but not for a join
whose partitioning the next step reuses, as the steps here do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_HOT_ROWS = 1_000_000
#: Counters of the summary by which keys that cannot be hot are left out.
COUNTERS = 1 << 18
SALT = "_salt"
FAN = "_fan"
_HOT_KEY = "_hot_key"


def hot_keys(df: DataFrame, key: str, min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """One row (key, fan) per hot key.

    Two passes over the key column alone. The first adds rows up in `COUNTERS` counters, to
    which keys are dealt by a hash: partial sums of tasks are merged, so that what is moved
    does not grow with the number of keys. No key has more rows than its counter. The second
    counts exactly, but only keys whose counter is above the limit. A missing key counts as
    a key: it matches nothing, but its rows have to be spread just the same.
    """
    name = F.col(key)
    counter = F.pmod(F.xxhash64(name), F.lit(COUNTERS))
    sums = df.groupBy(counter.alias("_counter")).agg(F.count(F.lit(1)).alias("_sum"))
    above = sums.filter(F.col("_sum") > min_rows).select("_counter")  # at most COUNTERS rows
    kept = df.select(name.alias(_HOT_KEY), counter.alias("_of")).join(
        F.broadcast(above), F.col("_of") == F.col("_counter"), "left_semi"
    )
    counts = kept.groupBy(_HOT_KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_rows)
    return counts.select(_HOT_KEY, F.ceil(F.col("n") / F.lit(min_rows)).cast("int").alias(FAN))


def with_fan(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Add the number of salts of each row's key, NULL unless it is hot."""
    return df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col(_HOT_KEY)), "left").drop(_HOT_KEY)


def spread_hot(df: DataFrame, key: str, row_key: str | Column, hot: DataFrame) -> DataFrame:
    """Add the number of salts of the key (1 unless hot) and the salt of the row.

    `row_key` must tell the rows of a key apart.
    """
    fan = F.coalesce(F.col(FAN), F.lit(1))
    # Never NULL, and said to be so: else the join would test the hash for NULL first.
    salt = F.coalesce(F.pmod(F.xxhash64(row_key), fan).cast("int"), F.lit(0))
    return with_fan(df, key, hot).withColumns({SALT: salt, FAN: fan})


def copy_hot(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Copy the rows of a hot key once per salt; other rows get salt 0.

    For sides with one row (or a bounded number of rows) per key.
    """
    salts = F.sequence(F.lit(0), F.coalesce(F.col(FAN), F.lit(1)) - 1)
    return with_fan(df, key, hot).withColumn(SALT, F.explode(salts)).drop(FAN)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    row_key: str | Column,
    how: str = "inner",
    condition: Column | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join many `left` rows per key to one `right` row per key.

    The salt stays in the result, which is partitioned on (key, salt).
    """
    hot = hot_keys(left, key) if hot is None else hot
    return salted_join(spread_hot(left, key, row_key, hot), right, key, hot, how, condition)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    hot: DataFrame,
    how: str = "inner",
    condition: Column | None = None,
) -> DataFrame:
    """Join an already salted `left` to `right`; the right key is dropped."""
    other = copy_hot(right, key, hot).withColumnsRenamed({key: "_right_key", SALT: "_right_salt"})
    on = (F.col(key) == F.col("_right_key")) & (F.col(SALT) == F.col("_right_salt"))
    if condition is not None:
        on = on & condition
    return left.join(other, on, how).drop("_right_key", "_right_salt")


def is_hot(df: DataFrame, key: str, hot: DataFrame, how: str) -> DataFrame:
    """Rows of hot keys (`left_semi`) or of all others (`left_anti`), where they are."""
    return df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col(_HOT_KEY)), how)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark `df` for broadcast when it has at most `max_rows` rows, which is counted.

    For stored tables or tables of literals, where counting is cheap.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
