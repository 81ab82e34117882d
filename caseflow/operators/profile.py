"""Counts and profiles of a frame.

Several columns are profiled in one aggregate over one scan and turned into rows
afterwards, when there is a single row left to turn.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.fixed_values import NO_SECTION, PRICE_PER_1000_TOKENS

ALL = "All"


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "columns", F.lit(len(df.columns)).cast("long")
    )


def value_counts(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    """Rows per value, most frequent first; equal counts in value order."""
    rows = df if keep_null else df.filter(F.col(column).isNotNull())
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("count").desc(), F.col(column))


def nunique(df: DataFrame, column: str, count_null: bool = True) -> DataFrame:
    """Number of distinct values; NULL counts as one value or not at all."""
    return df.agg(distinct_values(column, count_null).alias("nunique"))


def distinct_values(column: str, count_null: bool = True) -> Column:
    distinct = F.countDistinct(column)
    if not count_null:
        return distinct
    return distinct + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))


def count_missing(df: DataFrame, column: str) -> DataFrame:
    """Rows where the column is NULL or ''."""
    c = F.col(column)
    return df.agg(_count_if(c.isNull() | (c == "")).alias("missing"))


def count_null(df: DataFrame, column: str) -> DataFrame:
    return df.agg(_count_if(F.col(column).isNull()).alias("nulls"))


def count_notnull(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(column).alias("notnulls"))


def _by_column(df: DataFrame, columns: Sequence[str], measures: dict) -> DataFrame:
    """One row per column with the measures, from one aggregate."""
    row = df.agg(
        *[
            F.struct(*[f(F.col(c)).alias(name) for name, f in measures.items()]).alias(f"_{i}")
            for i, c in enumerate(columns)
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[F.col(f"_{i}.{m}").alias(m) for m in measures])
            for i, c in enumerate(columns)
        ]
    )
    return row.select(F.inline(rows))


def null_profile(df: DataFrame, columns: Sequence[str], sentinel: str = NO_SECTION) -> DataFrame:
    """Per column: rows NULL, '', equal to the sentinel, and not NULL."""
    return _by_column(
        df,
        columns,
        {
            "nulls": lambda c: _count_if(c.isNull()),
            "empty": lambda c: _count_if(c == ""),
            "sentinel": lambda c: _count_if(c == sentinel),
            "notnulls": F.count,
        },
    )


def token_cost(
    df: DataFrame,
    columns: Sequence[str],
    price: float = PRICE_PER_1000_TOKENS,
    multiplier: int = 1,
) -> DataFrame:
    """Per token column: total tokens and what sending them costs."""
    totals = _by_column(
        df, columns, {"tokens": lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")}
    )
    return totals.withColumn("cost", F.col("tokens") / 1000 * F.lit(price) * F.lit(multiplier))


def cohort_stats(
    df: DataFrame, patient: str = "patient_id", visit: str = "encounter_id"
) -> DataFrame:
    """Rows, distinct patients and distinct visits; a NULL key counts as one."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        distinct_values(patient).alias("patients"),
        distinct_values(visit).alias("visits"),
    )


def column_equality(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where a == b is true, false and NULL."""
    return df.groupBy((F.col(a) == F.col(b)).alias("match")).agg(F.count(F.lit(1)).alias("count"))


def histogram(df: DataFrame, column: str, bins: int = 20, log: bool = False) -> DataFrame:
    """Equal-width bins between smallest and largest value: bin, lower, upper, count.

    Values are cut to whole numbers, or replaced by their natural logarithm. Text is read
    as numbers; what is no finite number, or has no logarithm, is left out.
    """
    number = F.col(column).try_cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    value = F.when(finite > 0, F.ln(finite)) if log else finite - finite % 1
    values = df.select(value.alias("v")).filter(F.col("v").isNotNull())
    bounds = values.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    edges = bounds.select(F.struct("low", "high")).scalar()
    width = (F.col("e.high") - F.col("e.low")) / F.lit(bins)
    slot = F.least(F.floor((F.col("v") - F.col("e.low")) / width), F.lit(bins - 1))
    counts = (
        values.withColumn("e", edges)
        .groupBy(F.when(width > 0, slot).otherwise(0).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        bounds.select(
            "low",
            ((F.col("high") - F.col("low")) / F.lit(bins)).alias("width"),
            F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
        )
        .join(counts, "bin", "left")
        .select(
            "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("lower"),
            (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("upper"),
            F.coalesce("n", F.lit(0)).cast("long").alias("count"),
        )
    )


def distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value for several columns: column, value, count. NULL is left out."""
    long = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                    for c in columns
                ]
            )
        )
    )
    return (
        long.filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def crosstab_margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows per pair of values with margins named 'All': a, b, count.

    Rows with a NULL in either column are left out. The margins are taken over the
    counted pairs, not over the rows.
    """
    pairs = (
        df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(F.col(a).cast("string").alias(a), F.col(b).cast("string").alias(b))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        pairs.cube(a, b)
        .agg(F.sum("n").alias("count"), F.grouping(a).alias("_a"), F.grouping(b).alias("_b"))
        .select(
            F.when(F.col("_a") == 1, ALL).otherwise(F.col(a)).alias(a),
            F.when(F.col("_b") == 1, ALL).otherwise(F.col(b)).alias(b),
            "count",
        )
    )


def crosstab_wide(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    """The crosstab as a grid: a row per value of `a`, a column per named value of `b`,
    'All' for the margins, 0 where a pair does not occur.
    """
    names = [str(v) for v in values]
    pairs = (
        df.filter(F.col(a).isNotNull() & F.col(b).cast("string").isin(*names))
        .groupBy(F.col(a).cast("string").alias(a))
        .agg(*[_count_if(F.col(b).cast("string") == n).alias(n) for n in names])
    )
    return (
        pairs.rollup(a)
        .agg(*[F.sum(n).alias(n) for n in names], F.grouping(a).alias("_all"))
        .withColumn(a, F.when(F.col("_all") == 1, ALL).otherwise(F.col(a)))
        .withColumn(ALL, sum((F.col(n) for n in names[1:]), F.col(names[0])))
        .drop("_all")
    )
