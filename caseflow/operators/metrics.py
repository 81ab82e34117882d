"""Label evaluation: confusion counts, rates, F1 averages and word counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.text import word_count
from caseflow.functions.values import as_column

CELLS = ("TP", "FP", "TN", "FN")
MEASURES = ("Sensitivity", "Specificity", "F1_binary", "F1_micro", "F1_macro", "F1_weighted")


def _binary(c: Column | str) -> Column:
    """0 or 1 as a number; anything else, 'error' and 'neither' included, is NULL."""
    c = as_column(c).cast("string")
    return F.when(c.isin("1", "1.0"), 1).when(c.isin("0", "0.0"), 0)


def _cells(a: Column, p: Column) -> list[Column]:
    """The four counts of 0/1 columns, and the number of rows left out of them."""

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    return [
        count((a == 1) & (p == 1)).alias("TP"),
        count((a == 0) & (p == 1)).alias("FP"),
        count((a == 0) & (p == 0)).alias("TN"),
        count((a == 1) & (p == 0)).alias("FN"),
        count(a.isNull() | p.isNull()).alias("n_excluded"),
    ]


def confusion(
    df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()
) -> DataFrame:
    """TP, FP, TN, FN per group; a class that never occurs counts 0.

    Only pairs with both values 0 or 1 count; the others are in `n_excluded`.
    """
    pairs = df.select(*by, _binary(actual).alias("_a"), _binary(predicted).alias("_p"))
    return pairs.groupBy(*by).agg(*_cells(F.col("_a"), F.col("_p")))


def rates(conf: DataFrame) -> DataFrame:
    """Add sensitivity and specificity; NULL without positives or negatives."""
    tp, fp, tn, fn = (F.col(c) for c in CELLS)
    return conf.withColumns(
        {
            "Sensitivity": F.try_divide(tp, tp + fn),
            "Specificity": F.try_divide(tn, tn + fp),
        }
    )


def f1_scores(conf: DataFrame) -> DataFrame:
    """Add binary, micro, macro and weighted F1; 0 where a denominator is 0.

    The macro mean is over the classes that occur as actual or predicted value.
    """
    tp, fp, tn, fn = (F.col(c) for c in CELLS)

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    n = tp + fp + tn + fn
    f1_1 = ratio(2 * tp, 2 * tp + fp + fn)
    f1_0 = ratio(2 * tn, 2 * tn + fp + fn)
    classes = F.when(tp + fp + fn > 0, 1).otherwise(0) + F.when(tn + fp + fn > 0, 1).otherwise(0)
    return conf.withColumns(
        {
            "F1_binary": f1_1,
            "F1_micro": ratio(tp + tn, n),
            "F1_macro": ratio(f1_1 + f1_0, classes),
            "F1_weighted": ratio(f1_1 * (tp + fn) + f1_0 * (tn + fp), n),
        }
    )


def evaluate(
    df: DataFrame,
    actual: str,
    label_columns: Sequence[str],
    task: str | Column | None = None,
) -> DataFrame:
    """Summary row per task and label column.

    `task` is a task name column, or a literal; by default the outcome's name. All
    label columns are counted side by side in one aggregate, so that the input is
    read once and not repeated per label; only the counts are turned into rows.
    """
    task = F.lit(actual) if task is None else as_column(task)
    labels = [_binary(c).alias(f"_p{i}") for i, c in enumerate(label_columns)]
    per_task = (
        df.select(task.alias("Task"), _binary(actual).alias("_a"), *labels)
        .groupBy("Task")
        .agg(
            *[
                cell.alias(f"_{i}_{j}")
                for i in range(len(labels))
                for j, cell in enumerate(_cells(F.col("_a"), F.col(f"_p{i}")))
            ]
        )
    )
    names = [*CELLS, "n_excluded"]
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("Prompt"),
                *[F.col(f"_{i}_{j}").alias(name) for j, name in enumerate(names)],
            )
            for i, label in enumerate(label_columns)
        ]
    )
    counts = per_task.select("Task", F.inline(rows))
    return f1_scores(rates(counts)).select("Task", "Prompt", *CELLS, *MEASURES, "n_excluded")


def word_count_stats(
    df: DataFrame, text: str, by: Sequence[str] = ("task", "prompt")
) -> DataFrame:
    """Mean and sample standard deviation of the word count, to one place half-even."""
    n = word_count(text)
    return df.groupBy(*by).agg(
        F.bround(F.avg(n), 1).alias("mean_word_count"),
        F.bround(F.stddev_samp(n), 1).alias("std_word_count"),
    )
