"""Write what passes a row of filters, and count what each leaves, in one pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from caseflow.sources.tables import read_table


def write_filtered(df: DataFrame, path: str, steps: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Write the rows of `df` that pass all `steps` to `path` (Parquet, overwritten), and give
    back the written table and the counts: step (from 0), name, rows.

    `steps` maps a name to its condition; conditions add up in the given order, and step 0,
    `start`, has all rows. A condition that is NULL is not passed. The counts are observed in
    the tasks that write, of which each counts once however often it is run, so there is no
    second scan; `df` is filtered and written in the stage in which it ends.
    """
    kept, counts = F.lit(True), [F.count(F.lit(1)).alias("_0")]
    for i, condition in enumerate(steps.values(), 1):
        kept = kept & F.coalesce(condition, F.lit(False))
        counts.append(F.count(F.when(kept, 1)).alias(f"_{i}"))
    seen = Observation()
    # Not known before it runs: a filter that never passes would be planned away, counts and all.
    passes = F.when(F.spark_partition_id() < 0, True).otherwise(kept)
    df.observe(seen, *counts).filter(passes).write.mode("overwrite").parquet(path)
    found = seen.get
    rows = [(i, name, found[f"_{i}"]) for i, name in enumerate(["start", *steps])]
    spark = df.sparkSession
    return read_table(spark, path, df.schema), spark.createDataFrame(rows, "step int, name string, rows bigint")
