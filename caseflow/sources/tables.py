"""Parquet datasets, catalog tables and views."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Read a Parquet dataset and keep the named columns.

    A given schema is applied as is, so no footer is opened to infer one.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    if columns is None:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}; found {df.columns}")
    return df.select(*columns)


def read_catalog(spark: SparkSession, name: str) -> DataFrame:
    """Read a table or view by its catalog name."""
    return spark.table(name)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Make `df` reachable from SQL under `name`."""
    df.createOrReplaceTempView(name)
    return df


def write_table(df: DataFrame, path: str) -> str:
    """Overwrite a Parquet dataset."""
    df.write.mode("overwrite").parquet(path)
    return path


def write_bucketed(
    df: DataFrame, name: str, path: str, key: str, buckets: int, rows_per_file: int = 1_000_000
) -> DataFrame:
    """Overwrite the catalog table `name`, its files below `path`, and return it.

    Rows are dealt into `buckets` by a hash of `key` and sorted by it, so that a join on the
    key moves the other side alone, and a look-up reads one bucket and, by the statistics
    and the Bloom filter of the key, few row groups of it. For tables that are written once
    and joined often, such as note texts. One task writes a bucket: so `buckets` follows the
    size of the table, a few hundred megabytes each.
    """
    writer = (
        # Without this each task would write a file to every bucket.
        df.repartition(buckets, key)
        .write.mode("overwrite")
        .format("parquet")
        .option("path", path)
        .option("maxRecordsPerFile", rows_per_file)
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{key}", str(rows_per_file))
        .bucketBy(buckets, key)
        .sortBy(key)
    )
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def bucketed_by(df: DataFrame, key: str) -> bool:
    """Whether `df` reads a table that is bucketed by `key` alone, so that a join on the key
    does not move it."""
    partitioning = df.select(key)._jdf.queryExecution().sparkPlan().outputPartitioning().toString().lower()
    return partitioning.startswith(f"hashpartitioning({key.lower()}#")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under the cluster's `spark.checkpoint.dir`, or under the checkpoint
    directory set on the context. Without either there is none that all executors share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isEmpty():
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = given.get()
    return f"{base.rstrip('/')}/caseflow-{uuid.uuid4().hex}"


def stage_table(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    For results that several later steps read: they are computed once, and a lost
    executor costs no recomputation because the files outlive it.
    """
    spark = df.sparkSession
    return read_table(spark, write_table(df, shared_folder(spark)), df.schema)
