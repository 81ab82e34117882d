"""Helpers of the corpus operators: tables, staged results, ASCII words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Folder for sessions that name no `spark.checkpoint.dir` and run on one machine.
LOCAL_FOLDER = "/tmp/checkpoints"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below `spark.checkpoint.dir`, which all executors share.

    A session on one machine that names none gets `LOCAL_FOLDER`; on a cluster its
    absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = LOCAL_FOLDER
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark removes the shuffle files of a query when the query ends, instead of
    when the driver happens to collect the garbage that refers to them."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def write_staged(df: DataFrame) -> str:
    """Write `df` to a fresh shared folder and return its path. Nothing else reads the shuffles
    of such a write, so they do not outlive it."""
    path = shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: computed once, and a lost
    executor costs no recomputation, because the files outlive it."""
    return df.sparkSession.read.schema(df.schema).parquet(write_staged(df))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder made by `write_staged` that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard_staged(df: DataFrame) -> None:
    """Delete the files of a result of `stage` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        discard(df.sparkSession, folder)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. `lower` does just that to text without other
    letters, and is much faster than `translate`."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often it occurs in it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes not to clash with a column."""
    taken = {c.lower() for c in df.columns}
    while taken & {n.lower() for n in names}:
        names = tuple(f"_{n}" for n in names)
    return list(names)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns cannot clash with new ones."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df.select(*columns)
