"""Whole-frame helpers: select, rename, filter, merge, sort, stack, compare."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.fixed_values import ADULT_AGE, TIMESTAMP_FORMAT
from caseflow.functions.values import parse_timestamp
from caseflow.schemas import require_columns


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep the named columns in the given order."""
    require_columns(df, names, "select_columns")
    return df.select(*names)


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by dict; names outside the dict are kept."""
    if not isinstance(mapping, Mapping):
        raise ValueError("rename_columns needs a dict of old name to new name")
    return df.withColumnsRenamed(dict(mapping))


def keep_notnull(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def keep_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def split_by_age(
    df: DataFrame, limit: float = ADULT_AGE, age: str = "edvisit_age"
) -> tuple[DataFrame, DataFrame]:
    """(adults, children); a missing age is in neither."""
    return df.filter(F.col(age) >= limit), df.filter(F.col(age) < limit)


def timestamp_year(df: DataFrame, source: str, out: str, fmt: str = TIMESTAMP_FORMAT) -> DataFrame:
    return df.withColumn(out, F.year(parse_timestamp(source, fmt)))


def parse_timestamps(
    df: DataFrame, columns: Sequence[str], fmt: str = TIMESTAMP_FORMAT
) -> DataFrame:
    """Parse text columns in place; columns that hold timestamps already are cast."""
    types = dict(df.dtypes)
    return df.withColumns(
        {
            c: parse_timestamp(c, fmt) if types[c] == "string" else F.col(c).cast("timestamp_ntz")
            for c in columns
        }
    )


def add_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that are computed once per row, however often they are used.

    A plain projection is copied into every filter and aggregate above it, and a
    search through a long text would run again in each. Columns that come out of a
    one-row `inline` are not.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def merge(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    how: str,
    coalesce_key: bool = False,
) -> DataFrame:
    """Equi-join that keeps the left key only.

    In an outer join the key is NULL on rows only the right side has, unless
    `coalesce_key` fills it from the right.
    """
    joined = left.join(
        right.withColumnRenamed(right_on, "_right_on"),
        left[left_on] == F.col("_right_on"),
        how,
    )
    if coalesce_key:
        joined = joined.withColumn(left_on, F.coalesce(F.col(left_on), F.col("_right_on")))
    return joined.drop("_right_on")


def sort_values(
    df: DataFrame, column1: str, column2: str | None = None, how: str = "ascending"
) -> DataFrame:
    """Sort by one or two columns in the same direction."""
    if how not in ("ascending", "descending"):
        raise ValueError(f"how must be 'ascending' or 'descending', not {how!r}")
    names = [column1] if column2 is None else [column1, column2]
    return df.orderBy(*names, ascending=how == "ascending")


def head(df: DataFrame, n: int) -> DataFrame:
    """First n rows; sort first when it matters which."""
    return df.limit(n)


def stack(*frames: DataFrame) -> DataFrame:
    """All rows of frames that share their columns, duplicates included."""
    return reduce(DataFrame.unionByName, frames)


def stack_tagged(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """As `stack`, with the name of the frame of origin in column `tag`."""
    return stack(*[df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def _fingerprints(frames: Mapping[str, DataFrame]) -> dict[str, tuple]:
    """Per frame: rows, and two sums of hashes of its rows, the same for the same bag of rows.
    No row stands for an empty frame."""
    tagged = stack_tagged(frames, "_frame")
    columns = [c for c in tagged.columns if c != "_frame"]
    # Halves of the hashes, so that sums of any number of rows fit.
    parts = [F.shiftright(F.xxhash64(*columns), 32), F.hash(*columns).cast("long")]
    sums = tagged.groupBy("_frame").agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(f"h{i}") for i, p in enumerate(parts)])
    found = {r["_frame"]: (r["n"], r["h0"], r["h1"]) for r in sums.collect()}
    return {name: found.get(name) for name in frames}


def same_keys(
    frames: Mapping[str, DataFrame], key: str, position: str | None = None
) -> DataFrame:
    """Do the frames hold the same keys? One row (left, right, same) per pair.

    Without `position` the frames are compared as bags of keys; with it, key by key
    along the positions. First each frame gets a fingerprint that no order of rows changes,
    from one scan that moves a row per task: frames with different ones differ. Only frames
    that share theirs are compared key by key, in one aggregate that counts before the
    shuffle.
    """
    names = list(frames)
    at = [position] if position else []
    prints = _fingerprints({n: df.select(*at, key) for n, df in frames.items()})
    pairs = list(combinations(range(len(names)), 2))
    alike = [(i, j) for i, j in pairs if prints[names[i]] == prints[names[j]]]
    asked = {i for pair in alike for i in pair}
    if not alike:
        rows = [(names[i], names[j], False) for i, j in pairs]
        return next(iter(frames.values())).sparkSession.createDataFrame(rows, "left string, right string, same boolean")
    rows = stack_tagged({names[i]: frames[names[i]].select(*at, key) for i in sorted(asked)}, "_frame")
    counts = [F.count(F.when(F.col("_frame") == names[i], 1)).alias(f"_{i}") for i in sorted(asked)]
    per_key = rows.groupBy(*at, key).agg(*counts)
    verdict = per_key.agg(
        *[
            F.coalesce(F.bool_and(F.col(f"_{i}") == F.col(f"_{j}")), F.lit(True)).alias(f"s{i}_{j}")
            if (i, j) in alike
            else F.lit(False).alias(f"s{i}_{j}")
            for i, j in pairs
        ]
    )
    answers = F.array(
        *[
            F.struct(
                F.lit(names[i]).alias("left"),
                F.lit(names[j]).alias("right"),
                F.col(f"s{i}_{j}").alias("same"),
            )
            for i, j in pairs
        ]
    )
    return verdict.select(F.inline(answers))
