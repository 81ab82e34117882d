"""Samples of exact size that a seed repeats.

Rows are ranked by md5(seed | key), so the same keys are drawn in any engine and
on any partitioning; `key` must tell rows apart. Nothing is sorted whole: a first
pass reads key and label alone and counts rows per hash bucket, which tells the
bucket in which the last wanted row lies. All rows of earlier buckets are drawn,
none of later ones, and only within that one bucket does the rank decide.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from caseflow.fixed_values import LABELLING_ROWS, SEED
from caseflow.functions.values import map_codes

BUCKET_DIGITS = 3  # hex digits after the leading zeros
NUMBER_DIGITS = 4  # 16**4 hash prefixes, few enough to broadcast their counts
_HASH = "_hash"
_BUCKET = "_bucket"


def seeded_hash(seed: int, key: str) -> Column:
    """md5 of seed and key in hex; a missing key counts as an empty one."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def hash_bucket(h: Column) -> Column:
    """Where in the hash order `h` lies: its length without leading zeros, then its
    first digits.

    Buckets get narrower towards the start of the order. The one in which a draw ends
    thus holds about one row per 256 drawn, however many rows there are, and some ten
    thousand buckets cover any number of rows.
    """
    digits = F.ltrim(h, F.lit("0"))
    return F.concat(
        F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(digits, 1, BUCKET_DIGITS)
    )


def _checked(n: Column, total: Column, cutoff: Column, what: Column) -> Column:
    """The cutoff, or an error when fewer than n rows are there to draw from."""
    message = F.concat(
        F.lit("cannot draw "),
        n.cast("string"),
        F.lit(" rows from "),
        total.cast("string"),
        F.lit(" of "),
        what,
    )
    return F.when(total >= n, cutoff).otherwise(F.raise_error(message).cast("string"))


def _cutoffs(df: DataFrame, n: Column, seed: int, key: str, by: Sequence[str]) -> DataFrame:
    """Per group: the bucket of the n-th row (`_upto`), how many rows to take in it
    (`_rest`), and all rows (`_total`).
    """
    counts = df.groupBy(*by, hash_bucket(seeded_hash(seed, key)).alias(_BUCKET)).agg(
        F.count(F.lit(1)).alias("_n")
    )
    running = F.sum("_n").over(Window.partitionBy(*by).orderBy(_BUCKET))
    rest = (n - F.col("_sum") + F.col("_n")).alias("r")
    reached = F.when(F.col("_sum") >= n, F.struct(_BUCKET, rest))
    total = F.coalesce(F.max("_sum"), F.lit(0)).alias("_total")
    cut = (F.col(f"_cut.{_BUCKET}").alias("_upto"), F.col("_cut.r").alias("_rest"))
    return (
        counts.withColumn("_sum", running)
        .groupBy(*by)
        .agg(F.min(reached).alias("_cut"), total)
        .select(*by, *cut, "_total")
    )


def _hashed(df: DataFrame, seed: int, key: str) -> DataFrame:
    h = seeded_hash(seed, key)
    return df.withColumns({_HASH: h, _BUCKET: hash_bucket(h)})


def _take(near: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """The drawn rows of those up to the cutoff bucket, their group's cutoff attached."""
    place = F.row_number().over(Window.partitionBy(*by, _BUCKET).orderBy(_HASH, key))
    return (
        near.withColumn("_place", place)
        .filter((F.col(_BUCKET) < F.col("_upto")) | (F.col("_place") <= F.col("_rest")))
        .drop("_place", "_upto", "_rest", _HASH, _BUCKET)
    )


def draw_per_group(
    df: DataFrame, group: str, sizes: Mapping, seed: int = SEED, key: str = "encounter_id"
) -> DataFrame:
    """Exactly `sizes[g]` rows of each group g without replacement, no others; an error
    for a group with fewer.
    """
    kind = df.schema[group].dataType
    schema = StructType([StructField("_group", kind), StructField("_size", LongType())])
    wanted = df.sparkSession.createDataFrame(list(sizes.items()), schema)
    rows = df.filter(F.col(group).isin(*sizes))
    reached = _cutoffs(rows.select(group, key), map_codes(group, sizes), seed, key, [group])
    what = F.concat(F.lit(f"{group} = "), F.col("_group").cast("string"))
    total = F.coalesce("_total", F.lit(0))
    cutoffs = wanted.join(reached, F.col("_group") == F.col(group), "left").select(
        "_group", _checked(F.col("_size"), total, F.col("_upto"), what).alias("_upto"), "_rest"
    )
    # As many cutoffs as groups were named, so the broadcast is bounded.
    near = (
        _hashed(rows, seed, key)
        .join(F.broadcast(cutoffs), F.col(group) == F.col("_group"))
        .filter(F.col(_BUCKET) <= F.col("_upto"))
        .drop("_group")
    )
    return _take(near, [group], key)


def balanced_sample(
    df: DataFrame,
    label: str,
    n_per_class: int,
    seed: int = SEED,
    key: str = "encounter_id",
    classes: Sequence = (1, 0),
) -> DataFrame:
    """Exactly n rows per class without replacement; an error for a short class."""
    return draw_per_group(df, label, {c: n_per_class for c in classes}, seed, key)


def uniform_sample(
    df: DataFrame, n: int, seed: int = SEED, key: str = "encounter_id"
) -> DataFrame:
    """Exactly n rows without replacement; an error when there are fewer."""
    upto = _checked(F.lit(n), F.col("_total"), F.col("_upto"), F.lit("all rows"))
    reached = _cutoffs(df.select(key), F.lit(n), seed, key, [])
    cutoff = reached.select(F.struct(upto.alias("u"), "_rest")).scalar()
    near = (
        _hashed(df, seed, key)
        .withColumn("_cut", cutoff)
        .filter(F.col(_BUCKET) <= F.col("_cut.u"))
        .select("*", F.col("_cut.u").alias("_upto"), "_cut._rest")
        .drop("_cut")
    )
    return _take(near, [], key)


def shuffle(
    df: DataFrame, seed: int = SEED, key: str = "encounter_id", position: str | None = None
) -> DataFrame:
    """All rows in an order that depends on seed and key alone.

    With `position` the rows come numbered 1, 2, … instead of sorted: each hash
    prefix is numbered on its own, from the count of the rows before it, so that no
    task sees more than one prefix.
    """
    h = seeded_hash(seed, key)
    if position is None:
        return df.orderBy(h, key)
    rows = df.withColumn(_HASH, h).withColumn(_BUCKET, F.substring(_HASH, 1, NUMBER_DIGITS))
    counts = rows.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(_BUCKET)) - F.col("_n")
    starts = counts.select(_BUCKET, before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(_BUCKET).orderBy(_HASH, key))
    return (
        rows.join(F.broadcast(starts), _BUCKET)
        .withColumn(position, F.col("_before") + place)
        .drop(_BUCKET, _HASH, "_before")
    )


def labelling_sample(
    df: DataFrame,
    n: int = LABELLING_ROWS,
    outcome: str = "admitted",
    seed: int = SEED,
    key: str = "encounter_id",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """n/2 rows of each class in shuffled order, numbered by `position`.

    Keeps the named columns only; the class is not shown to the labeller.
    """
    drawn = balanced_sample(df, outcome, n // 2, seed, key)
    numbered = shuffle(drawn, seed + 1, key, "position")
    return numbered if columns is None else numbered.select("position", *columns)


def sample_df(df: DataFrame, n: int, seed: int = 42, by: Sequence[str] | None = None) -> DataFrame:
    """n rows, or all if there are fewer, in one pass and without a count.

    They are the first by md5 of seed and row (or of the columns `by`, where those tell rows
    apart): each task keeps its first n and these are merged, so no partition is favoured, and
    any partitioning gives the same rows. For a look at a table; n rows pass one task.
    """
    columns = list(df.columns if by is None else by)
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *texts))
    return df.orderBy(order, *[F.col(f"`{c}`").cast("string") for c in columns]).limit(n)
