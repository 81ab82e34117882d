"""Orders placed during a visit, and their lists per visit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.values import as_column, within_visit
from caseflow.operators.dedupe import drop_duplicates
from caseflow.operators.skew import (
    FAN,
    MIN_HOT_ROWS,
    SALT,
    hot_keys,
    salted_join,
    spread_hot,
)
from caseflow.sources import stage_table

PART_ROWS = 1_000


def orders_during_visit(
    orders: DataFrame,
    visits: DataFrame,
    time: str,
    order_key: str,
    key: str = "encounter_id",
    start: str = "arrival_datetime",
    end: str = "departure_datetime",
    dedupe: bool = True,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Orders of a visit with start <= time <= end, visit times attached.

    The interval is part of the join condition. With `dedupe` a visit counts once.
    Without, every row of the visit counts: an order then comes with the number of
    rows it goes with as `copies`, instead of being repeated. The result is partitioned
    on the visit and its salt, which stay in it for `collect_per_key`.
    """
    hot = hot_keys(orders, key) if hot is None else hot
    times = visits.select(key, start, end)
    if dedupe:
        times = drop_duplicates(times, [key], [start, end])
    else:
        times = times.groupBy(key, start, end).agg(F.count(F.lit(1)).alias("copies"))
    return salted_join(
        spread_hot(orders, key, order_key, hot),
        times,
        key,
        hot,
        "inner",
        within_visit(time, start, end),
    )


def _instant(c: Column, kind: str) -> Column:
    """A number or point in time as a whole number that keeps the order."""
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    if kind == "date":
        return F.unix_date(c).cast("long")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return c.cast("long")
    raise ValueError(f"intervals of {kind} are not supported")


def orders_per_interval(
    orders: DataFrame,
    visits: DataFrame,
    time: str,
    key: str = "encounter_id",
    start: str = "arrival_datetime",
    end: str = "departure_datetime",
    copies: bool = False,
) -> DataFrame:
    """Every order with every row of its visit with start <= time <= end: the order's columns
    and the other columns of `visits`. With `copies`, each order once per different interval,
    with the interval's times and the number of such rows as `copies`.

    For keys with many intervals (and orders), as where a visit has a row per note: none of
    them is compared with all others of its key. Intervals are put into bins of time whose
    width is a power of two and at least their own length, so each lies in two bins at most;
    an order looks into its bin of each width there is, of which there are 64 at most. Rows
    meet by key, width and bin, and the bounds are checked exactly. A missing key, time or
    bound matches nothing, nor does an interval that ends before it starts.
    """
    kinds = dict(visits.dtypes)
    if copies:
        visits = visits.groupBy(key, start, end).agg(F.count(F.lit(1)).alias("copies"))
    first, last = _instant(F.col(start), kinds[start]), _instant(F.col(end), kinds[end])
    valid = visits.filter(F.col(key).isNotNull() & (F.col(start) <= F.col(end)))
    # The least width of bins that is more than the length: bits of the length.
    measured = valid.withColumns({"_first": first, "_last": last})
    width = F.length(F.bin(F.col("_last") - F.col("_first")))
    measured = measured.withColumn("_width", width)
    widths = sorted(r[0] for r in measured.select("_width").distinct().collect())
    in_bins = [F.call_function("shiftright", F.col(c), F.col("_width")) for c in ("_first", "_last")]
    bins = F.sequence(*in_bins)
    binned = measured.withColumn("_bin", F.explode(bins)).drop("_first", "_last")
    binned = binned.withColumnRenamed(key, "_right_key")
    at = _instant(F.col(time), dict(orders.dtypes)[time])
    looks = F.array(*[F.struct(F.lit(w).alias("_of"), F.shiftright("_at", w).alias("_in")) for w in widths])
    if not widths:
        looks = looks.cast("array<struct<_of:int,_in:bigint>>")
    asked = orders.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("_at", at)
    asked = asked.select(*orders.columns, F.inline(looks))
    on = (F.col(key) == F.col("_right_key")) & (F.col("_of") == F.col("_width")) & (F.col("_in") == F.col("_bin"))
    joined = asked.join(binned, on & within_visit(time, start, end))
    return joined.drop("_right_key", "_of", "_in", "_width", "_bin")


def _ranked_by_range(rows: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """Add `_rank`, the place of each row among those of its key, without a task that has
    all of a key: rows are dealt out by ranges of (key, order), written, and numbered from
    the counts of the ranges before.
    """
    ranges = rows.repartitionByRange(key, *order_by).withColumn("_range", F.spark_partition_id())
    ranges = stage_table(ranges)  # the ranges are sampled anew in each run
    counts = ranges.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_at")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_key", "_at", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order_by))
    numbered = ranges.withColumn("_place", inside).join(
        before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at"))
    )
    return numbered.withColumn("_rank", F.col("_before") + F.col("_place")).select(*rows.columns, "_rank")


def collect_per_key(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    order_by: Sequence[str],
    suffix: str = "_list",
    part_rows: int = PART_ROWS,
    min_rows: int = MIN_HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Lists per key and column in pages: key, part, rows, lists; NULLs are skipped.

    Page `part` (from 0) holds entries part * part_rows and on of the key, in `order_by`
    order, and was made of `rows` rows: put end to end the pages are the whole list,
    whatever the page length and whichever keys are hot. No page is longer than
    `part_rows`, so no key is held in memory whole. `order_by` must tell the rows of a key
    apart. Rows salted by an earlier join are numbered where they are, but for those of
    `hot` keys (which that join was given), which are numbered by ranges.
    """
    hot = hot_keys(df, key, min_rows) if hot is None else hot
    rows = df if SALT in df.columns else spread_hot(df, key, F.xxhash64(*order_by), hot)
    names = list(dict.fromkeys([key, *columns, *order_by]))
    single = F.row_number().over(Window.partitionBy(key, SALT).orderBy(*order_by))
    ranked = rows.filter(F.col(FAN) == 1).withColumn("_rank", single).select(*names, SALT, "_rank")
    if not hot.isEmpty():
        spread = _ranked_by_range(rows.filter(F.col(FAN) > 1).select(*names), key, order_by)
        ranked = ranked.union(spread.select(*names, F.lit(0).alias(SALT), "_rank"))
    entry = F.struct(
        *[as_column(c).alias(f"_o{i}") for i, c in enumerate(order_by)],
        *[as_column(c).alias(f"_c{i}") for i, c in enumerate(columns)],
    )
    collected = (
        ranked.withColumn("part", F.floor((F.col("_rank") - 1) / F.lit(part_rows)).cast("long"))
        .groupBy(key, SALT, "part")
        .agg(F.array_sort(F.collect_list(entry)).alias("_rows"), F.count(F.lit(1)).alias("rows"))
    )
    return collected.select(
        key,
        "part",
        "rows",
        *[
            F.array_compact(F.col("_rows").getField(f"_c{i}")).alias(c + suffix)
            for i, c in enumerate(columns)
        ],
    )
