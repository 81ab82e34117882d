"""One CSV file read by many tasks, though quoted fields span lines.

Whether a line break ends a record depends on how many quotes come before it, that is on
the parity of their number: a doubled quote changes nothing. So the lines of each byte range
are counted for their quotes, each range's parity is the sum of those before it, and inside
a range a line that starts after an even number of quotes starts a record. The lines of a
record are put together in its range; only records that reach over the end of a range are
gathered from several. Lines move once, to number them inside their range.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.sources.tables import stage_table

#: File, byte range of it, place in the range, text.
_LINES = ("_file", "_range", "_line", "_text")


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files below `path`, with the byte range that each was read in."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_range"),
        # Lines of a range are read by one task in order.
        F.monotonically_increasing_id().alias("_line"),
        F.col("value").alias("_text"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("_quotes"),
    )


def csv_records(lines: DataFrame) -> DataFrame:
    """The records of `lines` as text: _file, _range and _number, which order the records of
    a file, and _record."""
    by_range = lines.groupBy("_file", "_range").agg(F.sum("_quotes").alias("_sum"))
    earlier = Window.partitionBy("_file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per byte range; of a range, whether it starts inside a quoted field.
    inside = by_range.select(
        F.col("_file").alias("_of"), F.col("_range").alias("_at"), F.coalesce(F.sum("_sum").over(earlier) % 2, F.lit(0)).alias("_open")
    )
    here = Window.partitionBy("_file", "_range").orderBy("_line")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    known = lines.join(inside, (F.col("_file") == F.col("_of")) & (F.col("_range") == F.col("_at")))
    parity = (F.col("_open") + F.coalesce(F.sum("_quotes").over(before), F.lit(0))) % 2
    starts = known.select(*_LINES, "_quotes", (parity == 0).cast("int").alias("_starts"))
    # Record 0 of a range is the rest of one that started before it.
    numbered = starts.withColumn("_number", F.sum("_starts").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = numbered.groupBy("_file", "_range", "_number").agg(
        F.array_sort(F.collect_list(F.struct("_line", "_text"))).alias("_rows"), F.sum("_quotes").alias("_quotes")
    )
    pieces = stage_table(
        pieces.select("_file", "_range", "_number", F.array_join(F.col("_rows._text"), "\n").alias("_record"), "_quotes")
    )
    whole = (F.col("_number") > 0) & (F.col("_quotes") % 2 == 0)
    return pieces.filter(whole).drop("_quotes").unionByName(_across(pieces.filter(~whole)))


def _across(pieces: DataFrame) -> DataFrame:
    """Records that reach over the end of a range: a start, and the rests in the ranges
    after it up to the one that closes it."""
    order = Window.partitionBy("_file").orderBy("_range", "_number")
    # Of a range, its rest comes before its own unfinished record. The order is worked out
    # without the texts.
    first = F.sum((F.col("_number") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    place = ["_file", "_range", "_number"]
    joined = pieces.select(*place).withColumn("_first", first).join(pieces.select(*place, "_record"), place)
    joined = joined.groupBy("_file", "_first").agg(
        F.array_sort(F.collect_list(F.struct("_range", "_number", "_record"))).alias("_rows")
    )
    head = F.col("_rows")[0]
    return joined.select(
        "_file", head["_range"].alias("_range"), head["_number"].alias("_number"), F.array_join(F.col("_rows._record"), "\n").alias("_record")
    )


def _fields(record: Column | str, size: int, dialect: Mapping) -> Column:
    """The fields of a record as an array of texts."""
    names = [f"_c{i}" for i in range(size)]
    options = {k: str(v) for k, v in dialect.items() if k != "header"} | {"mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    row = F.from_csv(record, ", ".join(f"{n} string" for n in names), options)
    return F.array(*[row[n] for n in names])


def read_by_header(spark: SparkSession, path: str, dialect: Mapping, wanted: list[str], first: str | None = None) -> DataFrame:
    """The `wanted` columns, as texts, of all files below `path`, each by its own header.

    With `first` the first column of every file, which has no name, gets that one. A file
    that lacks a column is an error; one without a line has no rows.
    """
    records = csv_records(csv_lines(spark, path))
    heads = records.groupBy("_file").agg(F.min(F.struct("_range", "_number", "_record")).alias("_head"))
    heads = heads.select(F.col("_file").alias("_of"), "_head")
    # Different headers are few, however many files there are.
    layouts = [r[0] for r in heads.select("_head._record").distinct().orderBy(F.col("_record")).collect()]
    if not layouts:
        raise ValueError(f"{path}: no header")
    size = max(h.count(",") for h in layouts) + 1
    names = {
        h: list(r)
        for h, r in spark.createDataFrame([(h,) for h in layouts], "h string")
        .select("h", _fields(F.rtrim("h", F.lit("\r")), size, dialect))
        .collect()
    }
    for header in layouts:
        missing = [c for c in wanted if c not in names[header]]
        if missing:
            raise ValueError(f"{path}: missing columns {missing}; found {[n for n in names[header] if n is not None]}")
    if len(layouts) == 1:
        body = records.filter(F.col("_record") != layouts[0]).unionByName(_repeated(records, heads, layouts[0]))
        layout = F.lit(layouts[0])
    else:
        joined = records.join(heads, F.col("_file") == F.col("_of"))
        head = F.col("_head")
        body = joined.filter((F.col("_range") != head["_range"]) | (F.col("_number") != head["_number"]))
        layout = head["_record"]
    # Of a file whose header ends with a carriage return, so do all lines.
    plain = F.when(layout.endswith("\r"), F.regexp_replace("_record", "\r(?=\n|$)", "")).otherwise(F.col("_record"))
    body = body.withColumn("_layout", layout).withColumn("_record", plain)
    # A line without a character is no record; an empty field in quotes is one.
    body = body.filter(F.col("_record") != "").withColumn("_fields", _fields(F.col("_record"), size, dialect))
    layout = F.col("_layout")

    def by_layout(place) -> Column:
        return F.coalesce(*[F.when(layout == h, F.col("_fields")[place(names[h])]) for h in layouts])

    columns = [by_layout(lambda header, c=c: header.index(c)).alias(c) for c in wanted]
    if first is not None:
        columns.insert(0, by_layout(lambda header: 0).alias(first))
    return body.select(*columns)


def _repeated(records: DataFrame, heads: DataFrame, header: str) -> DataFrame:
    """Rows that read like the header but are not the first of their file."""
    same = records.filter(F.col("_record") == header)
    head = F.col("_head")
    there = same.join(heads, F.col("_file") == F.col("_of"))
    return there.filter((F.col("_range") != head["_range"]) | (F.col("_number") != head["_number"])).select(*records.columns)
