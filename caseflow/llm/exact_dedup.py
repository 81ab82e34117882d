"""Exact duplicates by a tree-merge of sorted digest runs.

The rows of an input partition make a run: one record per different text, sorted by the
SHA-256 of the text without blanks, with the row that stays and the number of rows. In each
round up to `FAN` groups of runs exchange them: every group's runs are cut into as many
slices of digests as it has partitions, and a partition merges its slice of the runs of all
groups that join. So after each round there are fewer groups, of more and narrower slices,
and as many partitions as before; after the last round each digest lies in one place. A
partition reads from `FAN` others in a round, not from all, and of a text however common a
partition never gets more than `FAN` records in a round.

The results go down the same tree: the record of a merged run tells the records it was made
of, and those of the first runs their rows. Texts meet only if the 256 bits of the digest, a
second hash of 64 bits and the length of the text without blanks agree, at every level.
Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import discard, require, unused, write_staged

#: Groups of runs that are merged in one round.
FAN = 16
#: Characters that do not tell texts apart.
BLANKS = " \t\n\x0b\x0c\r"
#: Digests are cut into slices by so many first bits.
_PLACE_BITS = 24
#: What makes texts equal.
_SAME = ("digest", "second", "length")


def without_blanks(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def digested(docs: DataFrame) -> DataFrame:
    """A narrow row per row of `docs`: run (its partition), row, doc_id, n_chars, digest and
    the two other marks of its text, place (the first bits of the digest)."""
    rows = require(docs, "doc_id", "text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.select("doc_id", F.char_length("text").alias("n_chars"), without_blanks(F.col("text")).alias("bare"))
    rows = rows.select(
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "n_chars",
        F.sha2("bare", 256).alias("hex"),
        F.xxhash64("bare").alias("second"),
        F.char_length("bare").alias("length"),
    )
    place = F.conv(F.substring("hex", 1, _PLACE_BITS // 4), 16, 10).cast("bigint")
    return rows.withColumns({"place": place, "digest": F.unhex("hex")}).drop("hex")


def rounds(runs: int, fan: int = FAN) -> list[tuple[int, int, int]]:
    """Per round: groups that become one, groups left, slices of each."""
    out, slices = [], 1
    while runs > 1:
        joined = min(fan, runs)
        runs, slices = -(-runs // joined), slices * joined
        out.append((joined, runs, slices))
    return out


def _part(group: Column, slices: int) -> Column:
    """The partition of a record: its group's, for its slice of the digests."""
    return (group * slices + F.shiftright(F.col("place") * slices, _PLACE_BITS)).cast("int")


def first_runs(rows: DataFrame) -> DataFrame:
    """One record per run and text: the row that stays (`best`: the longest text, then the
    smallest doc_id, a row without one last) and the number of rows."""
    best = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    return rows.groupBy(F.col("run").alias("group"), *_SAME, "place").agg(F.min(best).alias("best"), F.count("*").alias("n"))


def merge(records: DataFrame, joined: int, groups: int, slices: int) -> DataFrame:
    """One round: the sorted runs of `joined` groups become one, in slices."""
    group = F.floor(F.col("group") / joined).cast("int")
    moved = records.withColumn("group", group).withColumn("part", _part(group, slices))
    dealt = moved.repartitionById(groups * slices, "part").sortWithinPartitions("part", "group", *_SAME, "place")
    merged = dealt.groupBy("part", "group", *_SAME, "place").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    return merged.drop("part")


def duplicate_groups(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256 (of the text
    without blanks), n_chars.

    Texts are equal that are so after deleting blanks and line ends (space, U+0009 to
    U+000D); NULL counts as empty. Of equal texts the row with the most characters stays,
    then the one with the smallest doc_id; rows without doc_id come last. Of rows repeated
    with one doc_id and text, one is `kept`. Other columns do not matter; an empty table
    gives no rows.
    """
    if fan < 2:
        raise ValueError("fan must be at least 2")
    spark = docs.sparkSession
    leaf = digested(docs)
    rows = spark.read.schema(leaf.schema).parquet(write_staged(leaf))
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    plan = rounds(runs, fan)
    paths = [write_staged(first_runs(rows))]
    schema = first_runs(rows).schema
    for step in plan:
        paths.append(write_staged(merge(spark.read.schema(schema).parquet(paths[-1]), *step)))
    levels = [spark.read.schema(schema).parquet(path) for path in paths]

    # Only texts of several rows have something to tell on the way down.
    told = levels[-1].filter("n > 1").select("group", *_SAME, F.col("best").alias("keeper"), F.col("n").alias("size"))
    for level, (joined, _, _) in zip(levels[-2::-1], plan[::-1]):
        below = level.select("group", *_SAME, F.floor(F.col("group") / joined).cast("int").alias("above"))
        told = below.join(told.withColumnRenamed("group", "above"), ["above", *_SAME]).drop("above")
    path = write_staged(told)
    told = spark.read.schema(told.schema).parquet(path)
    for done in paths:
        discard(spark, done)

    shared = rows.join(told.withColumnRenamed("group", "run"), ["run", *_SAME], "left")
    alone = F.col("size").isNull()
    return shared.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("keeper.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("n_chars").cast("bigint").alias("n_chars"),
    )


def drop_duplicates(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """`docs` without the rows that are not kept, all columns as they are.

    Of rows repeated with one doc_id and text any one stays.
    """
    of, sha, chars = unused(docs, "_id", "_sha256", "_chars")
    kept = duplicate_groups(docs, fan).filter("kept").select(
        F.col("doc_id").alias(of), F.col("text_sha256").alias(sha), F.col("n_chars").alias(chars)
    )
    text = F.coalesce(docs["text"], F.lit(""))
    same = (
        docs["doc_id"].eqNullSafe(kept[of])
        & (F.sha2(without_blanks(text), 256) == kept[sha])
        & (F.char_length(text) == kept[chars])
    )
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])
