"""Connected components by alternating stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import discard, write_staged


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the smallest node it knows."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.filter(F.col("v") > F.col("u")).join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Join every smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    roots = least.select("u", F.col("m").alias("v"))
    return linked.union(roots).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns (node, component) for the nodes of `edges` (columns u, v, long).

    The component is the smallest node reachable. Every round reads and writes edges in
    the shared folder, never more of them than at first, and drops the round before; the
    number of rounds grows with the logarithm of the longest path. Loops (u = v), repeated
    edges and NULL ends are left out; no edges give no rows.
    """
    spark = edges.sparkSession
    path = write_staged(edges.select("u", "v").filter("u <> v"))
    schema = "u bigint, v bigint"
    before = None
    while True:
        rows = spark.read.schema(schema).parquet(path)
        after = rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if after == before or not after[0]:
            break
        before = after
        following = write_staged(_small_star(_large_star(rows)))
        discard(spark, path)
        path = following
    stars = spark.read.schema(schema).parquet(path)
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(stars.select("v", "v")).distinct()


def independent(edges: DataFrame, first: DataFrame, members: DataFrame | None = None, linked: DataFrame | None = None) -> DataFrame:
    """Column node: nodes without an edge among them, such that every other node of `edges`
    (columns u, v, long) has one to them. Nodes of `first` (column node) come before others;
    otherwise the order is by hash.

    `members` (node, group; a node has one group) and `linked` (group, near; both ways) stand
    for edges that are not listed: of each node of `group` to all other nodes of `near`.

    A node is taken when it comes before all undecided neighbours, which then go. Orders by
    hash need a number of rounds that grows with the logarithm of the nodes.
    """
    spark = edges.sparkSession
    heads = first.select(F.col("node").alias("_node"), F.lit(0).alias("_rank")).distinct()

    def with_order(rows: DataFrame, end: str) -> DataFrame:
        order = F.struct(F.coalesce("_rank", F.lit(1)).alias("rank"), F.xxhash64(end).alias("hash"), F.col(end).alias("node"))
        return rows.join(heads, F.col(end) == F.col("_node"), "left").withColumn(f"o{end}", order).drop("_node", "_rank")

    rows = with_order(with_order(_both_ways(edges.filter("u <> v")).distinct(), "u"), "v")
    schema, path = rows.schema, write_staged(rows)
    if members is not None:
        grouped = with_order(members.select(F.col("node").alias("u"), "group"), "u")
        in_groups, group_path = grouped.schema, write_staged(grouped)
    taken = None
    while True:
        rows = spark.read.schema(schema).parquet(path)
        grouped = None if members is None else spark.read.schema(in_groups).parquet(group_path)
        if rows.isEmpty() and (grouped is None or grouped.isEmpty()):
            break
        offers = rows.select("u", "ou", F.col("ov").alias("o"))
        if grouped is not None:
            least = grouped.groupBy("group").agg(F.min("ou").alias("o")).withColumnRenamed("group", "near")
            around = linked.select("group", "near").join(least, "near").groupBy("group").agg(F.min("o").alias("o"))
            offers = offers.union(grouped.join(around, "group", "left").select("u", "ou", F.coalesce("o", "ou")))
        firsts = offers.groupBy("u").agg(F.min("o").alias("least"), F.first("ou").alias("ou")).filter("ou <= least").select("u")
        new = spark.read.schema("u bigint").parquet(write_staged(firsts))
        taken = new if taken is None else taken.union(new)
        gone = rows.join(new, "u", "left_semi").select(F.col("v").alias("u")).union(new)
        if grouped is not None:
            ended = linked.select("group", "near").join(grouped.join(new, "u", "left_semi").select("group").distinct(), "group")
            near = ended.select(F.col("near").alias("group")).distinct()
            gone = gone.union(grouped.join(near, "group", "left_semi").select("u"))
        gone_path = write_staged(gone.distinct())
        gone = spark.read.schema("u bigint").parquet(gone_path)
        left = rows.join(gone, "u", "left_anti").join(gone.withColumnRenamed("u", "v"), "v", "left_anti")
        # A node whose neighbours have all gone has no rows: it is taken too.
        alone = rows.select("u").distinct().join(gone, "u", "left_anti").join(left.select("u").distinct(), "u", "left_anti")
        if grouped is not None:
            alone = alone.join(grouped, "u", "left_anti")  # those are taken by their groups
            following = write_staged(grouped.join(gone, "u", "left_anti").select(*in_groups.names))
        taken = taken.union(spark.read.schema("u bigint").parquet(write_staged(alone)))
        old, path = path, write_staged(left.select(*schema.names))
        discard(spark, old)
        if grouped is not None:
            discard(spark, group_path)
            group_path = following
        discard(spark, gone_path)
    return (taken if taken is not None else edges.select("u").limit(0)).select(F.col("u").alias("node"))
