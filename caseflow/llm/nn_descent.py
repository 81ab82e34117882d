"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Equal vectors become one node. The first graph joins the nodes of random cells (sides of
random hyperplanes). Each round of NN-descent then lets the neighbours of every node, in
and out, meet one another, and each keeps the nearest it has met; the vectors travel in
eight bits a component for this. A query walks the graph from its own node: each step
looks at the neighbours of all nodes of its beam not yet expanded and keeps the nearest,
until the beam has been expanded whole. Steps of all queries are joins; scores are exact,
in double precision, on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import discard_staged, require, stage

#: Out-neighbours of a node; in-neighbours kept beside them.
DEGREE = 32
#: Of each, so many meet in a round.
MEETING = 20
#: What a node reports of each meeting.
REPORTED = 10
ROUNDS = 4
TABLES = 3
CELL = 256
#: Nodes that the beam of a query holds.
BEAM = 192
#: Vectors scored in one group, about, and queries they are scored for.
BUCKET = 4_096
ASKING = 16_384
#: Random groups a node is in, and their size, about: it is linked to two of each, however far.
FAR_TABLES = 3
FAR_GROUP = 8
SEED = 5
_PAIRS_AT_ONCE = 50_000
#: Of the hash that Spark calls `xxhash64`.
_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
_EDGES = "a bigint, c bigint, sim float"


def usable(vectors: DataFrame) -> DataFrame:
    """Columns vec_id, embedding (doubles) of the vectors that take part: not NULL, not
    zero, all components finite numbers, and of the commonest length (of several, the
    longest). Without vec_id a vector has no name and takes no part."""
    rows = require(vectors, "vec_id", "embedding").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter("vec_id is not null and embedding is not null").filter(finite & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.filter(F.size("embedding") == (sizes[0]["n"] if sizes else 0))


def _code(embedding: np.ndarray) -> bytes:
    scale = np.float32(np.abs(embedding).max() / 127)
    return scale.tobytes() + np.round(embedding / scale).astype(np.int8).tobytes()


def _decode(codes: pa.Array) -> np.ndarray:
    """The vectors of codes, which are all as long."""
    starts = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + len(codes) + 1]
    raw = np.frombuffer(codes.buffers()[2], np.uint8)[starts[0] : starts[-1]].reshape(len(codes), -1)
    return raw[:, 4:].copy().view(np.int8).astype(np.float32) * raw[:, :4].copy().view(np.float32)


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys start, and the end of the last one."""
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]))


def make_nodes(vectors: DataFrame) -> DataFrame:
    """A node per different vector: id (its smallest vec_id), embedding, code."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [_code(np.asarray(e.as_py())) for e in batch.column("embedding")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], ["id", "embedding", "code"])

    different = vectors.groupBy("embedding").agg(F.min("vec_id").alias("id")).select("id", "embedding")
    return different.mapInArrow(encode, "id bigint, embedding array<double>, code binary")


def _meet(reported: int):
    """Over rows (grp, id, least, code) sorted by group: for each member of a group the
    nearest others that are nearer than its `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        out: list[tuple] = []
        size = 0

        def close() -> None:
            nonlocal size, held
            out.append(met(*(held[0] if len(held) == 1 else map(np.concatenate, zip(*held)))))
            size += len(out[-1][0])
            held = []

        for batch in batches:
            if not batch.num_rows:
                continue
            grp, ids, least = (batch.column(c).to_numpy() for c in ("grp", "id", "least"))
            v = _decode(batch.column("code"))
            starts = _starts(grp)
            for s, e in zip(starts[:-1], starts[1:]):
                if held and grp[s] != last:
                    close()
                last = grp[s]
                held.append((ids[s:e], least[s:e], v[s:e]))
                if size > 200_000:
                    yield packed(out)
                    out, size = [], 0
        if held:
            close()
        if out:
            yield packed(out)

    def met(ids: np.ndarray, least: np.ndarray, v: np.ndarray) -> tuple:
        sims = v @ v.T
        sims[np.equal.outer(ids, ids)] = -np.inf
        sims[sims <= least[:, None]] = -np.inf
        if len(ids) > reported:
            best = np.argpartition(-sims, reported - 1, axis=1)[:, :reported]
        else:
            best = np.broadcast_to(np.arange(len(ids)), sims.shape)
        near = np.take_along_axis(sims, best, axis=1)
        i, j = np.nonzero(near > -np.inf)
        return ids[i], ids[best[i, j]], near[i, j]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "c", "sim"])

    return run


def _met(members: DataFrame, reported: int) -> DataFrame:
    grouped = members.select("grp", "id", "least", "code").repartition("grp").sortWithinPartitions("grp")
    return grouped.mapInArrow(_meet(reported), _EDGES)


def _nearest(edges: DataFrame, key: str, other: str, keep: int) -> DataFrame:
    """The `keep` nearest `other` of each `key`. Spark limits each key before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("sim"), other)
    return edges.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= keep).drop("_place")


def _different(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a", "c").agg(F.max("sim").alias("sim"))


def first_graph(nodes: DataFrame, count: int, degree: int = DEGREE, tables: int = TABLES, cell: int = CELL) -> DataFrame:
    """Edges (a, c, sim) to the nearest nodes in the same random cell, over some tables.

    Cells of more nodes than twice `cell` are split at random.
    """
    bits = max(0, math.ceil(math.log2(max(count, 1) / cell)))

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _decode(batch.column("code"))
            planes = np.random.default_rng(SEED).standard_normal((v.shape[1], tables * max(bits, 1)))
            side = (v @ planes > 0).reshape(len(v), tables, -1)
            cells = (side * (1 << np.arange(max(bits, 1)))).sum(axis=2) * (bits > 0) + (np.arange(tables) << 48)
            ids = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, tables)), pa.array(cells.ravel().astype(np.int64))], ["id", "cell"]
            )

    cells = stage(nodes.select("id", "code").mapInArrow(sides, "id bigint, cell bigint"))
    counts = cells.groupBy("cell").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("id", "cell"), F.greatest(F.ceil(F.col("n") / (2 * cell)), F.lit(1)))
    split = cells.join(counts, "cell").select("id", F.xxhash64("cell", part).alias("grp"))
    members = split.join(nodes.select("id", "code"), "id").withColumn("least", F.lit(float("-inf")).cast("float"))
    return _nearest(_different(_met(members, degree)), "a", "c", degree)


def descend(nodes: DataFrame, graph: DataFrame, turn: int, degree: int = DEGREE) -> DataFrame:
    """One round of NN-descent: the graph of the nearest met so far.

    Neighbours out and in meet at each node, `MEETING` of either, drawn anew each round.
    """
    draw = F.xxhash64("a", "c", F.lit(turn))
    out_of = graph.select(F.col("a").alias("grp"), F.col("c").alias("id"), draw.alias("sim"))
    into = graph.select(F.col("c").alias("grp"), F.col("a").alias("id"), draw.alias("sim"))
    members = _nearest(out_of, "grp", "id", MEETING).union(_nearest(into, "grp", "id", MEETING)).select("grp", "id").distinct()
    least = graph.groupBy("a").agg(F.min("sim").alias("s"), F.count("*").alias("n"))
    floor = F.when(F.col("n") >= degree, F.col("s")).otherwise(F.lit(float("-inf"))).cast("float")
    known = nodes.select("id", "code").join(least, nodes["id"] == least["a"], "left").select(
        "id", "code", F.coalesce(floor, F.lit(float("-inf")).cast("float")).alias("least")
    )
    found = _met(members.join(known, "id"), REPORTED)
    return _nearest(_different(graph.select("a", "c", "sim").union(found)), "a", "c", degree)


def far_links(nodes: DataFrame, count: int) -> DataFrame:
    """Edges (a, c) between nodes that follow one another in small random groups. They join
    clusters that are far from all others to the rest."""
    tables = [nodes.select("id", F.lit(t).alias("table"), F.xxhash64("id", F.lit(t)).alias("h")) for t in range(FAR_TABLES)]
    rows = reduce(DataFrame.union, tables).withColumn("grp", F.pmod("h", F.lit(max(1, count // FAR_GROUP))))
    group = Window.partitionBy("table", "grp").orderBy("h", "id")
    pairs = rows.select(F.col("id").alias("a"), F.lead("id").over(group).alias("c")).filter("c is not null")
    return pairs.union(pairs.select("c", "a"))


def build_graph(nodes: DataFrame, rounds: int = ROUNDS, degree: int = DEGREE) -> DataFrame:
    """Columns id, near: each node with its neighbours, out and in (`degree` of either), and
    some far ones."""
    count = nodes.count()
    graph = stage(first_graph(nodes, count, degree))
    for turn in range(rounds):
        graph = stage(descend(nodes, graph, turn, degree))
    into = _nearest(graph.select(F.col("c").alias("a"), F.col("a").alias("c"), "sim"), "a", "c", degree)
    both = graph.select("a", "c").union(into.select("a", "c")).union(far_links(nodes, count))
    return both.groupBy("a").agg(F.collect_set("c").alias("near")).withColumnRenamed("a", "id")


def _hashed(ids: np.ndarray) -> np.ndarray:
    """What Spark's `xxhash64` makes of each of these longs."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in _PRIMES)

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    h = np.uint64((42 + _PRIMES[4] + 8) % 2**64) ^ (turned(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1)
    h = turned(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _ask(buckets: int):
    """Over rows (q, known, ids) sorted by the first two: a row for each query and bucket of
    nodes, with those of the query's ids that are not known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, new, known = None, [], []
        out: list[tuple] = []
        size = 0

        def close() -> None:
            nonlocal size
            c = np.setdiff1d(np.concatenate(new), np.concatenate(known)) if new else np.empty(0, np.int64)
            if len(c):
                bucket = _hashed(c) % buckets
                order = np.argsort(bucket, kind="stable")
                c, bucket = c[order], bucket[order]
                starts = _starts(bucket)
                out.append((bucket[starts[:-1]], np.full(len(starts) - 1, last), np.diff(starts), c))
                size += len(c)
            new.clear()
            known.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            q, told, lists = batch.column("q").to_numpy(), batch.column("known").to_numpy(zero_copy_only=False), batch.column("ids")
            at, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
            starts = _starts(q)
            for s, e in zip(starts[:-1], starts[1:]):
                if q[s] != last:
                    close()
                last, m = q[s], s + np.count_nonzero(~told[s:e])
                if m > s:
                    new.append(ids[at[s] : at[m]])
                known.append(ids[at[m] : at[e]])
                if size > 500_000:
                    yield packed(out)
                    out, size = [], 0
        close()
        if out:
            yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        bucket, q, sizes, c = (np.concatenate(x) for x in zip(*out))
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(c))
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(q), ids], ["bucket", "q", "ids"])

    return run


def _score(beam: int):
    """Scores of the nodes of one bucket (rows with an id) that queries ask for (rows with
    ids), the best of each query."""

    def run(group: pa.Table) -> pa.Table:
        is_ask = group.column("ids").is_valid()
        nodes, asks = group.filter(pc.invert(is_ask)), group.filter(is_ask)
        q, least = asks.column("id").to_numpy(), asks.column("least").to_numpy()

        def matrix(rows: pa.Table) -> np.ndarray:
            flat = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return flat.reshape(rows.num_rows, -1)

        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(q):
            ids, queries, vectors = nodes.column("id").to_numpy(), matrix(asks), matrix(nodes)
            by_id = np.argsort(ids)
            sorted_ids = ids[by_id]
            lists = asks.column("ids").combine_chunks()
            at_q, c = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
            for s in range(0, len(c), _PAIRS_AT_ONCE):
                of, to = at_q[s : s + _PAIRS_AT_ONCE], c[s : s + _PAIRS_AT_ONCE]
                scores = np.einsum("ij,ij->i", queries[of], vectors[by_id[np.searchsorted(sorted_ids, to)]])
                # A score equal to the beam's last may still win by its smaller id.
                kept = scores >= least[of]
                found.append((q[of[kept]], to[kept], scores[kept]))
        q, c, scores = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((c, -scores, q))
        q, c, scores = q[order], c[order], scores[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < beam
        return pa.table({"q": q[best], "c": c[best], "score": scores[best]})

    return run


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """Columns q, c, score: the beam of each query node (column q: its id) at the end.

    The walk of a query starts at its own node, which is in its beam. It ends when all of
    the beam has been expanded. No node enters a beam again that has fallen out of it, so
    every walk ends.

    In a step, the nodes a query looks at are one list for each bucket of nodes. Lists are
    dealt by bucket and, if many ask, by query; a vector goes, once, to the groups of its bucket.
    """
    count = nodes.count()
    buckets, parts = max(1, -(-count // BUCKET)), max(1, -(-queries.count() // ASKING))
    no_score, no_ids = F.lit(None).cast("double"), F.lit(None).cast("array<bigint>")
    vectors = nodes.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"))
    own = stage(queries.join(nodes.select(F.col("id").alias("q"), "embedding"), "q"))
    state = stage(own.select("q", F.col("q").alias("c"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x).alias("score"), F.lit(False).alias("done")))
    while True:
        fresh = state.filter("not done")
        if fresh.isEmpty():
            break
        reached = fresh.join(graph, fresh["c"] == graph["id"]).select("q", F.lit(False).alias("known"), F.col("near").alias("ids"))
        listed = reached.union(state.select("q", F.lit(True), F.array("c"))).repartition("q").sortWithinPartitions("q", "known")
        looked = stage(listed.mapInArrow(_ask(buckets), "bucket bigint, q bigint, ids array<bigint>"))
        floor = state.groupBy("q").agg(F.min("score").alias("s"), F.count("*").alias("n"))
        floor = floor.select("q", F.when(F.col("n") >= beam, F.col("s")).otherwise(float("-inf")).alias("least"))
        stored = vectors
        if (looked.agg(F.sum(F.size("ids"))).first()[0] or 0) < count:
            stored = vectors.join(looked.select(F.explode("ids").alias("id")).distinct(), "id", "left_semi")
        part = F.pmod(F.xxhash64("q", F.lit(1)), F.lit(parts))
        asking = looked.join(own.join(floor, "q"), "q").select((F.col("bucket") * parts + part).alias("bucket"), F.col("q").alias("id"), "embedding", "least", "ids")
        to_parts = F.explode(F.sequence(F.col("bucket") * parts, F.col("bucket") * parts + parts - 1))
        rows = stored.select(to_parts.alias("bucket"), "id", "embedding", no_score, no_ids)
        scored = asking.union(rows).groupBy("bucket").applyInArrow(_score(beam), "q bigint, c bigint, score double")
        both = state.withColumn("done", F.lit(True)).union(scored.withColumn("done", F.lit(False)))
        order = Window.partitionBy("q").orderBy(F.desc("score"), "c")
        both = both.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= beam).drop("_place")
        state = stage(both)
        discard_staged(looked)
    return state.select("q", "c", "score")


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int, rounds: int = ROUNDS, beam: int = BEAM) -> DataFrame:
    """Columns query_id, rank (from 1), vec_id, score: for each vector for which the
    condition `queries` holds, the `k` nearest others found.

    Nearness is the inner product in double precision, ties go to the smaller vec_id. All
    candidates are returned if there are fewer than `k`. See `usable` for what takes part.
    Rows of one vec_id are one vector if equal; of unlike ones the smallest counts.
    """
    rows = usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = stage(rows)
    nodes = stage(make_nodes(rows))
    # Of equal vectors at most k + 1, the smallest ids, can be among a query's nearest.
    names = rows.join(nodes.select("id", "embedding"), "embedding").select("id", "vec_id")
    names = stage(names)
    first = Window.partitionBy("id").orderBy("vec_id")
    members = names.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1).drop("_n")
    asked = names.filter(queries).select(F.col("id").alias("q"), F.col("vec_id").alias("query_id"))
    asked = stage(asked)
    graph = stage(build_graph(nodes, rounds))
    found = search(nodes, graph, asked.select("q").distinct(), beam)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    best = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
    named = best.join(members, best["c"] == members["id"]).select("q", "vec_id", "score")
    by_node = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("_n", F.row_number().over(by_node)).filter(F.col("_n") <= k + 1).drop("_n")
    answers = asked.join(named, "q").filter("vec_id <> query_id")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
