"""Hard negatives from blocks of candidates in Hilbert order, by interval bounds.

Candidates are sorted along a Hilbert curve through the components that vary most and
written to Parquet in blocks, each with its zone map: the least and greatest value of every
component, its labels and its smallest id. Interval arithmetic on a zone map bounds the
scores that a block can hold for an anchor, so that the other columns of a block are read
only where a bound meets what is looked for:

- positives: the block holds the anchor's label, and its upper bound is no worse than the
  last positive found in the few blocks that promise most;
- a window of negatives: the block holds another label, its bounds meet the window, and its
  upper bound is no worse than the last negative found likewise.

A bound is never below a score, so nothing is lost. Anchors go in batches, blocks in
stretches; one task scores one batch against one stretch and returns its best rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import require, stage, write_staged

#: Components become whole numbers by this factor.
SCALE = 256
#: The window of a negative's score, in hundredths of the positive's.
WINDOW = (30, 90)
POSITIVES, NEGATIVES = 5, 10
#: Vectors of a block, and components of a block at most.
BLOCK, BLOCK_VALUES = 256, 1 << 18
#: Blocks of a stretch; zone maps that are tested together; anchors of a batch.
STRETCH, ZONES, BATCH = 32, 1_024, 512
#: Blocks that are read first for each anchor or window.
FIRST = 2
#: Components on the curve, and bits of each.
AXES, BITS = 16, 4

_BLOCKS = "block bigint, low array<bigint>, high array<bigint>, kinds array<int>, least_id bigint, ids array<bigint>, labels array<int>, vectors binary"
_ZONES = ["block", "low", "high", "kinds", "least_id"]
_NEEDED = "block bigint, batch int"
_POSITIVES = "anchor_id bigint, positive_id bigint, score bigint"
_NEGATIVES = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, score bigint"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """Columns vec_id, label, comps (whole numbers) of the rows that take part: vec_id and
    label not NULL, the vector not NULL and all its components finite, as many as in most
    rows (of several numbers, the largest). Of rows that share a vec_id one takes part, the
    first by label and vector."""
    rows = require(vectors, "vec_id", "label", "embedding").select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("x"),
    )
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter("vec_id is not null and label is not null and x is not null").filter(finite)
    comps = F.transform("x", lambda v: F.floor(v * SCALE).cast("bigint"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", comps.alias("comps"))).alias("row")).select("vec_id", "row.*")
    rows = stage(rows)
    sizes = rows.groupBy(F.size("comps").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.filter(F.size("comps") == (sizes[0]["n"] if sizes else 0))


def hilbert_keys(places: np.ndarray, bits: int) -> list[bytes]:
    """Keys in the order of a Hilbert curve, for rows of whole numbers below 2**bits.

    Undoes, from the highest bit down, the turns and exchanges of the curve's cells; what
    remains is a Gray code, whose bits are put one axis after the other."""
    x = places.astype(np.int64).T.copy()
    axes = len(x)
    if not axes:
        return [b""] * places.shape[0]
    bit = 1 << (bits - 1)
    while bit > 1:
        below = bit - 1
        for i in range(axes):
            turned = (x[i] & bit) != 0
            exchanged = np.where(turned, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(turned, below, exchanged)
            x[i] ^= exchanged
        bit >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    digits = np.array([(x[i] >> b) & 1 for b in range(bits - 1, -1, -1) for i in range(axes)], np.uint8)
    return [row.tobytes() for row in np.packbits(digits, axis=0).T]


def _spread(rows: DataFrame) -> list[tuple[int, float, float]]:
    """Place, mean and deviation of the components that vary most."""
    values = rows.select(F.posexplode("comps").alias("at", "v"))
    stats = values.groupBy("at").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("dev"))
    return [(r["at"], r["mean"], r["dev"]) for r in stats.orderBy(F.desc("dev"), "at").limit(AXES).collect()]


def _matrix(batch: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    rows = batch.column(column).to_pylist()
    return np.array(rows, np.int64).reshape(len(rows), -1)


def _with_keys(spread: list[tuple[int, float, float]]):
    at = [s[0] for s in spread]
    mean, step = np.array([s[1] for s in spread]), np.array([max(s[2], 1e-9) for s in spread]) / 2 ** (BITS - 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = np.floor((_matrix(batch, "comps")[:, at] - mean) / step) + 2 ** (BITS - 1)
                keys = hilbert_keys(np.clip(cells, 0, 2**BITS - 1), BITS)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "curve"])

    return run


def _packed(size: int):
    """Blocks of `size` rows of a sorted partition, with their zone maps."""

    def block(number: int, rows: list[tuple]) -> tuple:
        ids, labels, comps = zip(*rows)
        matrix = np.array(comps, np.int64).reshape(len(rows), -1)
        low, high = matrix.min(axis=0).tolist(), matrix.max(axis=0).tolist()
        return (number, low, high, sorted(set(labels)), min(ids), list(ids), list(labels), matrix.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "comps"))):
                rows.append(row)
                if len(rows) == size:
                    yield table([block(number, rows)])
                    number, rows = number + 1, []
        if rows:
            yield table([block(number, rows)])

    def table(blocks: list[tuple]) -> pa.RecordBatch:
        integers, labels = pa.list_(pa.int64()), pa.list_(pa.int32())
        types = [pa.int64(), integers, integers, labels, pa.int64(), integers, labels, pa.binary()]
        names = [*_ZONES, "ids", "labels", "vectors"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks), types)], names)

    return run


def write_blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """The candidates in Hilbert order, a row per block: its zone map (block, low, high,
    kinds, least_id) and its content (ids, labels, vectors)."""
    keyed = rows.mapInArrow(_with_keys(_spread(rows)), "vec_id bigint, label int, comps array<bigint>, curve binary")
    ordered = keyed.repartitionByRange("curve", "vec_id").sortWithinPartitions("curve", "vec_id")
    return stage(ordered.mapInArrow(_packed(size), _BLOCKS))


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector of each block."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _needed(first: int, wanted: Callable[[dict, np.ndarray], list[tuple]]):
    """Over zone maps and a batch of anchors: the blocks that the batch has to read.

    `wanted` gives what is looked for with an anchor: which blocks count, the least and
    greatest score, and the (score, id) that a row must not be worse than, or None. With
    `first`, only so many blocks, those whose bounds lie highest, of each are named.
    """

    def run(key: tuple, zones: pa.Table, batch: pa.Table) -> pa.Table:
        names, least_id = zones["block"].to_numpy(), zones["least_id"].to_numpy()
        kinds = [set(k) for k in zones["kinds"].to_pylist()]
        chosen = np.zeros(len(names), bool)
        if len(names) and batch.num_rows:
            lows, highs = bounds(_matrix(batch, "comps"), _matrix(zones, "low"), _matrix(zones, "high"))
            for row, low, high in zip(batch.drop_columns("comps").to_pylist(), lows, highs):
                for counts, least, greatest, worst in wanted(row, kinds):
                    meets = counts & (high >= least) & (low <= greatest)
                    if worst is not None:
                        meets &= (high > worst[0]) | (high == worst[0]) & (least_id <= worst[1])
                    at = np.flatnonzero(meets)
                    if first and len(at) > first:
                        at = at[np.argsort(-(low[at] + high[at]), kind="stable")[:first]]
                    chosen[at] = True
        return pa.table({"block": names[chosen], "batch": pa.array([key[1].as_py()] * int(chosen.sum()), pa.int32())})

    return run


_FAR = np.iinfo(np.int64)


def _of_label(row: dict, kinds: list[set]) -> list[tuple]:
    same = np.array([row["label"] in k for k in kinds])
    return [(same, _FAR.min, _FAR.max, row["worst"] and tuple(row["worst"].values()))]


def _in_windows(row: dict, kinds: list[set]) -> list[tuple]:
    other = np.array([len(k) > 1 or row["label"] not in k for k in kinds])
    return [(other, w["least"], w["greatest"], w["worst"] and tuple(w["worst"].values())) for w in row["windows"]]


def _best(scores: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Places of the `keep` highest scores, of equal ones those of the smallest ids."""
    if len(scores) > keep:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - keep)[len(scores) - keep])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:keep]]


def _read(exact: type, rows_of: Callable, schema: list[str]):
    """Scores a batch against the blocks of a stretch."""

    def run(key: tuple, blocks: pa.Table, batch: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if blocks.num_rows and batch.num_rows:
            anchors = _matrix(batch, "comps")
            size = anchors.shape[1]
            ids = np.concatenate([np.array(x, np.int64) for x in blocks["ids"].to_pylist()])
            labels = np.concatenate([np.array(x, np.int64) for x in blocks["labels"].to_pylist()])
            vectors = np.frombuffer(b"".join(blocks["vectors"].to_pylist()), np.int64).reshape(len(ids), size)
            scores = (anchors.astype(exact) @ vectors.T.astype(exact)).astype(np.int64)
            for row, score in zip(batch.drop_columns("comps").to_pylist(), scores):
                out += rows_of(row, ids, labels, score)
        columns = zip(*out) if out else [[] for _ in schema]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=schema)

    return run


def _positives_of(keep: int):
    def rows(row: dict, ids: np.ndarray, labels: np.ndarray, score: np.ndarray) -> list[tuple]:
        at = np.flatnonzero((labels == row["label"]) & (ids != row["anchor_id"]))
        best = at[_best(score[at], ids[at], keep)]
        return [(row["anchor_id"], i, s) for i, s in zip(ids[best].tolist(), score[best].tolist())]

    return rows


def _negatives_of(keep: int):
    def rows(row: dict, ids: np.ndarray, labels: np.ndarray, score: np.ndarray) -> list[tuple]:
        other = np.flatnonzero(labels != row["label"])
        order = other[np.lexsort((ids[other], -score[other]))]
        falling = -score[order]
        out = []
        for w in row["windows"]:
            start = np.searchsorted(falling, -w["greatest"], "left")
            best = order[start : min(start + keep, np.searchsorted(falling, -w["least"], "right"))]
            found = zip(ids[best].tolist(), score[best].tolist())
            out += [(row["anchor_id"], w["positive_id"], w["positive_score"], i, s) for i, s in found]
        return out

    return rows


def _nearest(rows: DataFrame, by: list[str], other: str, keep: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), other)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def _last(rows: DataFrame, by: list[str], other: str, keep: int) -> DataFrame:
    """The last of `keep` rows, where there are so many: what others must not be worse than."""
    full = _nearest(rows, by, other, keep).filter(F.col("rank") == keep)
    return full.select(*by, F.struct("score", F.col(other).alias("id")).alias("worst"))


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
    size: int = BLOCK,
    batch: int = BATCH,
    first: int = FIRST,
) -> DataFrame:
    """The hard negatives of the rows of `vectors` (vec_id, label, embedding) for which the
    condition `anchors` on vec_id holds: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    The score of two rows is the inner product of their vectors, of whole numbers (`SCALE`
    times the component, rounded down). An anchor's positives are the first `positives`
    other rows of its label. For each, the first `negatives` rows of other labels whose score
    is within `window` hundredths of the positive's are returned. Higher scores come first,
    of equal ones smaller ids; a positive without such rows has none. `label` replaces the
    label of a row that takes part (see `whole_vectors`). An empty table gives no rows;
    scores that 64 bits may not hold are an error.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors)
    rows = stage(rows.withColumn("label", (F.col("label") if label is None else label).cast("int")))
    extent = rows.agg(F.max(F.array_max(F.transform("comps", F.abs))).alias("most"), F.max(F.size("comps")).alias("n")).first()
    greatest = (extent["n"] or 0) * (extent["most"] or 0) ** 2
    if greatest * 100 >= 2**63:
        raise ValueError("scores may need more than 64 bits")
    # Whole numbers below 2**53 are exact as doubles, whose products are much faster.
    exact = np.float64 if greatest < 2**53 else np.int64
    size = max(1, min(size, BLOCK_VALUES // max(1, extent["n"] or 1)))
    blocks = write_blocks(rows, size)
    # The number of a block is its partition's, and its place there in the lower 32 bits.
    place = F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    stretch = F.xxhash64(F.shiftright("block", 32), F.floor(place / STRETCH))
    chunks = max(1, -(-blocks.select("block").count() // ZONES))
    chunk = F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int").alias("chunk")

    chosen = rows.filter(anchors)
    batches = max(1, -(-chosen.count() // batch))
    number = F.pmod(F.xxhash64("vec_id"), F.lit(batches)).cast("int")
    chosen = stage(chosen.select(F.col("vec_id").alias("anchor_id"), "label", "comps", number.alias("batch")))
    every_batch = F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch")
    zones = blocks.select(*_ZONES, chunk, every_batch)

    def read(asked: DataFrame, wanted, first: int, rows_of, schema: str) -> DataFrame:
        """The best rows that the batches of `asked` find in the blocks they need."""
        each = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        needed = zones.groupBy("chunk", "batch").cogroup(each.groupBy("chunk", "batch")).applyInArrow(_needed(first, wanted), _NEEDED)
        path, kinds = write_staged(needed.withColumn("stretch", stretch)), f"{_NEEDED}, stretch bigint"
        needed, again = (spark.read.schema(kinds).parquet(path) for _ in range(2))
        content = needed.join(blocks.select("block", "ids", "labels", "vectors"), "block")
        sent = asked.join(again.select("batch", "stretch").distinct(), "batch")
        names = [c.split()[0] for c in schema.split(", ")]
        found = content.groupBy("stretch", "batch").cogroup(sent.groupBy("stretch", "batch"))
        return stage(found.applyInArrow(_read(exact, rows_of, names), schema))

    kind = "struct<score:bigint,id:bigint>"
    seen = read(chosen.withColumn("worst", F.lit(None).cast(kind)), _of_label, first, _positives_of(positives), _POSITIVES)
    asked = chosen.join(_last(seen, ["anchor_id"], "positive_id", positives), "anchor_id", "left")
    found = read(stage(asked), _of_label, 0, _positives_of(positives), _POSITIVES)
    best = _nearest(found, ["anchor_id"], "positive_id", positives).filter("score >= 0")

    low, high = window
    pairs = stage(best.selectExpr(
        "anchor_id", "positive_id", "score as positive_score",
        f"({low} * score + 99) div 100 as least", f"({high} * score) div 100 as greatest",
    ))

    def with_windows(pairs: DataFrame) -> DataFrame:
        window = F.struct("positive_id", "positive_score", "least", "greatest", "worst")
        return stage(chosen.join(pairs.groupBy("anchor_id").agg(F.collect_list(window).alias("windows")), "anchor_id"))

    asked = with_windows(pairs.withColumn("worst", F.lit(None).cast(kind)))
    seen = read(asked, _in_windows, first, _negatives_of(negatives), _NEGATIVES)
    by = ["anchor_id", "positive_id"]
    asked = with_windows(pairs.join(_last(seen, by, "negative_id", negatives), by, "left"))
    found = read(asked, _in_windows, 0, _negatives_of(negatives), _NEGATIVES)
    result = _nearest(found, by, "negative_id", negatives)
    return result.select(*by, "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
