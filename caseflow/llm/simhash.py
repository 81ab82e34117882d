"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into floor(distance / 2) + 1 segments, so two fingerprints
within `distance` bits have a segment that differs in at most one bit. Each fingerprint
is indexed under 64 keys, one per bit: the segment of that bit with the bit wiped out.
Two segments that differ in at most one bit share the key of that bit, so an equality
grouping on keys meets every pair, and the whole fingerprints are then compared.

Only distinct fingerprints are indexed. Inside a key, fingerprints are linked by a
spanning forest (no more links than fingerprints), which has the same connected parts as
all their pairs. Keys with more than `BLOCK` fingerprints are cut into blocks and every
pair of blocks is a group of its own, so no task gets a whole hot key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import require, stage, unused
from caseflow.llm.graph import components

SEED = 42
BITS = 64
#: Fingerprints of one key that one task compares with one another.
BLOCK = 20_000
#: Bytes of a text that are cut into words at a time.
CHUNK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _word_lists(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded part of it at a time."""
    start = 0
    while start < len(data):
        end = start + CHUNK
        gap = _SPACE.search(data, end) if end < len(data) else None
        end = gap.start() if gap else len(data)
        yield data[start:end].split()
        start = end


def _bit_counts(shingles: list[bytes]) -> np.ndarray:
    """How many of the hashes have each bit, highest bit first."""
    digests = b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint of one text as an unsigned number; 0 if it has no words."""
    ones, n, tail = np.zeros(BITS, np.int64), 0, []
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TO_LOWER)
    for words in _word_lists(data):
        words = tail + words
        many = len(words) - shingle + 1
        if many > 0:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))[:many].tolist()
            ones += _bit_counts([joined[a:b] for a, b in zip(starts, ends[shingle - 1 :].tolist())])
            n += many
        tail = words[max(many, 0) :]
    if not n and tail:
        ones, n = _bit_counts([b" ".join(tail)]), 1
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, shingle: int) -> DataFrame:
    """Columns doc_id, text_hash and fp (the fingerprint as a signed long), a row each.

    NULL and empty texts have fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            signed = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(signed)],
                ["doc_id", "text_hash", "fp"],
            )

    rows = require(docs, "doc_id", "text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
    )
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


def _masks(distance: int) -> list[int]:
    """For each bit, the other bits of its segment, as signed longs."""
    bounds = np.linspace(0, BITS, distance // 2 + 2).round().astype(int)
    masks = []
    for lo, hi in zip(bounds, bounds[1:]):
        segment = sum(1 << b for b in range(lo, hi))
        masks += [segment & ~(1 << b) for b in range(lo, hi)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links (member, root) of a spanning forest over fingerprints within `distance`."""
    left = np.sort(fps)
    members: list[int] = []
    roots: list[int] = []
    while len(left):
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= distance
            if near.any():
                found = left[near]
                frontier.extend(found)
                members.extend(found.tolist())
                roots.extend([int(root)] * len(found))
                left = left[~near]
    return members, roots


_LINK_SCHEMA = "slot int, part bigint, u bigint, v bigint, many bigint"


def _link_batch(u: list[int], v: list[int]) -> pa.RecordBatch:
    none = pa.nulls(len(u))
    return pa.RecordBatch.from_arrays(
        [none.cast(pa.int32()), none.cast(pa.int64()), pa.array(u, pa.uint64()).cast(pa.int64(), safe=False),
         pa.array(v, pa.uint64()).cast(pa.int64(), safe=False), none.cast(pa.int64())],
        ["slot", "part", "u", "v", "many"],
    )


def _forests(distance: int, block: int):
    """Over rows sorted by key: links of small keys; rows of large keys pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None  # rows of the last key seen, which may go on
        for batch in batches:
            large = batch.filter(pa.compute.greater(batch.column("many"), block))
            if large.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [large.column("slot"), large.column("part"), large.column("fp"),
                     pa.nulls(large.num_rows, pa.int64()), large.column("many")],
                    ["slot", "part", "u", "v", "many"],
                )
            rest = batch.filter(pa.compute.less_equal(batch.column("many"), block))
            if not rest.num_rows:
                continue
            rows = np.column_stack([rest.column(c).cast(pa.int64()).to_numpy() for c in ("slot", "part", "fp")])
            held = rows if held is None else np.concatenate((held, rows))
            cuts = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(axis=1)) + 1
            done = cuts[-1] if len(cuts) else 0
            yield _links(held[:done], cuts, distance)
            held = held[done:]
        if held is not None:
            yield _links(held, np.array([len(held)]), distance)

    return run


def _links(rows: np.ndarray, cuts: np.ndarray, distance: int) -> pa.RecordBatch:
    fps = rows[:, 2].astype(np.int64).view(np.uint64)
    starts = np.concatenate(([0], cuts[:-1])).astype(int)
    sizes = cuts - starts
    # Most keys hold two fingerprints: all of those at once.
    two = starts[sizes == 2]
    a, b = fps[two], fps[two + 1]
    near = np.bitwise_count(a ^ b) <= distance
    u, v = np.maximum(a, b)[near].tolist(), np.minimum(a, b)[near].tolist()
    for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
        members, roots = _forest(fps[start : start + size], distance)
        u += members
        v += roots
    return _link_batch(u, v)


def near_links(fps: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that connect the same fingerprints as all pairs within `distance`.

    `fps`: distinct fingerprints in column fp.
    """
    masks = F.array(*[F.lit(m).cast("bigint") for m in _masks(distance)])
    keys = fps.select("fp", F.posexplode(masks).alias("slot", "mask")).select(
        "fp", "slot", F.col("fp").bitwiseAND(F.col("mask")).alias("part")
    )
    counted = keys.selectExpr("*", "count(*) over (partition by slot, part) as many")
    met = counted.filter("many > 1").select("slot", "part", "fp", "many")
    # The window leaves the rows of a key together; so they reach the function.
    found = stage(met.mapInArrow(_forests(distance, block), _LINK_SCHEMA))
    blocks = F.ceil(F.col("many") * 2 / block).cast("int")
    own = F.pmod(F.xxhash64("u"), blocks).cast("int")
    paired = (
        found.filter("v is null")
        .select("slot", "part", F.col("u").alias("fp"), own.alias("own"),
                F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("slot", "part", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def forest_of(group: pa.Table) -> pa.Table:
        values = group.column("fp").to_numpy().view(np.uint64)
        return pa.Table.from_batches([_link_batch(*_forest(values, distance))]).select(["u", "v"])

    hot = paired.groupBy("slot", "part", "i", "j").applyInArrow(forest_of, "u bigint, v bigint")
    return found.filter("v is not null").select("u", "v").distinct().union(hot)


def near_duplicate_groups(
    docs: DataFrame, shingle: int, distance: int, block: int = BLOCK
) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, fp and component_id.

    component_id is the smallest doc_id whose fingerprint is reachable over fingerprints
    that differ in at most `distance` bits; the document's own if there is no other.
    Texts without words have fingerprint 0 and link like any other. Rows with a NULL
    doc_id link too; a component of such rows alone has component_id NULL. Repeated rows
    share a fingerprint and so a component.
    """
    prints = stage(with_fingerprint(docs, shingle))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    member = components(near_links(distinct.select("fp"), distance, block))
    linked = distinct.join(member, distinct["fp"] == member["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = linked.join(least, "component").select("fp", "component_id")
    return prints.join(groups, "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_one_per_group(docs: DataFrame, shingle: int, distance: int) -> DataFrame:
    """`docs` with one row of each near-duplicate group: that of the smallest doc_id.

    Repeated rows of it count as duplicates too. Rows with a NULL doc_id cannot be named
    as duplicates and stay. All columns are kept.
    """
    groups = stage(near_duplicate_groups(docs, shingle, distance))
    named = groups.filter("doc_id is not null").groupBy("doc_id", "text_hash")
    rows = named.agg(F.min("component_id").alias("component_id"), F.count("*").alias("many"))
    # Among rows of one doc_id with several texts, those of one group count as repeats.
    first = rows.groupBy("doc_id", "component_id").agg(F.min("text_hash").alias("text_hash"))
    kept = first.filter("doc_id = component_id").select("doc_id", "text_hash")
    gone = rows.join(kept, ["doc_id", "text_hash"], "left_anti").select("doc_id", "text_hash")
    again = rows.filter("many > 1").join(kept, ["doc_id", "text_hash"], "left_semi")
    again = again.select("doc_id", "text_hash")

    def rows_of(keys: DataFrame, how: str) -> DataFrame:
        of, text = unused(docs, "_id", "_hash")
        keys = keys.withColumnsRenamed({"doc_id": of, "text_hash": text})
        same = (docs["doc_id"] == F.col(of)) & (F.xxhash64(docs["text"]) == F.col(text))
        return docs.join(keys, same, how)

    single = rows_of(gone.union(again), "left_anti")
    if again.isEmpty():
        return single
    return single.union(rows_of(again, "left_semi").dropDuplicates(["doc_id"]))
