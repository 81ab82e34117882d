"""Best-fit packing of tokenised documents, planned over a histogram of lengths.

Documents are tokenised where they lie; only the lengths of their pieces move. The
histogram of lengths (at most `size` rows) is packed best-fit decreasing on the driver:
sequences with equal room left are handled as one range, so the plan grows with the
number of lengths and not with the documents. Pieces then take the planned slots by their
rank among pieces of the same length. Ranks come from counts per (length, bucket), so no
length has to be numbered in one task.
"""

from __future__ import annotations

import base64
import bisect
import os
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import require, stage

SIZE = 2048
END = 0
#: Pieces that one task numbers, about.
BUCKET_ROWS = 100_000
#: Words are never split over spaces by this vocabulary's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The added tokens of `byte_bpe_50k.json`, which a `.tiktoken` file does not name.
ADDED = {"<|endoftext|>": 50256}
_ENCODERS: dict = {}


def encoder(path: str, added_tokens: bool = False):
    """A function from texts to lists of ids, loaded once per Python worker.

    `path`: a tokenizers JSON file, or a `.tiktoken` file of byte-pair ranks that are
    split by `PATTERN`. With `added_tokens` the literal of an added token is its one id, as
    `Tokenizer.from_file` has it; without, no string in a text stands for a special token.
    """
    if (path, added_tokens) not in _ENCODERS:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            coder = tiktoken.Encoding(
                os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=ADDED
            )
            encode = partial(coder.encode, allowed_special="all") if added_tokens else coder.encode_ordinary

            def fast(text: str) -> list[int]:
                try:
                    return encode(text)
                except ValueError:
                    # Its pattern gives up on white space of some million characters. The JSON
                    # file of the same name has the same vocabulary and no such limit.
                    return encoder(path.removesuffix(".tiktoken") + ".json", added_tokens)([text])[0]

            _ENCODERS[path, added_tokens] = lambda texts: [fast(t) for t in texts]
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            loaded = Tokenizer.from_file(path)
            loaded.encode_special_tokens = not added_tokens
            _ENCODERS[path, added_tokens] = lambda texts: [
                e.ids for e in loaded.encode_batch_fast(texts, add_special_tokens=False)
            ]
    return _ENCODERS[path, added_tokens]


def tokenised_pieces(
    docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = False, added_tokens: bool = False
) -> DataFrame:
    """Pieces of every document: doc_id, copy key `row`, piece, start, length, ids_crc32.

    A document is its ids and then `END`; a NULL text is empty and so has one id. Longer
    documents are cut into pieces of `size` ids, but for a shorter first one. `with_ids`
    adds the ids of each piece; `added_tokens` is that of `encoder`. `row` tells rows with one doc_id apart by their text.
    """
    schema = "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    schema += ", ids array<bigint>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, added_tokens)
        for batch in batches:
            out: list[tuple] = []
            places = []
            for i, text in enumerate(batch.column("text")):
                ids = np.array([*encode([text.as_py() or ""])[0], END], "<u4")
                first = len(ids) % size or size
                starts = [0, *range(first, len(ids), size)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    part = ids[a:b]
                    out.append((k, a, b - a, zlib.crc32(part.tobytes()), part if with_ids else None))
                    places.append(i)
            places = pa.array(places, pa.int64())
            columns = [batch.column("doc_id").take(places), batch.column("row").take(places)]
            piece, start, length, crc, ids_of = zip(*out) if out else ((),) * 5
            columns += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64())]
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([x.astype(np.int64) for x in ids_of], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = require(docs, "doc_id", "text").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row"), "text"
    )
    return rows.mapInArrow(run, schema)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, end rank, first sequence,
    offset).

    The pieces of a length with ranks from first to end (exclusive, from 0) take the
    sequences from the first sequence on, one each, at the offset. Among the open sequences
    a piece takes one with the least room that holds it.
    """
    out = []
    rooms: list[int] = []  # rooms left by open sequences, ascending
    ranges: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first, number)
    opened = 0

    def put_back(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in ranges:
                ranges[room] = []
                bisect.insort(rooms, room)
            ranges[room].append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room = size
                per = size // length
                first, number = opened, -(-left // per)
                opened += number
            # A sequence just filled has the least room: it takes pieces until it is full.
            per = room // length
            whole = min(number, left // per)
            for k in range(per if whole else 0):
                out.append((length, rank, rank + whole, first, size - room + k * length))
                rank += whole
            left -= per * whole
            put_back(room - per * length, first, whole)
            rest, first = number - whole, first + whole
            if rest and left < per:
                for k in range(left):
                    out.append((length, rank, rank + 1, first, size - room + k * length))
                    rank += 1
                if left:
                    put_back(room - left * length, first, 1)
                    rest, first, left = rest - 1, first + 1, 0
            put_back(room, first, rest)
    return out


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """Add `rank`, from 0, among the pieces of the same length.

    `pieces` has a column spread, a number as good as random that stays with its row.
    """
    spread = pieces.withColumn("_bucket", F.pmod("spread", F.lit(buckets)))
    counts = spread.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "row", "piece")
    numbered = spread.withColumn("_number", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["length", "_bucket"]).withColumn("rank", F.col("_before") + F.col("_number"))


def pack(
    docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = False, added_tokens: bool = False
) -> DataFrame:
    """Place every piece of every document: doc_id, piece, start, length, ids_crc32 (and
    ids), sequence_id, offset.

    Every row is packed, repeated ones and such without doc_id too. No rows give none.
    Full pieces fill a sequence each; the others are packed best-fit decreasing.
    """
    pieces = tokenised_pieces(docs, path, size, with_ids, added_tokens)
    # The random part spreads repeated rows; it is written, so no result depends on it.
    pieces = stage(pieces.withColumn("spread", F.xxhash64("doc_id", "row", "piece", F.rand(7))))
    counted = pieces.groupBy("length").count().collect()  # at most `size` rows
    histogram = {r["length"]: r["count"] for r in counted}
    buckets = max(1, -(-sum(histogram.values()) // BUCKET_ROWS))
    slots = pieces.sparkSession.createDataFrame(
        plan(histogram, size), "slot_length bigint, first bigint, last bigint, sequence bigint, offset bigint"
    )
    # The plan has at most a few rows per pair of a length and a room, whatever the corpus.
    fits = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    placed = ranked(pieces, buckets).join(F.broadcast(slots), fits)
    ids = ["ids"] if with_ids else []
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", *ids,
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset",
    )
