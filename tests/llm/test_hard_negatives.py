from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseflow.llm import hard_negatives

SCHEMA = "vec_id bigint, label int, embedding array<float>, block string, score double"


def by_hand(rows, positives=5, negatives=10):
    kept = {}
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v) or len(v) != 6:
            continue
        kept.setdefault(vec_id, (label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = set()
    for a, (label, v) in kept.items():
        if a % 10:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in kept.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if kept[i][0] == label][:positives]:
            near = [i for i in order if kept[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out |= {(a, p, r, i, score[p], score[i]) for r, i in enumerate(near[:negatives], 1)}
    return out


def rows_of(seed, count, copies=0):
    rand = random.Random(seed)
    centres = [[rand.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = []
    for i in range(count):
        centre = rand.choice(centres)
        rows.append((i, rand.randint(0, 3), [c + rand.gauss(0, 0.3) for c in centre]))
    rows += [(count + i, i % 3, [0.5] * 6) for i in range(copies)]  # ties, far more than one block
    rand.shuffle(rows)
    return rows


def mined(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "x", 0.0) for r in rows], SCHEMA)
    result = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **settings)
    assert result.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return [tuple(r) for r in result.collect()]


@pytest.mark.parametrize(("size", "batch", "first", "copies"), [(256, 512, 2, 0), (8, 7, 1, 90), (16, 1000, 2, 300)])
def test_negatives_are_those_of_brute_force(spark, size, batch, first, copies):
    rows = rows_of(size, 400, copies)
    bad = [(1000, None, [1.0] * 6), (1010, 1, None), (1020, 1, [1.0, None] * 3), (1030, 1, [float("nan")] * 6),
           (1040, 1, [float("inf")] * 6), (1050, 1, [1.0] * 3), (1060, 1, []), (None, 1, [1.0] * 6), (1070, 1, [0.0] * 6)]
    got = mined(spark, [*rows, *bad, *rows[:20]], size=size, batch=batch, first=first)
    assert len(got) == len(set(got))
    assert set(got) == by_hand([*rows, *bad])


def test_few_rows_and_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0] * 6)]) == []
    rows = [(0, 1, [1.0] * 6), (1, 1, [1.0] * 6), (2, 2, [0.5] * 6)]
    assert set(mined(spark, rows)) == by_hand(rows) != set()


def test_scores_beyond_64_bits_are_an_error(spark):
    with pytest.raises(ValueError):
        mined(spark, [(0, 1, [1e8] * 6), (1, 2, [1e8] * 6)])


def test_large_scores_are_exact(spark):
    rows = [(i, i % 2, [200_000.25 + i, *[100_000.0] * 5]) for i in range(60)]
    assert set(mined(spark, rows)) == by_hand(rows)


def test_bounds_hold_every_score():
    rand = np.random.default_rng(1)
    vectors, anchors = rand.integers(-99, 99, (50, 7)), rand.integers(-99, 99, (20, 7))
    low, high = hard_negatives.bounds(anchors, vectors.min(0)[None], vectors.max(0)[None])
    scores = anchors @ vectors.T
    assert (low[:, 0] <= scores.min(1)).all() and (high[:, 0] >= scores.max(1)).all()


@pytest.mark.parametrize(("axes", "bits"), [(2, 3), (3, 2), (2, 1), (4, 2)])
def test_the_curve_visits_neighbouring_cells(axes, bits):
    cells = np.array(list(np.ndindex(*[1 << bits] * axes)))
    order = np.argsort(np.array(hard_negatives.hilbert_keys(cells, bits), object))
    steps = np.abs(np.diff(cells[order], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_far_blocks_are_not_read(spark):
    """Two clusters apart: the bounds leave out blocks of the other one."""
    rows = [(i, i % 2, [1.0 + i / 1e4, 0.0, 0.0] if i < 200 else [0.0, 1.0 + i / 1e4, 0.0]) for i in range(400)]
    df = spark.createDataFrame([(*r, "x", 0.0) for r in rows], SCHEMA)
    blocks = hard_negatives.write_blocks(hard_negatives.whole_vectors(df), 20)
    zones = blocks.select("block", "low", "high", "kinds", "least_id").toArrow()
    anchor = spark.createDataFrame([(0, 0, [256, 0, 0], None)], "anchor_id bigint, label int, comps array<bigint>, worst struct<score:bigint,id:bigint>")
    worst = anchor.withColumn("worst", F.struct(F.lit(60_000).cast("bigint").alias("score"), F.lit(0).cast("bigint").alias("id"))).toArrow()
    needed = hard_negatives._needed(0, hard_negatives._of_label)((pa.scalar(0), pa.scalar(0)), zones, worst)
    assert 0 < needed.num_rows <= zones.num_rows * 0.6
