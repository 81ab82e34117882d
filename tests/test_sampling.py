"""Exact sizes, repeatable draws, and errors for short classes."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from caseflow.operators import sampling
from caseflow.operators.sampling import (
    balanced_sample,
    hash_bucket,
    labelling_sample,
    sample_df,
    shuffle,
    uniform_sample,
)
from tests.conftest import plan_of

N = 4000


def h(key, seed=7):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


def label(i):
    return 1 if i % 5 == 0 else 0 if i % 7 else None


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(f"e{i}", label(i), f"text {i}") for i in range(N)]
    return spark.createDataFrame(rows, "encounter_id string, y int, text string").repartition(7)


def first(keys, n, seed=7):
    return sorted(sorted(keys, key=lambda k: (h(k, seed), k))[:n])


def keys_of(df):
    return sorted(r.encounter_id for r in df.collect())


@pytest.mark.parametrize("n", [1, 50, 700])
def test_balanced(cases, n):
    drawn = balanced_sample(cases, "y", n)
    want = [k for v in (0, 1) for k in first([f"e{i}" for i in range(N) if label(i) == v], n)]
    assert keys_of(drawn) == sorted(want)
    assert drawn.columns == cases.columns
    assert {r.y: r["count"] for r in drawn.groupBy("y").count().collect()} == {0: n, 1: n}


def test_same_draw_on_any_partitioning(cases):
    assert keys_of(balanced_sample(cases, "y", 40)) == keys_of(balanced_sample(cases.repartition(2), "y", 40))
    assert keys_of(balanced_sample(cases, "y", 40)) != keys_of(balanced_sample(cases, "y", 40, seed=8))


def test_short_and_missing_classes_raise(spark, cases):
    spark.sparkContext.setLogLevel("OFF")  # the failures are meant
    with pytest.raises(Exception, match="cannot draw 5000 rows from 800 of y = 1"):
        balanced_sample(cases, "y", 5000).collect()
    with pytest.raises(Exception, match="from 0 of y = 3"):
        balanced_sample(cases, "y", 1, classes=(1, 3)).collect()
    with pytest.raises(Exception, match="cannot draw"):
        uniform_sample(cases, N + 1).collect()
    spark.sparkContext.setLogLevel("ERROR")


@pytest.mark.parametrize("n", [1, 333, N])
def test_uniform(cases, n):
    assert keys_of(uniform_sample(cases, n)) == first([f"e{i}" for i in range(N)], n)


def test_coarse_buckets_change_nothing(cases, monkeypatch):
    monkeypatch.setattr(sampling, "BUCKET_DIGITS", 1)
    monkeypatch.setattr(sampling, "NUMBER_DIGITS", 1)
    assert keys_of(uniform_sample(cases, 333)) == first([f"e{i}" for i in range(N)], 333)
    places = {r.encounter_id: r.place for r in shuffle(cases, position="place").collect()}
    assert sorted(places, key=places.get) == sorted(places, key=lambda k: (h(k), k))


def test_shuffle(cases):
    order = [r.encounter_id for r in shuffle(cases).collect()]
    assert order == sorted(order, key=lambda k: (h(k), k)) and len(order) == N
    places = {r.encounter_id: r.place for r in shuffle(cases, position="place").collect()}
    assert [places[k] for k in order] == list(range(1, N + 1))


def test_labelling(cases):
    drawn = labelling_sample(cases, 20, "y", columns=["encounter_id"]).collect()
    want = [k for v in (0, 1) for k in first([f"e{i}" for i in range(N) if label(i) == v], 10)]
    assert sorted(r.position for r in drawn) == list(range(1, 21))
    in_order = [r.encounter_id for r in sorted(drawn, key=lambda r: r.position)]
    assert in_order == sorted(want, key=lambda k: h(k, 8))


def test_sample_df(cases):
    drawn = [tuple(r) for r in sample_df(cases, 100).collect()]
    rows = [tuple(r) for r in cases.collect()]
    assert len(drawn) == 100 and len(set(drawn)) == 100 and set(drawn) <= set(rows)
    assert sorted(map(str, drawn)) == sorted(map(str, map(tuple, sample_df(cases.repartition(13), 100).collect())))
    assert sorted(map(str, drawn)) != sorted(map(str, map(tuple, sample_df(cases, 100, seed=1).collect())))
    assert sample_df(cases, 10 * N).count() == N and sample_df(cases, 5, by=["encounter_id"]).count() == 5
    plan = plan_of(sample_df(cases, 100))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan and "count(1)" not in plan


def test_rows_without_a_key_can_be_drawn(spark):
    df = spark.createDataFrame([(None, 1)] + [(f"e{i}", i % 2) for i in range(40)], "encounter_id string, y int")
    assert uniform_sample(df, 41).count() == 41
    assert balanced_sample(df, "y", 20).count() == 40
    assert sorted(r.p for r in shuffle(df, position="p").collect()) == list(range(1, 42))


def test_buckets_follow_the_hash_order(spark):
    rng = random.Random(2)
    hashes = [f"{rng.getrandbits(rng.randint(1, 128)):032x}" for _ in range(3000)] + ["0" * 32]
    df = spark.createDataFrame([(x,) for x in hashes], "h string").select("h", hash_bucket(F.col("h")).alias("b"))
    buckets = [b for _, b in sorted(tuple(r) for r in df.collect())]
    assert buckets == sorted(buckets) and len(set(buckets)) > 1000


def test_only_rows_near_the_cut_are_ranked(cases):
    """Rows are cut by hash bucket before the rank, and counted without their text."""
    plan = plan_of(balanced_sample(cases, "y", 10))
    lines = plan.splitlines()
    ranked = next(i for i, l in enumerate(lines) if "row_number()" in l)
    cut = next(i for i, l in enumerate(lines) if re.search(r"Join.*_bucket#\d+ <= _upto#", l))
    assert ranked < cut  # the plan reads from the bottom up
    assert re.search(r"hashpartitioning\(y#\d+, _bucket#\d+", plan)  # no class in one task
    counted = next(l for l in lines if "partial_count" in l)
    assert "text#" not in counted
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
