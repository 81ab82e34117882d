"""Hot keys: same results as without them, and no task that gets them whole."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from caseflow.operators import skew
from caseflow.operators.orders import collect_per_key, orders_during_visit, orders_per_interval
from caseflow.operators.skew import FAN, SALT, hot_keys, spread_hot, spread_join
from caseflow.plans.cohort import add_age, add_demographics, add_order_lists
from tests.conftest import plan_of

N = 3000
MIN = 100  # a key is hot above 100 rows here


def make_orders():
    """A third of the orders on one visit, some without a visit, some without a time."""
    rng = random.Random(11)
    rows = []
    for i in range(N):
        visit = "hot" if i % 3 == 0 else None if i % 31 == 0 else f"v{rng.randint(0, 150)}"
        rows.append((visit, f"o{i:05d}", None if i % 17 == 0 else rng.randint(0, 40), f"n{i % 7}"))
    return rows


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(make_orders(), "encounter_id string, okey string, t int, name string").repartition(5)


@pytest.fixture(scope="module")
def visits(spark):
    rows = [(f"v{i}", 5, 5 + i % 30) for i in range(140)] + [("hot", 10, 30), (None, 0, 99)]
    return spark.createDataFrame(rows, "encounter_id string, arrival_datetime int, departure_datetime int")


def inside():
    ends = {f"v{i}": (5, 5 + i % 30) for i in range(140)} | {"hot": (10, 30)}
    return [
        r for r in make_orders()
        if r[0] in ends and r[2] is not None and ends[r[0]][0] <= r[2] <= ends[r[0]][1]
    ]


def test_hot_keys_are_those_above_the_limit(orders):
    seen = Counter(r[0] for r in make_orders())
    got = {r[0]: r[FAN] for r in hot_keys(orders, "encounter_id", MIN).collect()}
    assert got == {k: -(-n // MIN) for k, n in seen.items() if n > MIN}
    assert "hot" in got


@pytest.mark.parametrize("counters", [4, 1 << 18])
def test_there_is_no_limit_to_hot_keys(spark, monkeypatch, counters):
    """30,000 hot keys among others, each spread over its salts."""
    monkeypatch.setattr(skew, "COUNTERS", counters)
    df = spark.range(30_000).selectExpr("id AS k", "explode(sequence(1, 3 + int(id % 4))) AS i")
    df = df.union(spark.range(30_000, 90_000).selectExpr("id", "1"))
    got = {r[0]: r[FAN] for r in hot_keys(df, "k", 2).collect()}
    assert got == {k: -(-(3 + k % 4) // 2) for k in range(30_000)}
    hot = hot_keys(df, "k", 2)
    salts = spread_hot(df, "k", "i", hot).filter("k < 30000").groupBy("k", SALT).count()
    assert salts.agg({"count": "max"}).first()[0] < 6  # the largest key has six rows
    joined = spread_join(df, df.select("k").distinct(), "k", "i", hot=hot)
    assert joined.count() == df.count()


def intervals_by_hand(orders, visits):
    pairs = Counter()
    for k, okey, t in orders:
        for key, a, d, note in visits:
            if k is not None and k == key and None not in (t, a, d) and a <= t <= d:
                pairs[(k, okey, note)] += 1
    return pairs


def test_many_intervals_of_one_key(spark):
    rng = random.Random(5)
    orders = [(rng.choice(["hot", "hot", "v1", "v2", None]), f"o{i}", rng.choice([None, *[rng.randint(-3000, 3000)] * 9])) for i in range(400)]
    visits = [(rng.choice(["hot", "hot", "v1", None]), a, a + rng.choice([-5, 0, 1, 7, 8, 63, 64, 900, 6000]), f"n{i}") for i in range(300) for a in [rng.randint(-3000, 3000)]]
    visits += [("hot", None, 5, "x"), ("hot", 5, None, "y"), visits[0], visits[0], ("v2", -(2**40), 2**40, "z")]
    left = spark.createDataFrame(orders, "encounter_id string, okey string, t bigint")
    right = spark.createDataFrame(visits, "encounter_id string, arrival_datetime bigint, departure_datetime bigint, note string")
    got = orders_per_interval(left, right, "t")
    assert got.columns == ["encounter_id", "okey", "t", "arrival_datetime", "departure_datetime", "note"]
    want = intervals_by_hand(orders, visits)
    assert Counter((r.encounter_id, r.okey, r.note) for r in got.collect()) == want
    grouped = orders_per_interval(left, right.drop("note"), "t", copies=True)
    assert grouped.count() == len({(r.encounter_id, r.okey, r.arrival_datetime, r.departure_datetime) for r in got.collect()})
    assert grouped.agg({"copies": "sum"}).first()[0] == sum(want.values())
    assert orders_per_interval(left, right.limit(0), "t").count() == 0
    assert orders_per_interval(left.limit(0), right, "t").count() == 0


def test_intervals_of_one_key_meet_few_orders(spark):
    """100,000 orders and 10,000 intervals of one visit, of which each order is in few: rows
    that meet are a small part of the billion pairs."""
    orders = spark.range(100_000).selectExpr("'v' AS encounter_id", "id AS okey", "timestamp_ntz '2020-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 60) AS t")
    visits = spark.range(10_000).selectExpr(
        "'v' AS encounter_id", "timestamp_ntz '2020-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 600) AS arrival_datetime",
        "timestamp_ntz '2020-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 600 + 1200) AS departure_datetime",
    )
    got = orders_per_interval(orders, visits, "t")
    assert got.count() == sum(min(99_999, i * 10 + 20) - i * 10 + 1 for i in range(10_000) if i * 10 <= 99_999)
    plan = plan_of(got)
    assert all("bin" in l for l in plan.splitlines() if "SortMergeJoin" in l) and "NestedLoop" not in plan


def test_no_salt_holds_much_more_than_its_share(orders):
    spread = spread_hot(orders, "encounter_id", "okey", hot_keys(orders, "encounter_id", MIN))
    sizes = [r["count"] for r in spread.groupBy("encounter_id", SALT).count().collect()]
    assert max(sizes) < 2 * MIN < N / 3
    assert sum(sizes) == N


@pytest.mark.parametrize("min_rows", [MIN, 10**6])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_join(orders, visits, how, min_rows):
    hot = hot_keys(orders, "encounter_id", min_rows)
    got = spread_join(orders, visits, "encounter_id", "okey", how, hot=hot).drop(SALT, FAN)
    want = orders.join(visits, "encounter_id", how)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("min_rows", [MIN, 10**6])
def test_orders_during_visit(orders, visits, min_rows):
    hot = hot_keys(orders, "encounter_id", min_rows)
    twice = visits.union(visits)
    got = orders_during_visit(orders, twice, "t", "okey", hot=hot)
    assert sorted(r.okey for r in got.collect()) == sorted(r[1] for r in inside())
    fan = orders_during_visit(orders, twice, "t", "okey", dedupe=False, hot=hot)
    assert sorted((r.okey, r.copies) for r in fan.collect()) == sorted((r[1], 2) for r in inside())


def whole_lists(rows):
    """Entries by visit, in order."""
    out = defaultdict(list)
    for visit, key, t, name in sorted(rows, key=lambda r: (r[2] is not None, r[2], r[1])):
        out[visit].append((key, name))
    return out


@pytest.mark.parametrize("min_rows", [MIN, 10**6])
@pytest.mark.parametrize("part_rows", [8, 10**6])
def test_pages_are_whole_and_in_order(orders, visits, min_rows, part_rows):
    hot = hot_keys(orders, "encounter_id", min_rows)
    placed = orders_during_visit(orders, visits, "t", "okey", hot=hot)
    lists = collect_per_key(placed, "encounter_id", ["okey", "name"], ["t", "okey"], part_rows=part_rows, hot=hot)
    got, parts = defaultdict(list), defaultdict(list)
    for r in lists.orderBy("part").collect():
        assert 0 < len(r.okey_list) == len(r.name_list) == r.rows <= part_rows
        got[r.encounter_id] += zip(r.okey_list, r.name_list)
        parts[r.encounter_id].append((r.part, r.rows))
    assert got == whole_lists(inside())
    for pages in parts.values():
        assert [p for p, _ in pages] == list(range(len(pages)))
        assert all(n == part_rows for _, n in pages[:-1])


def test_every_note_gets_every_order(spark):
    """2,500 orders and three notes of one visit; five inside another and 500 outside."""
    rows = [("long", f"o{i:05d}", i) for i in range(2_500)] + [("few", f"p{i}", i) for i in range(5)]
    rows += [("few", f"q{i}", 10**6 + i) for i in range(500)]
    orders = spark.createDataFrame(rows, "encounter_id string, okey string, t bigint")
    visits = spark.createDataFrame([("long", 0, 10_000), ("few", 0, 10_000)], "encounter_id string, a bigint, d bigint")
    notes = spark.createDataFrame(
        [("long", "n1"), ("long", "n2"), ("long", "n3"), ("few", "n4"), ("none", "n5"), (None, "n6")],
        "encounter_id string, note_id string",
    )
    for min_hot in (100, 10**6):
        hot = hot_keys(orders, "encounter_id", min_hot)
        placed = orders_during_visit(orders, visits, "t", "okey", start="a", end="d", hot=hot)
        lists = collect_per_key(placed, "encounter_id", ["okey"], ["t", "okey"], hot=hot)
        got = defaultdict(list)
        for r in add_order_lists(notes, lists, min_hot=2).orderBy("part").collect():
            got[r.note_id] += r.okey_list or []
        long = [f"o{i:05d}" for i in range(2_500)]
        assert got == {"n1": long, "n2": long, "n3": long, "n4": [f"p{i}" for i in range(5)], "n5": [], "n6": []}


@pytest.mark.parametrize("min_rows", [MIN, 10**6])
def test_unsalted_lists(orders, min_rows):
    lists = collect_per_key(
        orders, "encounter_id", ["okey", "t"], ["t", "okey"], part_rows=10, min_rows=min_rows
    ).orderBy("part").collect()
    got = defaultdict(list)
    for r in lists:
        got[r.encounter_id] += r.okey_list
    assert got == {visit: [k for k, _ in rows] for visit, rows in whole_lists(make_orders()).items()}
    assert sum(len(r.t_list) for r in lists) == sum(r[2] is not None for r in make_orders())


def test_orders_move_once(orders, visits, spark):
    """The join, the numbering and the grouping share one partitioning."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hot = hot_keys(orders, "encounter_id", 10**6)
        placed = orders_during_visit(orders, visits, "t", "okey", hot=hot)
        plan = plan_of(collect_per_key(placed, "encounter_id", ["okey"], ["t", "okey"], hot=hot))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    main = [l for l in plan.splitlines() if "hashpartitioning" in l and SALT.lstrip("_") in l]
    assert len(main) == 2  # the orders, and the visits
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_counting_hot_keys_reads_the_key_alone(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = plan_of(hot_keys(df, "l_orderkey"))
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan
    assert "partial_count" in plan


def test_lookups_are_split_by_spark(spark):
    """Patient and age lookups are plain joins: a hot patient is split at run time."""
    visits = spark.range(60000).selectExpr(
        "IF(id % 3 = 0, 'unknown', string(id % 9000)) AS patient_id",
        "IF(id % 3 = 1, NULL, string(id % 80)) AS agekey",
        "string(id) AS encounter_id",
    )
    patients = spark.range(9000).selectExpr("string(id) AS patient_id", "'F' AS sex", "'e' AS ethnicity", "'r' AS firstrace", "'N' AS multiracial")
    durations = spark.range(80).selectExpr("string(id) AS durationkey", "int(id * 365) AS days")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        aged = add_age(add_demographics(visits, patients), durations)
        assert aged.filter("sex IS NULL OR days >= 0 OR days IS NULL").count() == 60000
        rows = aged.collect()
        assert len(rows) == 60000
        assert plan_of(aged).count("skew=true") >= 2
    finally:
        for k in settings:
            spark.conf.unset(k)
