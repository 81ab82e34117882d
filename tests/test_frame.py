"""Frame helpers, profiles and duplicates."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caseflow.operators.dedupe import (
    drop_duplicates,
    duplicated_rows,
    first_note,
    show_duplicates,
)
from caseflow.operators.frame import (
    add_once,
    head,
    merge,
    parse_timestamps,
    rename_columns,
    same_keys,
    select_columns,
    sort_values,
    split_by_age,
    stack,
    stack_tagged,
)
from caseflow.operators.profile import (
    column_equality,
    crosstab_margins,
    crosstab_wide,
    distributions,
    histogram,
    null_profile,
    nunique,
    shape,
    token_cost,
    value_counts,
)
from tests.conftest import plan_of


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def people(spark):
    data = [(1, "a", 5.0), (2, "b", None), (3, None, 7.0), (4, "a", 5.0), (5, "", 1.0)]
    return spark.createDataFrame(data, "k int, c string, v double")


def test_select_and_rename(people):
    assert select_columns(people, ["v", "k"]).columns == ["v", "k"]
    assert rename_columns(people, {"k": "key", "zz": "y"}).columns == ["key", "c", "v"]
    with pytest.raises(ValueError):
        rename_columns(people, ["k"])
    with pytest.raises(ValueError):
        select_columns(people, ["nope"])


def test_sort_and_head(people):
    assert [r.k for r in sort_values(people, "v", "k", "descending").collect()] == [3, 4, 1, 5, 2]
    assert [r.k for r in sort_values(people, "v").collect()][:2] == [2, 5]  # NULL first
    assert head(sort_values(people, "k", how="descending"), 2).count() == 2
    with pytest.raises(ValueError):
        sort_values(people, "v", how="sideways")


def test_age_split_leaves_out_missing_ages(spark):
    df = spark.createDataFrame([(18.0,), (17.99,), (None,)], "edvisit_age double")
    adults, children = split_by_age(df)
    assert (adults.count(), children.count()) == (1, 1)


def test_merge_keys(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "a int, l string")
    right = spark.createDataFrame([(1, "p"), (3, "q"), (None, "r")], "b int, r string")
    assert rows(merge(left, right, "a", "b", "inner")) == [(1, "x", "p")]
    assert len(rows(merge(left, right, "a", "b", "left"))) == 3
    outer = rows(merge(left, right, "a", "b", "outer"))
    assert (None, None, "q") in outer and len(outer) == 5
    filled = rows(merge(left, right, "a", "b", "outer", coalesce_key=True))
    assert (3, None, "q") in filled
    assert merge(left, right, "a", "b", "outer").columns == ["a", "l", "r"]


def test_parse_accepts_text_and_typed_columns(spark):
    df = spark.sql("SELECT '2020-01-02 03:04:05' AS a, TIMESTAMP_NTZ '2020-01-02 03:04:05' AS b")
    parsed = parse_timestamps(df, ["a", "b"])
    assert parsed.dtypes == [("a", "timestamp_ntz"), ("b", "timestamp_ntz")]
    assert parsed.filter("a = b").count() == 1


def test_stacks(spark, people):
    assert stack(people, people).count() == 10
    tagged = stack_tagged({"x": people, "y": people.select("v", "c", "k")}, "tag")
    assert rows(tagged.groupBy("tag").count()) == [("x", 5), ("y", 5)]


def test_unlike_frames_are_told_apart_without_moving_keys(spark):
    frames = {n: spark.range(k, k + 1000).selectExpr("string(id % 400) AS k") for n, k in (("a", 0), ("b", 1), ("c", 0))}
    unlike = same_keys({"a": frames["a"], "b": frames["b"]}, "k")
    assert "Exchange" not in plan_of(unlike)
    assert [tuple(r) for r in unlike.collect()] == [("a", "b", False)]
    got = {(r.left, r.right): r.same for r in same_keys(frames, "k").collect()}
    assert got == {("a", "b"): False, ("a", "c"): True, ("b", "c"): False}


def test_same_keys(spark):
    def frame(keys):
        return spark.createDataFrame(list(enumerate(keys)), "at int, k string")

    frames = {"a": frame(["x", "y", "y", None]), "b": frame([None, "y", "x", "y"]), "c": frame(["x", "y", None])}
    bag = {(r.left, r.right): r.same for r in same_keys(frames, "k").collect()}
    assert bag == {("a", "b"): True, ("a", "c"): False, ("b", "c"): False}
    order = {(r.left, r.right): r.same for r in same_keys(frames, "k", "at").collect()}
    assert order == {("a", "b"): False, ("a", "c"): False, ("b", "c"): False}
    again = same_keys({"a": frame(["x", None]), "b": frame(["x", None])}, "k", "at")
    assert [r.same for r in again.collect()] == [True]
    empty = same_keys({"a": frame(["x"]).limit(0), "b": frame(["x"]).limit(0)}, "k")
    assert [r.same for r in empty.collect()] == [True]


def test_columns_added_once_are_not_copied_upwards(spark, people):
    added = add_once(people, {"u": F.upper("c")}).filter("u = 'A' OR u = 'B'").withColumn("w", F.col("u"))
    assert plan_of(added).count("upper(") == 1
    assert rows(added, "k") == [(1,), (2,), (4,)]


def test_profiles(people):
    assert rows(shape(people)) == [(5, 3)]
    assert [tuple(r) for r in value_counts(people, "c").collect()][0] == ("a", 2)
    assert value_counts(people, "c").count() == 4
    assert value_counts(people, "c", keep_null=False).count() == 3
    assert nunique(people, "c").first()[0] == 4
    assert nunique(people, "c", count_null=False).first()[0] == 3
    profile = rows(null_profile(people.withColumn("d", F.lit("none")), ["c", "d"], "none"))
    assert profile == [("c", 1, 1, 0, 4), ("d", 0, 0, 5, 5)]
    assert rows(column_equality(people, "k", "v"), "match", "count") == [(False, 4), (None, 1)]
    assert rows(distributions(people, ["c"])) == [("c", "", 1), ("c", "a", 2), ("c", "b", 1)]


def test_token_cost(spark):
    df = spark.createDataFrame([(1000, None), (500, 10)], "a int, b int")
    cost = {r["column"]: (r.tokens, round(r.cost, 9)) for r in token_cost(df, ["a", "b"], multiplier=4).collect()}
    assert cost == {"a": (1500, 0.012), "b": (10, 0.00008)}


def test_histogram_covers_all_rows_and_both_ends(spark):
    rng = random.Random(5)
    data = [(rng.uniform(-3, 50),) for _ in range(500)] + [(None,)]
    out = histogram(spark.createDataFrame(data, "v double"), "v").orderBy("bin").collect()
    whole = [int(v) for (v,) in data if v is not None]
    assert [r.bin for r in out] == list(range(20))
    assert sum(r["count"] for r in out) == 500
    assert (out[0].lower, round(out[-1].upper, 9)) == (min(whole), max(whole))
    logs = histogram(spark.createDataFrame([(0.0,), (-1.0,), (1.0,), (10.0,)], "v double"), "v", log=True)
    assert sum(r["count"] for r in logs.collect()) == 2
    flat = histogram(spark.createDataFrame([(4.0,), (4.0,)], "v double"), "v").collect()
    assert sum(r["count"] for r in flat) == 2


def test_crosstab_margins(spark):
    data = [("1", "0"), ("1", "1"), ("0", "0"), ("0", "0"), (None, "1"), ("1", None)]
    out = rows(crosstab_margins(spark.createDataFrame(data, "a string, b string"), "a", "b"))
    assert out == sorted(
        [("0", "0", 2), ("1", "0", 1), ("1", "1", 1), ("0", "All", 2), ("1", "All", 2),
         ("All", "0", 3), ("All", "1", 1), ("All", "All", 4)], key=str)


def test_crosstab_wide(spark):
    data = [("1", 0), ("1", 0), ("0", 0), (None, 1), ("1", None)]
    out = rows(crosstab_wide(spark.createDataFrame(data, "a string, b int"), "a", "b", [0, 1]))
    assert out == [("0", 1, 0, 1), ("1", 2, 0, 2), ("All", 3, 0, 3)]


def test_first_note_order(spark):
    data = [
        ("e1", "2020-01-02", "long later note", "n1"),
        ("e1", "2020-01-01", "short", "n2"),
        ("e2", None, "a very long note without a date", "n3"),
        ("e2", "2020-05-05", "x", "n4"),
        ("e3", "2020-01-01", "ab", "n6"),
        ("e3", "2020-01-01", "abc", "n7"),
        ("e4", "2020-01-01", "ab", "n9"),
        ("e4", "2020-01-01", "cd", "n8"),
        ("e5", "2020-01-01", None, "n10"),
    ]
    df = spark.createDataFrame(data, "encounter_id string, d string, note_text_processed string, note_id string")
    kept = first_note(df.withColumn("service_date", F.col("d").cast("timestamp_ntz")))
    assert rows(kept, "encounter_id", "note_id") == [
        ("e1", "n2"), ("e2", "n4"), ("e3", "n7"), ("e4", "n8"), ("e5", "n10")]
    assert plan_of(kept).count("WindowGroupLimit") >= 2  # before and after the shuffle


def test_duplicates(spark):
    rng = random.Random(1)
    data = [(i, rng.choice(["hot"] * 5 + [None] * 3 + [str(rng.randint(0, 400))])) for i in range(900)]
    df = spark.createDataFrame(data, "i int, k string").repartition(6)
    seen = Counter(k for _, k in data)
    want = sorted(i for i, k in data if seen[k] > 1)
    for min_rows in (10, 1_000_000):  # with and without hot keys
        assert sorted(r.i for r in show_duplicates(df, "k", min_rows).collect()) == want
    assert duplicated_rows(df, "k").first()[0] == len(want)
    assert duplicated_rows(df.filter("i < 0"), "k").first()[0] == 0


def test_drop_duplicates(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, c string")
    assert rows(drop_duplicates(df, ["k"], ["c"])) == [(1, "a"), (2, "c")]
    assert drop_duplicates(df, ["k"]).count() == 2
