"""Keys, flags, codes, ages, timestamps."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caseflow.fixed_values import IMAGING_PREFIXES, MODALITY, TIMESTAMP_FORMAT, YES_NO
from caseflow.functions.values import (
    _timestamp_by_format,
    age_years,
    flag_not_sentinel,
    flag_present,
    map_codes,
    order_timestamp,
    parse_timestamp,
    replace_codes,
    starts_with_any,
    string_key,
    within_visit,
)


def values(df, *columns):
    return [r[0] if len(r) == 1 else tuple(r) for r in df.select(*columns).collect()]


def test_missing_keys_stay_null(spark):
    df = spark.createDataFrame([(1,), (None,)], "k long")
    assert values(df, string_key("k")) == ["1", None]


def test_missing_admission_counts_as_admitted(spark):
    df = spark.createDataFrame([("-1",), ("A1",), (None,), ("",)], "k string")
    assert values(df, flag_not_sentinel("k")) == [0, 1, 1, 1]


def test_flag_present_of_lists(spark):
    df = spark.createDataFrame([(["a"],), ([],), (None,)], "v array<string>")
    assert values(df, flag_present("v")) == ["Y", "Y", "N"]


def test_map_drops_unknown_codes_and_replace_keeps_them(spark):
    df = spark.createDataFrame([("Y",), ("N",), ("maybe",), (None,)], "c string")
    assert values(df, map_codes("c", YES_NO)) == [1, 0, None, None]
    assert values(df, replace_codes("c", YES_NO)) == ["1", "0", "maybe", None]


def test_modality_codes(spark):
    df = spark.createDataFrame([(c,) for c in ("N", "XR", "CT", "US", "MRI", "PET")], "c string")
    assert values(df, map_codes("c", MODALITY)) == [0, 1, 1, 1, 1, None]


def test_bad_timestamp_text_is_null(spark):
    df = spark.createDataFrame(
        [("2020-02-29 23:59:59",), ("2020-02-30 00:00:00",), ("soon",), ("",), (None,)], "t string"
    )
    assert values(df, parse_timestamp("t")) == [dt.datetime(2020, 2, 29, 23, 59, 59)] + [None] * 4


def mutated(n=2000, seed=4):
    """Timestamps with some characters changed, dropped or added."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        t = list(f"{rng.randint(1900, 2100):04d}-{rng.randint(1, 12):02d}-{rng.randint(1, 31):02d} "
                 f"{rng.randint(0, 24):02d}:{rng.randint(0, 60):02d}:{rng.randint(0, 60):02d}")
        for _ in range(rng.choice([0, 0, 1, 2])):
            i = rng.randrange(len(t))
            t[i] = rng.choice(["", "0", "9", " ", "-", ":", "T", "Z", "+", ".", "a", t[i] * 2])
        out.append("".join(t))
    return out


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_both_ways_to_parse_agree(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = mutated() + ["1996-04-07 02:35:00", "2020-10-25 01:30:00", "2020-01-01 09:05:0Z", " 020-01-01 09:05:00"]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        rows = df.select("t", parse_timestamp("t").alias("a"), _timestamp_by_format(F.col("t"), TIMESTAMP_FORMAT).alias("b")).collect()
        assert [r.t for r in rows if r.a != r.b] == []
        assert 500 < sum(r.a is not None for r in rows) < 1800
        shown = {r.t: r.a for r in rows}
        assert shown["1996-04-07 02:35:00"] == dt.datetime(1996, 4, 7, 2, 35)
        other = df.limit(1).select(parse_timestamp(F.lit("07/04/1996 02:35"), "dd/MM/yyyy HH:mm"))
        assert other.first()[0] == dt.datetime(1996, 4, 7, 2, 35)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_order_time_needs_two_digit_hours_and_both_parts(spark):
    rows = [("2020-01-01", "09:05"), ("2020-01-01", "9:05"), (None, "09:05"), ("2020-01-01", None)]
    df = spark.createDataFrame(rows, "d string, t string")
    assert values(df, order_timestamp("d", "t")) == [dt.datetime(2020, 1, 1, 9, 5), None, None, None]


def test_visit_interval_is_closed_and_null_is_outside(spark):
    rows = [(0, 0, 5), (5, 0, 5), (6, 0, 5), (None, 0, 5), (1, None, 5), (1, 0, None)]
    df = spark.createDataFrame(rows, "t int, a int, b int").filter(within_visit("t", "a", "b"))
    assert values(df, "t") == [0, 5]


def test_prefixes_tell_case_and_trailing_blank(spark):
    names = ["XR CHEST", "XRAY", "US ABD", "USABD", "POC US FAST", "IR CT BX", "CT HEAD", "CTA", "ct head", "MR BRAIN", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    kept = values(df.filter(starts_with_any("n", IMAGING_PREFIXES)), "n")
    assert kept == ["XR CHEST", "XRAY", "US ABD", "POC US FAST", "IR CT BX", "CT HEAD", "MR BRAIN"]


def test_age_is_days_over_365_25(spark):
    df = spark.createDataFrame([(6574,), (6575,), (None,)], "days int")
    assert values(df, (age_years("days") >= 18)) == [False, True, None]
    assert values(df.limit(1), F.round(age_years("days"), 6)) == [round(6574 / 365.25, 6)]


def test_histogram_leaves_out_what_is_no_number(spark):
    from caseflow.operators.profile import histogram

    df = spark.createDataFrame([("3e9",), ("abc",), ("0.9",), (None,), ("NaN",), ("Infinity",), ("-1.5",)], "x string")
    rows = histogram(df, "x", bins=2).orderBy("bin").collect()
    assert [(r.lower, r.upper, r["count"]) for r in rows] == [(-1.0, 1499999999.5, 2), (1499999999.5, 3e9, 1)]
    logs = histogram(spark.createDataFrame([(1.0,), (float("nan"),), (-2.0,)], "x double"), "x", bins=1, log=True)
    assert [(r.lower, r["count"]) for r in logs.collect()] == [(0.0, 1)]


def test_answers_are_exactly_one_value(spark):
    from caseflow.fixed_values import NO_RESPONSE
    from caseflow.functions.responses import response_content

    good = '{"choices": [{"message": {"content": "0 x"}}]}'
    twice = '{"choices": [], "choices": [{"message": {"content": "1"}}]}'
    texts = [good, good + ',{"b": 1}', good + " tail", twice, "", None, "[]", good + "]", '{"choices": []}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.c for r in df.orderBy("i").select(response_content("t").alias("c")).collect()]
    assert got == ["0 x", NO_RESPONSE, NO_RESPONSE, "1"] + [NO_RESPONSE] * 5
