"""Projections, derived columns, filters, scans and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.fixed_values import IMAGING_PREFIXES
from caseflow.functions.text import token_count
from caseflow.functions.values import (
    flag_not_sentinel,
    flag_present,
    map_codes,
    order_timestamp,
    replace_codes,
    starts_with_any,
    string_key,
)
from caseflow.operators.frame import (
    keep_notnull,
    keep_null,
    parse_timestamps,
    rename_columns,
    select_columns,
    split_by_age,
    stack_tagged,
    timestamp_year,
)
from caseflow.plans.cohort import add_age
from caseflow.plans.notes import add_token_counts, within_token_limit
from caseflow.sources import (
    read_catalog,
    read_result_csv,
    read_table,
    register_view,
    shared_folder,
    write_result_csv,
    write_table,
)
from entries.registry import query, table
from entries.standins import durations, imaging, medications, visits, with_tables


@query("scan_select", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def scan_select(spark, sf_dir):
    df = read_table(
        spark,
        f"{sf_dir}/orders.parquet",
        columns=["o_custkey", "o_orderkey", "o_orderpriority"],
    )
    return select_columns(df, ["o_orderkey", "o_custkey", "o_orderpriority"])


@query("csv_roundtrip", "SELECT doc_id, text, lang FROM documents")
def csv_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = write_result_csv(df, shared_folder(spark))
    return read_result_csv(spark, path, df.schema)


@query("csv_split", "SELECT doc_id, text, lang FROM documents")
def csv_split(spark, sf_dir):
    """One file per partition of the table, each read in byte ranges."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = write_result_csv(df, shared_folder(spark), rows_per_file=0)
    return read_result_csv(spark, path, df.schema, split=True)


@query("csv_roundtrip_plain", "SELECT conv_id, turn, role, text FROM conversations")
def csv_roundtrip_plain(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    path = write_result_csv(df, shared_folder(spark), quote_all=False)
    return read_result_csv(spark, path, df.schema)


@query("parquet_roundtrip", "SELECT * FROM events")
def parquet_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return read_table(spark, write_table(df, shared_folder(spark)), df.schema)


@query(
    "sql_view",
    """SELECT c_mktsegment, n_name, count(*) AS customers FROM customer
       JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
)
def sql_view(spark, sf_dir):
    register_view(table(spark, sf_dir, "customer"), "caseflow_customer")
    register_view(table(spark, sf_dir, "nation"), "caseflow_nation")
    nation = read_catalog(spark, "caseflow_nation")
    customer = spark.sql("SELECT c_mktsegment, c_nationkey FROM caseflow_customer")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    return joined.groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("customers"))


@query(
    "rename_columns",
    "SELECT s_suppkey AS supplier, s_name, s_nationkey AS nation, s_acctbal FROM supplier",
)
def rename(spark, sf_dir):
    names = {"s_suppkey": "supplier", "s_nationkey": "nation", "absent": "x"}
    return rename_columns(table(spark, sf_dir, "supplier"), names)


@query(
    "age_split",
    with_tables("visits", "durations")
    + """SELECT CASE WHEN days / 365.25 >= 18 THEN 'adult' ELSE 'child' END AS age_group,
           encounter_id, days, round(days / 365.25, 9) AS edvisit_age
         FROM visits JOIN durations ON agekey = durationkey WHERE days IS NOT NULL""",
)
def age_split(spark, sf_dir):
    aged = add_age(visits(spark, sf_dir), durations(spark, sf_dir))
    adults, children = split_by_age(aged)
    both = stack_tagged({"adult": adults, "child": children}, "age_group")
    return both.select(
        "age_group", "encounter_id", "days", F.round("edvisit_age", 9).alias("edvisit_age")
    )


@query(
    "add_age",
    with_tables("visits", "durations")
    + """SELECT encounter_id, agekey, days, round(days / 365.25, 9) AS edvisit_age
         FROM visits LEFT JOIN durations ON agekey = durationkey""",
)
def age(spark, sf_dir):
    aged = add_age(visits(spark, sf_dir), durations(spark, sf_dir))
    return aged.select(
        "encounter_id", "agekey", "days", F.round("edvisit_age", 9).alias("edvisit_age")
    )


@query(
    "timestamp_year",
    with_tables("visits")
    + """SELECT encounter_id, departure_datetime,
           CAST(year(try_strptime(departure_datetime, '%Y-%m-%d %H:%M:%S')) AS INTEGER) AS yr
         FROM visits""",
)
def year_of(spark, sf_dir):
    df = visits(spark, sf_dir).select("encounter_id", "departure_datetime")
    return timestamp_year(df, "departure_datetime", "yr")


@query(
    "parse_timestamps",
    with_tables("visits")
    + """SELECT encounter_id,
           try_strptime(arrival_datetime, '%Y-%m-%d %H:%M:%S') AS arrival_datetime,
           try_strptime(departure_datetime, '%Y-%m-%d %H:%M:%S') AS departure_datetime
         FROM visits""",
)
def parse(spark, sf_dir):
    df = visits(spark, sf_dir).select("encounter_id", "arrival_datetime", "departure_datetime")
    return parse_timestamps(df, ["arrival_datetime", "departure_datetime"])


@query(
    "order_timestamp",
    with_tables("timed_medications")
    + "SELECT medicationorderkey, medicationorder_datetime FROM timed_medications",
)
def order_time(spark, sf_dir):
    return medications(spark, sf_dir).select(
        "medicationorderkey",
        order_timestamp("ordereddatekeyvalue", "orderedtimeofdaykeyvalue").alias(
            "medicationorder_datetime"
        ),
    )


@query("string_key", "SELECT CAST(doc_id AS VARCHAR) AS doc_key, quality FROM labels")
def key_text(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(string_key("doc_id").alias("doc_key"), "quality")


@query(
    "flag_not_sentinel",
    with_tables("visits")
    + """SELECT encounter_id, admission_id, CAST(CASE WHEN admission_id = '-1' THEN 0 ELSE 1 END
         AS INTEGER) AS admitted FROM visits""",
)
def not_sentinel(spark, sf_dir):
    return visits(spark, sf_dir).select(
        "encounter_id", "admission_id", flag_not_sentinel("admission_id").alias("admitted")
    )


@query(
    "flag_present",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'N' ELSE 'Y' END AS has_label
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def present(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled"))
    joined = docs.join(labels, docs.doc_id == labels.labelled, "left")
    return joined.select("doc_id", flag_present("labelled").alias("has_label"))


@query(
    "map_codes",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS mapped
       FROM orders""",
)
def mapped(spark, sf_dir):
    codes = map_codes("o_orderstatus", {"F": 1, "O": 0})
    return table(spark, sf_dir, "orders").select("o_orderkey", codes.alias("mapped"))


@query(
    "replace_codes",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '0'
         ELSE o_orderstatus END AS replaced FROM orders""",
)
def replaced(spark, sf_dir):
    codes = replace_codes("o_orderstatus", {"F": 1, "O": 0})
    return table(spark, sf_dir, "orders").select("o_orderkey", codes.alias("replaced"))


@query(
    "token_counts",
    """SELECT page_id, CAST(ceil(length(html) / 4.0) AS INTEGER) AS html_tokens,
         CAST(ceil(length(url) / 4.0) AS INTEGER) AS url_tokens,
         CAST(ceil(length(html) / 4.0) + ceil(length(url) / 4.0) AS INTEGER) AS both_tokens
       FROM pages""",
)
def tokens(spark, sf_dir):
    counted = add_token_counts(table(spark, sf_dir, "pages"), ["html", "url"])
    both = (F.col("html_tokens") + F.col("url_tokens")).alias("both_tokens")
    return counted.select("page_id", "html_tokens", "url_tokens", both)


@query(
    "token_limit",
    """SELECT doc_id, n_chars, CAST(ceil(length(text) / 4.0) AS INTEGER) AS tokens
       FROM documents WHERE ceil(length(text) / 4.0) < 4000""",
)
def limited(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "n_chars", token_count("text").alias("tokens"))
    return within_token_limit(df, "tokens")


@query(
    "keep_notnull",
    with_tables("visits")
    + "SELECT encounter_id, admission_id FROM visits WHERE admission_id IS NOT NULL",
)
def notnull(spark, sf_dir):
    df = visits(spark, sf_dir).select("encounter_id", "admission_id")
    return keep_notnull(df, "admission_id")


@query(
    "keep_null",
    with_tables("visits") + "SELECT encounter_id, arrivalmethod FROM visits WHERE agekey IS NULL",
)
def null(spark, sf_dir):
    return keep_null(visits(spark, sf_dir), "agekey").select("encounter_id", "arrivalmethod")


@query(
    "category_filter",
    """SELECT event_id, user_id, event_type FROM events
       WHERE event_type = 'click' OR event_type IN ('view', 'signup')""",
)
def categories(spark, sf_dir):
    kind = F.col("event_type")
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return df.filter((kind == "click") | kind.isin("view", "signup"))


@query(
    "prefix_filter",
    with_tables("imaging")
    + """SELECT imagingkey, firstprocedurename FROM imaging
         WHERE firstprocedurename LIKE 'XR%' OR firstprocedurename LIKE 'US %'
           OR firstprocedurename LIKE 'POC US %' OR firstprocedurename LIKE 'CT %'
           OR firstprocedurename LIKE 'IR CT %' OR firstprocedurename LIKE 'MR %'""",
)
def prefixes(spark, sf_dir):
    df = imaging(spark, sf_dir).select("imagingkey", "firstprocedurename")
    return df.filter(starts_with_any("firstprocedurename", IMAGING_PREFIXES))
