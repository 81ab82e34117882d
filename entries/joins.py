"""Joins, order lists, set operations and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.functions.values import order_timestamp
from caseflow.operators.frame import merge, parse_timestamps, same_keys, stack, stack_tagged
from caseflow.operators.orders import collect_per_key, orders_during_visit, orders_per_interval
from caseflow.plans.answers import attach_responses
from caseflow.plans.cohort import (
    add_demographics,
    add_order_lists,
    add_site_label,
    imaging_lists,
    medication_lists,
    notes_with_text,
    order_counts,
    order_pages,
    text_of,
    visit_notes,
)
from caseflow.plans.reports import HUMAN, attach_human_left, attach_human_right, human_label
from caseflow.sources import shared_folder, stage_table, write_bucketed
from entries.registry import query, table
from entries.standins import (
    PAGE,
    human_codes,
    imaging,
    medications,
    note_metadata,
    note_text,
    patients,
    responses,
    visits,
    with_tables,
)


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")


@query(
    "merge_inner",
    """SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders
       JOIN customer ON o_custkey = c_custkey""",
)
def inner(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return merge(left, _customers(spark, sf_dir), "o_custkey", "c_custkey", "inner")


@query(
    "merge_left",
    """SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d
       LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def left(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "labelled_id")
    return merge(docs, labels, "doc_id", "labelled_id", "left")


@query(
    "merge_outer",
    """SELECT l.doc_id, l.quality, p.page_id, p.url FROM labels l
       FULL JOIN (SELECT page_id * 5 AS page_key, page_id, url FROM pages) p ON l.doc_id = p.page_key""",
)
def outer(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    pages = table(spark, sf_dir, "pages").select(
        (F.col("page_id") * 5).alias("page_key"), "page_id", "url"
    )
    return merge(labels, pages, "doc_id", "page_key", "outer")


@query(
    "add_demographics",
    with_tables("visits", "patients")
    + """SELECT encounter_id, patient_id, sex, ethnicity, firstrace, multiracial
         FROM visits LEFT JOIN patients USING (patient_id)""",
)
def demographics(spark, sf_dir):
    rows = visits(spark, sf_dir).select("encounter_id", "patient_id")
    return add_demographics(rows, patients(spark, sf_dir))


@query(
    "notes_with_text",
    with_tables("note_metadata", "note_text")
    + """SELECT note_id, encounter_id, service_date, note_text
         FROM note_metadata LEFT JOIN note_text USING (note_id)""",
)
def noted(spark, sf_dir):
    rows = note_metadata(spark, sf_dir).select("note_id", "encounter_id", "service_date")
    return notes_with_text(rows, note_text(spark, sf_dir))


@query(
    "visit_notes",
    with_tables("visits", "note_metadata")
    + """SELECT note_id, encounter_id, n.patient_id AS patient_id_notes, v.patient_id, note_type,
           arrival_datetime FROM visits v JOIN note_metadata n USING (encounter_id)""",
)
def of_visits(spark, sf_dir):
    rows = visits(spark, sf_dir).select("encounter_id", "patient_id", "arrival_datetime")
    return visit_notes(rows, note_metadata(spark, sf_dir)).select(
        "note_id", "encounter_id", "patient_id_notes", "patient_id", "note_type", "arrival_datetime"
    )


def _timed_visits(spark, sf_dir):
    rows = visits(spark, sf_dir).select("encounter_id", "arrival_datetime", "departure_datetime")
    return parse_timestamps(rows, ["arrival_datetime", "departure_datetime"])


def _timed_medications(spark, sf_dir):
    return medications(spark, sf_dir).select(
        "encounter_id",
        "medicationorderkey",
        order_timestamp("ordereddatekeyvalue", "orderedtimeofdaykeyvalue").alias("ordered"),
    )


@query(
    "interval_join",
    with_tables("imaging", "visit_times")
    + """SELECT encounter_id, imagingkey, firstprocedurename, ordering_datetime AS ordered
         FROM imaging JOIN visit_times USING (encounter_id)
         WHERE try_strptime(ordering_datetime, '%Y-%m-%d %H:%M:%S') BETWEEN arrival AND departure""",
)
def interval(spark, sf_dir):
    orders = parse_timestamps(imaging(spark, sf_dir), ["ordering_datetime"])
    placed = orders_during_visit(
        orders, _timed_visits(spark, sf_dir), "ordering_datetime", "imagingkey"
    )
    return placed.select(
        "encounter_id",
        "imagingkey",
        "firstprocedurename",
        F.date_format("ordering_datetime", "yyyy-MM-dd HH:mm:ss").alias("ordered"),
    )


@query(
    "interval_join_fanout",
    with_tables("timed_medications", "visit_times", "note_metadata")
    + """SELECT encounter_id, medicationorderkey, count(*) AS copies
         FROM timed_medications
         JOIN (SELECT v.* FROM visit_times v JOIN note_metadata USING (encounter_id)) USING (encounter_id)
         WHERE medicationorder_datetime BETWEEN arrival AND departure
         GROUP BY ALL""",
)
def interval_fanout(spark, sf_dir):
    notes = visit_notes(_timed_visits(spark, sf_dir), note_metadata(spark, sf_dir))
    placed = orders_during_visit(
        _timed_medications(spark, sf_dir), notes, "ordered", "medicationorderkey", dedupe=False
    )
    return placed.select("encounter_id", "medicationorderkey", "copies")


@query(
    "interval_rows",
    with_tables("timed_medications", "visit_times", "note_metadata")
    + """SELECT encounter_id, medicationorderkey, note_id
         FROM timed_medications
         JOIN (SELECT v.*, note_id FROM visit_times v JOIN note_metadata USING (encounter_id)) USING (encounter_id)
         WHERE medicationorder_datetime BETWEEN arrival AND departure""",
)
def interval_rows(spark, sf_dir):
    """Each order repeated for each note of its visit."""
    notes = visit_notes(_timed_visits(spark, sf_dir), note_metadata(spark, sf_dir)).select(
        "encounter_id", "arrival_datetime", "departure_datetime", "note_id"
    )
    placed = orders_per_interval(_timed_medications(spark, sf_dir), notes, "ordered")
    return placed.select("encounter_id", "medicationorderkey", "note_id")


@query(
    "collect_per_key",
    """SELECT o_custkey, place // 8 AS part, count(*) AS rows,
         string_agg(o_orderpriority, '|' ORDER BY place) AS priorities,
         coalesce(string_agg(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, '|'
           ORDER BY place), '') AS statuses
       FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1
         AS place FROM orders) GROUP BY o_custkey, part""",
)
def collected(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    rows = table(spark, sf_dir, "orders").withColumn("o_orderstatus", status)
    lists = collect_per_key(
        rows,
        "o_custkey",
        ["o_orderpriority", "o_orderstatus"],
        ["o_orderdate", "o_orderkey"],
        part_rows=8,
    )
    return lists.select(
        "o_custkey",
        "part",
        "rows",
        F.array_join("o_orderpriority_list", "|").alias("priorities"),
        F.array_join("o_orderstatus_list", "|").alias("statuses"),
    )


@query(
    "bucketed_texts",
    with_tables("note_metadata", "note_text")
    + "SELECT m.note_id, encounter_id, note_text FROM note_metadata m LEFT JOIN note_text t ON m.note_id = t.note_id",
)
def bucketed_texts(spark, sf_dir):
    folder = shared_folder(spark)
    texts = write_bucketed(note_text(spark, sf_dir), f"texts_{folder[-32:]}", folder, "note_id", 8)
    notes = note_metadata(spark, sf_dir).select("note_id", "encounter_id")
    return notes_with_text(notes, text_of(notes, texts)).select("note_id", "encounter_id", "note_text")


@query(
    "add_order_lists",
    with_tables("note_metadata", "order_pages")
    + """SELECT note_id, encounter_id, coalesce(part, 0) AS part, imaging_orders, order_keys,
           generic_names, order_times, imaging_count, abx_count
         FROM note_metadata LEFT JOIN order_pages USING (encounter_id)""",
)
def listed(spark, sf_dir):
    timed = _timed_visits(spark, sf_dir)
    notes = note_metadata(spark, sf_dir).select("note_id", "encounter_id")
    pages = stage_table(
        order_pages(
            imaging_lists(imaging(spark, sf_dir), timed, part_rows=PAGE),
            medication_lists(medications(spark, sf_dir), timed, part_rows=PAGE),
        )
    )
    notes = add_order_lists(notes, pages, per_visit=order_counts(pages))
    times = F.transform(
        "medicationorder_datetime_abx_list", lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    )
    return notes.select(
        "note_id",
        "encounter_id",
        "part",
        "imaging_count",
        "abx_count",
        F.array_join("imaging_orders", "|").alias("imaging_orders"),
        F.array_join("medicationorderkey_abx_list", "|").alias("order_keys"),
        F.array_join("medicationgenericname_abx_list", "|").alias("generic_names"),
        F.array_join(times, "|").alias("order_times"),
    )


@query(
    "add_site_label",
    """SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS care_site_id, r_name AS location_source_value
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN region ON CASE WHEN n_nationkey % 5 > 0 THEN n_regionkey END = r_regionkey""",
)
def site_label(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("string").alias("care_site_id")
    )
    region = F.when(F.col("n_nationkey") % 5 > 0, F.col("n_regionkey"))  # others have no location
    sites = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("care_site_id"),
        region.cast("string").alias("location_id"),
    )
    locations = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("string").alias("location_id"),
        F.col("r_name").alias("location_source_value"),
    )
    return add_site_label(rows, sites, locations)


def _cases(spark, sf_dir):
    """A case per note and task, from documents."""
    notes = note_metadata(spark, sf_dir).select("note_id", "encounter_id", "note_type")
    cases = notes.join(visits(spark, sf_dir).select("encounter_id", "patient_id", "ed_visit_id"), "encounter_id")
    return cases.withColumn("task", F.explode(F.array(F.lit("admitted"), F.lit("abx_ordered_ed"))))


def _human(spark, sf_dir):
    return human_codes(spark, sf_dir).withColumn(HUMAN, human_label())


_CASES = """(SELECT note_id, n.encounter_id, note_type, v.patient_id, v.ed_visit_id, task
    FROM note_metadata n JOIN visits v ON n.encounter_id = v.encounter_id,
    (VALUES ('admitted'), ('abx_ordered_ed')) AS t(task))"""


@query(
    "human_right_join",
    with_tables("note_metadata", "visits", "human_labels")
    + f"""SELECT h.task, h.patient_id, h.ed_visit_id, h.encounter_id, c.note_id, c.note_type,
            CAST(h.human AS INTEGER) AS human
          FROM {_CASES} c RIGHT JOIN human_labels h ON c.task = h.task
            AND c.patient_id = h.patient_id AND c.ed_visit_id = h.ed_visit_id
            AND c.encounter_id = h.encounter_id""",
)
def human_right(spark, sf_dir):
    return attach_human_right(_cases(spark, sf_dir), _human(spark, sf_dir))


@query(
    "human_left_join",
    with_tables("note_metadata", "visits", "human_labels")
    + f"""SELECT c.task, c.encounter_id, c.note_id, c.note_type, c.patient_id, c.ed_visit_id,
            CAST(h.human AS INTEGER) AS human
          FROM {_CASES} c LEFT JOIN human_labels h USING (task, encounter_id)""",
)
def human_left(spark, sf_dir):
    return attach_human_left(_cases(spark, sf_dir), _human(spark, sf_dir))


@query(
    "attach_responses",
    with_tables("note_metadata", "responses")
    + """SELECT task, sample, encounter_id, variant, note_id, response_json
         FROM (SELECT note_id, encounter_id, 'admitted' AS task, 'balanced' AS sample, variant
           FROM note_metadata, (VALUES (1), (2), (3), (4)) AS v(variant))
         JOIN responses USING (task, sample, encounter_id, variant) WHERE response_json IS NOT NULL""",
)
def attached(spark, sf_dir):
    requests = note_metadata(spark, sf_dir).select(
        F.lit("admitted").alias("task"),
        F.lit("balanced").alias("sample"),
        "encounter_id",
        F.explode(F.array(*[F.lit(v) for v in (1, 2, 3, 4)])).alias("variant"),
        "note_id",
    )
    return attach_responses(requests, responses(spark, sf_dir))


@query(
    "stack",
    """SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance FROM customer
       UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier""",
)
def stacked(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")
    )
    return stack(customers, suppliers)


@query(
    "stack_tagged",
    """SELECT 'large' AS Sample, doc_id, quality FROM labels
       UNION ALL SELECT 'small', doc_id, toxic FROM labels""",
)
def tagged(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    small = labels.select("doc_id", F.col("toxic").alias("quality"))
    return stack_tagged({"large": labels.select("doc_id", "quality"), "small": small}, "Sample")


_FRAMES = {
    "documents": "SELECT doc_id, doc_id AS place FROM documents",
    "again": "SELECT doc_id, doc_id AS place FROM documents ORDER BY doc_id DESC",
    "labels": "SELECT doc_id, doc_id AS place FROM labels",
    "reversed": "SELECT doc_id, -doc_id AS place FROM documents",
}


def _same(check: str, left: str, right: str, columns: str) -> str:
    a, b = (f"SELECT {columns} FROM ({_FRAMES[n]})" for n in (left, right))
    return f"""SELECT '{check}' AS "check", '{left}' AS "left", '{right}' AS "right",
        NOT EXISTS (({a} EXCEPT ALL {b}) UNION ALL ({b} EXCEPT ALL {a})) AS same"""


@query(
    "same_keys",
    " UNION ALL ".join(
        [
            _same("bag", "documents", "again", "doc_id"),
            _same("bag", "documents", "labels", "doc_id"),
            _same("bag", "again", "labels", "doc_id"),
            _same("order", "documents", "again", "place, doc_id"),
            _same("order", "documents", "reversed", "place, doc_id"),
            _same("order", "again", "reversed", "place, doc_id"),
        ]
    ),
)
def same(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("at"))
    again = docs.orderBy(F.col("doc_id").desc())
    labels = table(spark, sf_dir, "labels").select("doc_id")
    backwards = docs.withColumn("at", -F.col("at"))
    return stack_tagged(
        {
            "bag": same_keys({"documents": docs, "again": again, "labels": labels}, "doc_id"),
            "order": same_keys(
                {"documents": docs, "again": again, "reversed": backwards}, "doc_id", "at"
            ),
        },
        "check",
    )
