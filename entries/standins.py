"""Clinical tables derived from the driver tables, in Spark and as SQL.

orders stand in for visits, customers for patients and durations, documents for
notes, line items for imaging and medication orders, events for responses.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.plans.prompts import template_rows
from entries.registry import table

SPECIALTIES = ("Emergency Medicine", "Urgent Care")
#: Orders on a page of a list; some visits have more.
PAGE = 2
TASKS = ("admitted", "imaging_orders_binary", "abx_ordered_ed")
SAMPLES = ("balanced", "unbalanced", "labelling", "reversed")
FMT = "yyyy-MM-dd HH:mm:ss"


def _text(c: str, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    departure = F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")
    return table(spark, sf_dir, "orders").select(
        _text("o_custkey").alias("patient_id"),
        _text("o_custkey", "P").alias("patient_id2"),
        _text("o_orderkey", "V").alias("ed_visit_id"),
        _text("o_orderkey").alias("encounter_id"),
        F.when(status == "F", "-1")
        .when((status == "O") & (priority == "5-LOW"), None)
        .otherwise(_text("o_orderkey", "A"))
        .alias("admission_id"),
        F.when((status == "F") & (priority == "4-NOT SPECIFIED"), None)
        .otherwise(_text("o_custkey"))
        .alias("agekey"),
        F.date_format("o_orderdate", FMT).alias("arrival_datetime"),
        F.when(F.col("o_totalprice") > 480000, "not known")
        .otherwise(F.date_format(departure, FMT))
        .alias("departure_datetime"),
        priority.alias("arrivalmethod"),
    )


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        _text("c_custkey").alias("patient_id"),
        F.col("c_mktsegment").alias("sex"),
        _text("c_nationkey").alias("ethnicity"),
        F.col("c_name").alias("firstrace"),
        F.when(F.col("c_acctbal") < 0, "Y").otherwise("N").alias("multiracial"),
    )


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        _text("c_custkey").alias("durationkey"),
        F.floor(F.col("c_acctbal") * 3).cast("int").alias("days"),
    )


def note_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.substring("source", 4, 5).cast("int")
    day = F.make_timestamp_ntz(
        F.lit(2024), F.lit(1), (F.col("n_chars") % 3 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)
    )
    return table(spark, sf_dir, "documents").select(
        _text("doc_id", "D").alias("patient_id"),
        _text("doc_id", "N").alias("note_id"),
        F.floor(F.col("doc_id") / 2).cast("string").alias("encounter_id"),
        F.when(F.col("lang").isin("en", "fr"), "ED Provider Notes")
        .otherwise("Progress Notes")
        .alias("note_type"),
        F.when(source <= 11, "Emergency Medicine")
        .when(source <= 15, "Urgent Care")
        .otherwise("Other")
        .alias("prov_specialty"),
        F.when(F.col("source") != "src5", day).alias("service_date"),
    )


def note_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, third = F.col("n_chars"), F.floor(F.length("text") / 3).cast("int")
    complaint = F.when(n % 5 == 0, "CHIEF COMPLAINT").otherwise("Chief Complaint")
    exam = (
        F.when(n % 11 == 0, "physical exam")
        .when(n % 11 == 1, "PHYSICAL EXAM")
        .otherwise("Physical Exam")
    )
    close = (
        F.when(n % 4 == 0, "Initial Assessment")
        .when(n % 4 == 1, "INITIAL ASSESSMENT")
        .when(n % 4 == 2, "ED Course")
        .otherwise("ED COURSE")
    )
    swapped = n % 13 == 0
    text = F.concat(
        F.when(swapped, exam).otherwise(complaint),
        F.lit(":  "),
        F.substring(F.col("text"), F.lit(1), third),
        F.when(swapped, complaint).otherwise(exam),
        F.lit(":\n"),
        F.substring(F.col("text"), third + 1, third),
        close,
        F.lit(": "),
        F.substring(F.col("text"), 2 * third + 1, F.length("text")),
    )
    return table(spark, sf_dir, "documents").select(
        _text("doc_id", "N").alias("note_id"),
        F.when(F.col("source") != "src7", text).alias("note_text"),
    )


def imaging(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_type")
    prefix = (
        F.when(kind == "PROMO", "XR ")
        .when(kind == "SMALL", "US ")
        .when(kind == "LARGE", "IR CT ")
        .when(kind == "MEDIUM", "MR ")
        .when(kind == "STANDARD", "POC US ")
        .otherwise("USABD ")
    )
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(prefix, F.col("p_name"), F.lit(", "), F.col("p_brand")).alias("firstprocedurename"),
    )
    items = table(spark, sf_dir, "lineitem")
    return items.join(part, items.l_partkey == part.p_partkey).select(
        _text("l_orderkey").alias("encounter_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("imagingkey"),
        "firstprocedurename",
        F.date_format("l_shipdate", FMT).alias("ordering_datetime"),
    )


def medications(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = (F.col("l_quantity").cast("int") % 24).cast("string")
    minute = F.lpad((F.col("l_linenumber") * 7).cast("string"), 2, "0")
    return table(spark, sf_dir, "lineitem").select(
        _text("l_orderkey").alias("encounter_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias(
            "medicationorderkey"
        ),
        F.when(F.col("l_discount") != 0, F.concat(F.lit("drug"), (F.col("l_partkey") % 50).cast("string")))
        .alias("medicationgenericname"),
        F.when(F.col("l_returnflag") == "A", "ANTIBIOTICS")
        .when(F.col("l_returnflag") == "R", "ANALGESICS")
        .otherwise("OTHER")
        .alias("medicationtherapeuticclass"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("ordereddatekeyvalue"),
        F.concat(
            F.when(F.col("l_suppkey") % 10 == 0, hour).otherwise(F.lpad(hour, 2, "0")),
            F.lit(":"),
            minute,
        ).alias("orderedtimeofdaykeyvalue"),
    )


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    makers = (visits, patients, durations, note_metadata, note_text, imaging, medications)
    return {f.__name__: f(spark, sf_dir) for f in makers}


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer text per event: encounter_id, variant, task, k, event_type, content."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 4).cast("string").alias("encounter_id"),
        (F.col("event_id") % 4 + 1).cast("int").alias("variant"),
        "event_type",
        k.alias("k"),
        F.posexplode(F.array(*[F.lit(t) for t in TASKS])).alias("i", "task"),
    )
    kind = F.col("event_type")
    content = (
        F.when(kind == "click", "0: no")
        .when(kind == "view", "1: yes, as found")
        .when(kind == "purchase", F.concat(F.lit("choice "), ((F.col("k") + F.col("i")) % 3).cast("string")))
        .otherwise(F.concat(F.lit("k="), F.col("k").cast("string")))
    )
    return rows.withColumn("content", content)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat(
        F.lit('{"choices":[{"message":{"role":"assistant","content":"'),
        F.col("content"),
        F.lit('"}}]}'),
    )
    broken = F.when(F.col("k") % 2 == 0, F.lit('{"choices": ['))
    return answers(spark, sf_dir).select(
        "task",
        F.explode(F.array(*[F.lit(s) for s in SAMPLES])).alias("sample"),
        "encounter_id",
        "variant",
        F.when(F.col("event_type") == "error", broken).otherwise(whole).alias("response_json"),
    )


def human_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labeller's code per task and visit, modality codes for imaging."""
    p = F.col("o_orderpriority")
    admitted = F.when(p.isin("1-URGENT", "2-HIGH"), "Y").when(p == "5-LOW", "unknown").otherwise("N")
    modality = (
        F.when(p == "1-URGENT", "XR")
        .when(p == "2-HIGH", "CT")
        .when(p == "3-MEDIUM", "N")
        .when(p == "4-NOT SPECIFIED", "US")
        .otherwise("unknown")
    )
    abx = F.when(F.col("o_orderstatus") == "P", "Y").otherwise("N")
    codes = [
        F.struct(F.lit(t).alias("task"), c.alias("human_code"))
        for t, c in zip(TASKS, (admitted, modality, abx))
    ]
    return table(spark, sf_dir, "orders").select(
        _text("o_custkey").alias("patient_id"),
        _text("o_orderkey", "V").alias("ed_visit_id"),
        _text("o_orderkey").alias("encounter_id"),
        F.inline(F.array(*codes)),
    )


# The same tables as SQL, in an order in which each may use those before it.
_WORD = (
    r"[^\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def _timestamp(c: str) -> str:
    return f"try_strptime({c}, '%Y-%m-%d %H:%M:%S')"


def position(c: str, words: tuple[str, ...]) -> str:
    found = [f"nullif(strpos({c}, '{w}'), 0)" for w in words]
    return f"least({', '.join(found)})" if len(found) > 1 else found[0]


def between(c: str, start: str, end: str) -> str:
    return (
        f"CASE WHEN {start} IS NULL OR {end} IS NULL THEN 'unable_to_extract' "
        f"WHEN {end} <= {start} THEN '' "
        f"ELSE substring({c}, CAST({start} AS BIGINT), CAST({end} - {start} AS BIGINT)) END"
    )


def tail(c: str, start: str) -> str:
    return (
        f"CASE WHEN {start} IS NULL THEN 'unable_to_extract' "
        f"ELSE substring({c}, CAST({start} AS BIGINT)) END"
    )


def tokens(c: str) -> str:
    return f"CAST(ceil(length({c}) / 4.0) AS INTEGER)"


def words(c: str) -> str:
    return f"coalesce(len(regexp_extract_all({c}, '{_WORD}')), 1)"


def clean(c: str) -> str:
    return f"regexp_replace(replace({c}, chr(10), ''), ' +', ' ', 'g')"


def label(c: str) -> str:
    return (
        f"CASE WHEN contains({c}, '0') THEN '0' WHEN contains({c}, '1') THEN '1' "
        f"WHEN contains({c}, 'response_error') THEN 'error' ELSE 'neither' END"
    )


def content(c: str) -> str:
    return (
        f"coalesce(CASE WHEN json_valid({c}) THEN "
        f"json_extract_string({c}, '$.choices[0].message.content') END, 'response_error')"
    )


PER_CLASS, UNBALANCED, LABELLING = 10, 60, 12

CTES = {
    "visits": """
        SELECT CAST(o_custkey AS VARCHAR) AS patient_id, 'P' || o_custkey AS patient_id2,
          'V' || o_orderkey AS ed_visit_id, CAST(o_orderkey AS VARCHAR) AS encounter_id,
          CASE WHEN o_orderstatus = 'F' THEN '-1'
               WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN NULL
               ELSE 'A' || o_orderkey END AS admission_id,
          CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '4-NOT SPECIFIED' THEN NULL
               ELSE CAST(o_custkey AS VARCHAR) END AS agekey,
          strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS arrival_datetime,
          CASE WHEN o_totalprice > 480000 THEN 'not known'
               ELSE strftime(o_orderdate + INTERVAL 365 DAY, '%Y-%m-%d %H:%M:%S') END
            AS departure_datetime,
          o_orderpriority AS arrivalmethod
        FROM orders""",
    "patients": """
        SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_mktsegment AS sex,
          CAST(c_nationkey AS VARCHAR) AS ethnicity, c_name AS firstrace,
          CASE WHEN c_acctbal < 0 THEN 'Y' ELSE 'N' END AS multiracial
        FROM customer""",
    "durations": """
        SELECT CAST(c_custkey AS VARCHAR) AS durationkey,
          CAST(floor(c_acctbal * 3) AS INTEGER) AS days
        FROM customer""",
    "note_metadata": """
        SELECT 'D' || doc_id AS patient_id, 'N' || doc_id AS note_id,
          CAST(doc_id // 2 AS VARCHAR) AS encounter_id,
          CASE WHEN lang IN ('en', 'fr') THEN 'ED Provider Notes' ELSE 'Progress Notes' END
            AS note_type,
          CASE WHEN CAST(substring(source, 4, 5) AS INTEGER) <= 11 THEN 'Emergency Medicine'
               WHEN CAST(substring(source, 4, 5) AS INTEGER) <= 15 THEN 'Urgent Care'
               ELSE 'Other' END AS prov_specialty,
          CASE WHEN source <> 'src5' THEN
            TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(n_chars % 3 AS INTEGER)) END
            AS service_date
        FROM documents""",
    "note_text": """
        SELECT note_id, CASE WHEN source <> 'src7' THEN
          CASE WHEN swapped THEN exam ELSE complaint END || ':  ' || substring(text, 1, third)
          || CASE WHEN swapped THEN complaint ELSE exam END || ':' || chr(10)
          || substring(text, third + 1, third) || closing || ': '
          || substring(text, 2 * third + 1) END AS note_text
        FROM (SELECT 'N' || doc_id AS note_id, source, text, length(text) // 3 AS third,
            CASE WHEN n_chars % 5 = 0 THEN 'CHIEF COMPLAINT' ELSE 'Chief Complaint' END AS complaint,
            CASE WHEN n_chars % 11 = 0 THEN 'physical exam' WHEN n_chars % 11 = 1
              THEN 'PHYSICAL EXAM' ELSE 'Physical Exam' END AS exam,
            CASE n_chars % 4 WHEN 0 THEN 'Initial Assessment' WHEN 1 THEN 'INITIAL ASSESSMENT'
              WHEN 2 THEN 'ED Course' ELSE 'ED COURSE' END AS closing,
            n_chars % 13 = 0 AS swapped
          FROM documents)""",
    "imaging": """
        SELECT CAST(l_orderkey AS VARCHAR) AS encounter_id,
          concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS imagingkey,
          CASE p_type WHEN 'PROMO' THEN 'XR ' WHEN 'SMALL' THEN 'US ' WHEN 'LARGE' THEN 'IR CT '
            WHEN 'MEDIUM' THEN 'MR ' WHEN 'STANDARD' THEN 'POC US ' ELSE 'USABD ' END
            || p_name || ', ' || p_brand AS firstprocedurename,
          strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS ordering_datetime
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "medications": """
        SELECT CAST(l_orderkey AS VARCHAR) AS encounter_id,
          concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS medicationorderkey,
          CASE WHEN l_discount <> 0 THEN 'drug' || (l_partkey % 50) END AS medicationgenericname,
          CASE l_returnflag WHEN 'A' THEN 'ANTIBIOTICS' WHEN 'R' THEN 'ANALGESICS' ELSE 'OTHER' END
            AS medicationtherapeuticclass,
          strftime(l_shipdate, '%Y-%m-%d') AS ordereddatekeyvalue,
          CASE WHEN l_suppkey % 10 = 0 THEN CAST(CAST(l_quantity AS INTEGER) % 24 AS VARCHAR)
            ELSE lpad(CAST(CAST(l_quantity AS INTEGER) % 24 AS VARCHAR), 2, '0') END
            || ':' || lpad(CAST(l_linenumber * 7 AS VARCHAR), 2, '0') AS orderedtimeofdaykeyvalue
        FROM lineitem""",
    "visit_times": f"""
        SELECT encounter_id, {_timestamp('arrival_datetime')} AS arrival,
          {_timestamp('departure_datetime')} AS departure FROM visits""",
    "timed_medications": """
        SELECT encounter_id, medicationorderkey, medicationgenericname, medicationtherapeuticclass,
          CASE WHEN regexp_full_match(ordereddatekeyvalue || orderedtimeofdaykeyvalue || ':00',
              '[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9]{2}:[0-9]{2}:[0-9]{2}')
            THEN try_strptime(ordereddatekeyvalue || orderedtimeofdaykeyvalue || ':00',
              '%Y-%m-%d%H:%M:%S') END AS medicationorder_datetime
        FROM medications""",
    "imaging_lists": f"""
        SELECT encounter_id, place // {PAGE} AS part, string_agg(replace(firstprocedurename, ',', ''), '|'
            ORDER BY place) AS imaging_orders
        FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id
            ORDER BY {_timestamp('ordering_datetime')} NULLS FIRST, imagingkey) - 1 AS place
        FROM imaging JOIN visit_times USING (encounter_id)
        WHERE {_timestamp('ordering_datetime')} BETWEEN arrival AND departure
          AND (firstprocedurename LIKE 'XR%' OR firstprocedurename LIKE 'US %'
            OR firstprocedurename LIKE 'POC US %' OR firstprocedurename LIKE 'CT %'
            OR firstprocedurename LIKE 'IR CT %' OR firstprocedurename LIKE 'MR %'))
        GROUP BY encounter_id, part""",
    "medication_lists": f"""
        SELECT encounter_id, place // {PAGE} AS part,
          string_agg(medicationorderkey, '|' ORDER BY place) AS order_keys,
          coalesce(string_agg(medicationgenericname, '|' ORDER BY place), '') AS generic_names,
          string_agg(strftime(medicationorder_datetime, '%Y-%m-%d %H:%M:%S'), '|' ORDER BY place)
            AS order_times
        FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id
            ORDER BY medicationorder_datetime, medicationorderkey) - 1 AS place
        FROM timed_medications JOIN visit_times USING (encounter_id)
        WHERE medicationtherapeuticclass = 'ANTIBIOTICS'
          AND medicationorder_datetime BETWEEN arrival AND departure)
        GROUP BY encounter_id, part""",
    "order_pages": """
        SELECT encounter_id, part, imaging_orders, order_keys, generic_names, order_times,
          CAST(sum(len(string_split(imaging_orders, '|'))) OVER w AS BIGINT) AS imaging_count,
          CAST(sum(len(string_split(order_keys, '|'))) OVER w AS BIGINT) AS abx_count
        FROM imaging_lists FULL JOIN medication_lists USING (encounter_id, part)
        WINDOW w AS (PARTITION BY encounter_id)""",
    "cohort": """
        SELECT v.patient_id, v.patient_id2, v.ed_visit_id, v.encounter_id, v.admission_id,
          v.arrivalmethod, p.sex, p.ethnicity, p.firstrace, p.multiracial, d.days,
          d.days / 365.25 AS edvisit_age, m.note_id, m.service_date, t.note_text,
          coalesce(o.part, 0) AS part, o.imaging_orders, o.order_keys, o.generic_names, o.order_times,
          o.imaging_count, o.abx_count, CASE WHEN o.abx_count IS NULL THEN 'N' ELSE 'Y' END AS abx_ordered_ed
        FROM note_metadata m
        JOIN visits v ON m.encounter_id = v.encounter_id
        LEFT JOIN patients p ON v.patient_id = p.patient_id
        JOIN durations d ON v.agekey = d.durationkey AND d.days / 365.25 >= 18
        LEFT JOIN order_pages o ON m.encounter_id = o.encounter_id
        LEFT JOIN note_text t ON m.note_id = t.note_id
        WHERE m.note_type = 'ED Provider Notes'
          AND m.prov_specialty IN ('Emergency Medicine', 'Urgent Care')""",
    "first_notes": f"""
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY encounter_id
              ORDER BY service_date NULLS LAST, length(txt) DESC NULLS LAST, note_id) AS place
          FROM (SELECT *, {clean('note_text')} AS txt,
              CASE WHEN admission_id IS NOT DISTINCT FROM '-1' THEN 0 ELSE 1 END AS admitted
            FROM cohort WHERE part = 0))
        WHERE place = 1""",
    "placed_headings": f"""
        SELECT *, {position('txt', ('Chief Complaint', 'CHIEF COMPLAINT'))} AS p1,
          {position('txt', ('Physical Exam', 'PHYSICAL EXAM'))} AS p2,
          coalesce({position('txt', ('Initial Assessment', 'INITIAL ASSESSMENT'))},
            {position('txt', ('ED Course', 'ED course', 'ED COURSE'))}) AS p3
        FROM first_notes""",
    "sectioned": f"""
        SELECT *, {between('txt', 'p1', 'p2')} AS history_text,
          {between('txt', 'p2', 'p3')} AS examination_text,
          {tail('txt', 'p3')} AS assessment_plan_text
        FROM placed_headings""",
    "prepared": f"""
        SELECT *, {tokens('txt')} AS note_tokens,
          {tokens('history_text')} + {tokens('examination_text')} AS he_tokens,
          CASE WHEN imaging_orders IS NULL THEN 'N' ELSE 'Y' END AS imaging_orders_binary
        FROM sectioned
        WHERE history_text NOT IN ('unable_to_extract', '')
          AND examination_text NOT IN ('unable_to_extract', '')
          AND assessment_plan_text NOT IN ('unable_to_extract', '')
          AND {tokens('txt')} < 4000""",
    "outcomes": """
        SELECT p.*, 'admitted' AS task, admitted AS outcome FROM prepared p
        UNION ALL SELECT p.*, 'imaging_orders_binary',
          CASE imaging_orders_binary WHEN 'Y' THEN 1 ELSE 0 END FROM prepared p
        UNION ALL SELECT p.*, 'abx_ordered_ed',
          CASE abx_ordered_ed WHEN 'Y' THEN 1 ELSE 0 END FROM prepared p""",
    "ranked": """
        SELECT *, md5('7|' || encounter_id) AS h,
          row_number() OVER (PARTITION BY task, outcome
            ORDER BY md5('7|' || encounter_id), encounter_id) AS class_rank,
          row_number() OVER (PARTITION BY task
            ORDER BY md5('7|' || encounter_id), encounter_id) AS all_rank
        FROM outcomes""",
    "sets": f"""
        SELECT 'balanced' AS sample, 'forward' AS prompt_order, CAST(row_number() OVER (
            PARTITION BY task ORDER BY outcome DESC, h, encounter_id) AS INTEGER) AS position, *
        FROM ranked WHERE class_rank <= {PER_CLASS}
        UNION ALL SELECT 'unbalanced', 'forward', CAST(all_rank AS INTEGER), *
        FROM ranked WHERE all_rank <= {UNBALANCED}
        UNION ALL SELECT s.sample, s.prompt_order, CAST(row_number() OVER (
            PARTITION BY task, s.sample
            ORDER BY md5('8|' || encounter_id), encounter_id) AS INTEGER), r.*
        FROM ranked r, (VALUES ('labelling', 'forward'), ('reversed', 'reversed'))
          AS s(sample, prompt_order)
        WHERE class_rank <= {LABELLING // 2}""",
    "templates": "SELECT * FROM (VALUES {rows}) AS t(task, prompt_order, variant, template)".format(
        rows=", ".join(
            "('{}', '{}', {}, '{}')".format(t, o, v, x.replace("'", "''"))
            for t, o, v, x in template_rows()
        )
    ),
    "requests": """
        SELECT task, sample, encounter_id, variant,
          template || '  ' || chr(10) || chr(10) || '\"\"\"' || history_text || ' '
            || examination_text || '\"\"\"' AS prompt
        FROM sets JOIN templates USING (task, prompt_order)""",
    "answers": """
        SELECT CAST(event_id // 4 AS VARCHAR) AS encounter_id,
          CAST(event_id % 4 + 1 AS INTEGER) AS variant, event_type, k, task,
          CASE event_type WHEN 'click' THEN '0: no' WHEN 'view' THEN '1: yes, as found'
            WHEN 'purchase' THEN 'choice ' || ((k + i) % 3) ELSE 'k=' || k END AS content
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
          (VALUES (0, 'admitted'), (1, 'imaging_orders_binary'), (2, 'abx_ordered_ed')) AS t(i, task)""",
    "responses": """
        SELECT task, sample, encounter_id, variant,
          CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN '{"choices": [' END
            ELSE '{"choices":[{"message":{"role":"assistant","content":"' || content || '"}}]}' END
            AS response_json
        FROM answers, (VALUES ('balanced'), ('unbalanced'), ('labelling'), ('reversed')) AS s(sample)""",
    "answered": f"""
        SELECT r.task, r.sample, r.encounter_id, r.variant, {content('response_json')} AS content
        FROM requests r JOIN responses USING (task, sample, encounter_id, variant)
        WHERE response_json IS NOT NULL""",
    "scored": f"""
        SELECT s.task, s.sample, s.position, s.patient_id, s.ed_visit_id, s.encounter_id, s.outcome,
          w.* EXCLUDE (task, sample, encounter_id)
        FROM sets s JOIN (SELECT task, sample, encounter_id,
            {', '.join(f"max(CASE WHEN variant = {v} THEN content END) AS content{v}" for v in (1, 2, 3, 4))},
            {', '.join(f"max(CASE WHEN variant = {v} THEN {label('content')} END) AS label{v}" for v in (1, 2, 3, 4))}
          FROM answered GROUP BY ALL HAVING count(DISTINCT variant) = 4) w
        USING (task, sample, encounter_id)""",
    "human_codes": """
        SELECT CAST(o_custkey AS VARCHAR) AS patient_id, 'V' || o_orderkey AS ed_visit_id,
          CAST(o_orderkey AS VARCHAR) AS encounter_id, task,
          CASE task WHEN 'admitted' THEN CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Y'
              WHEN o_orderpriority = '5-LOW' THEN 'unknown' ELSE 'N' END
            WHEN 'imaging_orders_binary' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'XR'
              WHEN '2-HIGH' THEN 'CT' WHEN '3-MEDIUM' THEN 'N' WHEN '4-NOT SPECIFIED' THEN 'US'
              ELSE 'unknown' END
            ELSE CASE WHEN o_orderstatus = 'P' THEN 'Y' ELSE 'N' END END AS human_code
        FROM orders,
          (VALUES ('admitted'), ('imaging_orders_binary'), ('abx_ordered_ed')) AS t(task)""",
    "human_labels": """
        SELECT *, CASE WHEN human_code IN ('Y', 'XR', 'CT', 'US', 'MRI') THEN '1'
          WHEN human_code = 'N' THEN '0' END AS human
        FROM human_codes""",
}


def with_tables(*names: str) -> str:
    """WITH clause of the named tables and all they are built from."""
    needed, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name in needed:
            continue
        needed.add(name)
        todo += [n for n in CTES if n != name and re.search(rf"\b{n}\b", _sources(CTES[name]))]
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed) + " "


def _sources(sql: str) -> str:
    """The parts of a query after FROM and JOIN, where tables are named."""
    return " ".join(re.findall(r"(?:FROM|JOIN)\s+\(?\s*(\w+)", sql))


# Metrics of four counts, as SQL over columns TP, FP, TN, FN.
METRICS = """
  CASE WHEN TP + FN > 0 THEN round(TP / (TP + FN), 9) END AS Sensitivity,
  CASE WHEN TN + FP > 0 THEN round(TN / (TN + FP), 9) END AS Specificity,
  round(f1_1, 9) AS F1_binary,
  round(CASE WHEN n > 0 THEN (TP + TN) / n ELSE 0 END, 9) AS F1_micro,
  round(CASE WHEN n > 0 THEN (f1_1 + f1_0) / (CASE WHEN TP + FP + FN > 0 THEN 1 ELSE 0 END
    + CASE WHEN TN + FP + FN > 0 THEN 1 ELSE 0 END) ELSE 0 END, 9) AS F1_macro,
  round(CASE WHEN n > 0 THEN (f1_1 * (TP + FN) + f1_0 * (TN + FP)) / n ELSE 0 END, 9)
    AS F1_weighted"""


def summary_sql(pairs: str, extra: str = "") -> str:
    """Summary rows from `pairs`: a query of Task, Prompt, actual and predicted as text."""
    return f"""
    SELECT {extra} Task, Prompt, TP, FP, TN, FN, {METRICS}, n_excluded
    FROM (SELECT *, TP + FP + TN + FN AS n,
        CASE WHEN 2 * TP + FP + FN > 0 THEN 2 * TP / (2 * TP + FP + FN) ELSE 0 END AS f1_1,
        CASE WHEN 2 * TN + FP + FN > 0 THEN 2 * TN / (2 * TN + FP + FN) ELSE 0 END AS f1_0
      FROM (SELECT Task, Prompt,
          count(*) FILTER (actual = '1' AND predicted = '1') AS TP,
          count(*) FILTER (actual = '0' AND predicted = '1') AS FP,
          count(*) FILTER (actual = '0' AND predicted = '0') AS TN,
          count(*) FILTER (actual = '1' AND predicted = '0') AS FN,
          count(*) FILTER (actual IS NULL OR actual NOT IN ('0', '1')
            OR predicted IS NULL OR predicted NOT IN ('0', '1')) AS n_excluded
        FROM ({pairs}) GROUP BY Task, Prompt))"""
