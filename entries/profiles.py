"""Counts, profiles, contingency tables and label metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.functions.responses import parse_label
from caseflow.functions.values import flag_not_sentinel
from caseflow.operators.dedupe import duplicated_rows
from caseflow.operators.frame import stack, stack_tagged
from caseflow.operators.metrics import MEASURES, confusion, evaluate, f1_scores, rates
from caseflow.operators.profile import (
    cohort_stats,
    column_equality,
    count_missing,
    count_notnull,
    count_null,
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
from caseflow.plans.cohort import funnel
from caseflow.plans.notes import SECTIONS, add_sections, add_token_counts, unusable_counts
from caseflow.plans.reports import attach_human_left, human_label
from entries.registry import query, table
from entries.standins import (
    answers,
    between,
    human_codes,
    note_text,
    position,
    summary_sql,
    tail,
    visits,
    with_tables,
)


@query("shape", "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
def shapes(spark, sf_dir):
    return shape(table(spark, sf_dir, "lineitem"))


@query(
    "value_counts",
    with_tables("visits")
    + """SELECT 'with null' AS form, agekey AS value, count(*) AS "count" FROM visits GROUP BY agekey
         UNION ALL SELECT 'without null', agekey, count(*) FROM visits
         WHERE agekey IS NOT NULL GROUP BY agekey""",
)
def counts(spark, sf_dir):
    rows = visits(spark, sf_dir).select(F.col("agekey").alias("value"))
    forms = {
        "with null": value_counts(rows, "value"),
        "without null": value_counts(rows, "value", keep_null=False),
    }
    return stack_tagged(forms, "form").select("form", "value", "count")


@query(
    "nunique",
    with_tables("visits")
    + """SELECT 'with null' AS form,
           count(DISTINCT agekey) + max(CASE WHEN agekey IS NULL THEN 1 ELSE 0 END) AS nunique FROM visits
         UNION ALL SELECT 'without null', count(DISTINCT agekey) FROM visits""",
)
def uniques(spark, sf_dir):
    rows = visits(spark, sf_dir)
    forms = {
        "with null": nunique(rows, "agekey"),
        "without null": nunique(rows, "agekey", count_null=False),
    }
    return stack_tagged(forms, "form").select("form", F.col("nunique").cast("long").alias("nunique"))


_SECTIONED = f"""(SELECT note_id, note_text, {between('note_text', 'p1', 'p2')} AS history_text,
      {between('note_text', 'p2', 'p3')} AS examination_text,
      {tail('note_text', 'p3')} AS assessment_plan_text
    FROM (SELECT *, {position('note_text', ('Chief Complaint', 'CHIEF COMPLAINT'))} AS p1,
        {position('note_text', ('Physical Exam', 'PHYSICAL EXAM'))} AS p2,
        coalesce({position('note_text', ('Initial Assessment', 'INITIAL ASSESSMENT'))},
          {position('note_text', ('ED Course', 'ED course', 'ED COURSE'))}) AS p3
      FROM note_text))"""


def _profile_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls,
        count(*) FILTER ({c} = '') AS empty, count(*) FILTER ({c} = 'unable_to_extract') AS sentinel,
        count({c}) AS notnulls FROM {_SECTIONED}"""


@query(
    "null_profile",
    with_tables("note_text")
    + " UNION ALL ".join(_profile_sql(c) for c in ("note_text", *SECTIONS)),
)
def nulls(spark, sf_dir):
    return null_profile(add_sections(note_text(spark, sf_dir), "note_text"), ["note_text", *SECTIONS])


@query(
    "count_missing",
    with_tables("note_text")
    + f"""SELECT count(*) FILTER (history_text IS NULL OR history_text = '') AS missing,
            count(*) FILTER (note_text IS NULL) AS nulls, count(note_text) AS notnulls
          FROM {_SECTIONED}""",
)
def missing(spark, sf_dir):
    rows = add_sections(note_text(spark, sf_dir), "note_text")
    one = [
        count_missing(rows, "history_text").selectExpr("missing", "null nulls", "null notnulls"),
        count_null(rows, "note_text").selectExpr("null missing", "nulls", "null notnulls"),
        count_notnull(rows, "note_text").selectExpr("null missing", "null nulls", "notnulls"),
    ]
    both = stack(*[df.select(*[F.col(c).cast("long").alias(c) for c in df.columns]) for df in one])
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@query(
    "unusable_counts",
    with_tables("note_text")
    + " UNION ALL ".join(
        f"""SELECT CAST({i} AS INTEGER) AS step, '{check}' AS "check", '{c}' AS "column",
              count(*) AS rows FROM {_SECTIONED} WHERE {where}"""
        for i, (check, c, where) in enumerate(
            [("start", "", "true")]
            + [("null", c, "true") for c in SECTIONS]
            + [
                ("sentinel", c, " AND ".join(f"{d} <> 'unable_to_extract'" for d in SECTIONS[: j + 1]))
                for j, c in enumerate(SECTIONS)
            ]
            + [
                (
                    "empty",
                    c,
                    " AND ".join(
                        [f"{d} <> 'unable_to_extract'" for d in SECTIONS]
                        + [f"{d} <> ''" for d in SECTIONS[: j + 1]]
                    ),
                )
                for j, c in enumerate(SECTIONS)
            ]
        )
    ),
)
def unusable(spark, sf_dir):
    return unusable_counts(add_sections(note_text(spark, sf_dir), "note_text"))


@query(
    "cohort_stats",
    with_tables("visits")
    + """SELECT count(*) AS rows, count(DISTINCT patient_id) AS patients,
           count(DISTINCT agekey) + 1 AS visits FROM visits""",
)
def stats(spark, sf_dir):
    result = cohort_stats(visits(spark, sf_dir), "patient_id", "agekey")
    return result.select(*[F.col(c).cast("long").alias(c) for c in result.columns])


@query(
    "funnel",
    """SELECT CAST(step AS INTEGER) AS step, name, count(*) AS rows,
         count(DISTINCT o_custkey) AS patients, count(DISTINCT o_orderkey) AS visits
       FROM orders JOIN (VALUES (0, 'all'), (1, 'not P'), (2, 'urgent')) AS s(step, name)
         ON step = 0 OR (o_orderstatus <> 'P' AND (step = 1 OR o_orderpriority = '1-URGENT'))
       GROUP BY ALL""",
)
def funnels(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumnsRenamed(
        {"o_custkey": "patient_id", "o_orderkey": "encounter_id"}
    )
    steps = {
        "all": F.lit(True),
        "not P": F.col("o_orderstatus") != "P",
        "urgent": F.col("o_orderpriority") == "1-URGENT",
    }
    return funnel(steps, rows)


@query(
    "column_equality",
    """SELECT (l.quality = l.toxic) AS "match", count(*) AS "count"
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL""",
)
def equality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return column_equality(labelled, "quality", "toxic")


def _bins_sql(value: str, rows: str) -> str:
    return f"""
    SELECT CAST(b.bin AS INTEGER) AS bin, low + b.bin * width AS "lower",
      low + (b.bin + 1) * width AS "upper", count(v.v) AS "count"
    FROM (SELECT min(v) AS low, (max(v) - min(v)) / 20 AS width FROM (SELECT {value} AS v FROM {rows})) e,
      (SELECT unnest(range(20)) AS bin) b
    LEFT JOIN (SELECT v, least(CAST(floor((v - low) / width) AS BIGINT), 19) AS bin
      FROM (SELECT {value} AS v FROM {rows}),
        (SELECT min(v) AS low, (max(v) - min(v)) / 20 AS width FROM (SELECT {value} AS v FROM {rows}))
      WHERE v IS NOT NULL) v ON v.bin = b.bin
    GROUP BY ALL"""


@query(
    "histogram",
    f"""SELECT scale, bin, round("lower", 6) AS "lower", round("upper", 6) AS "upper", "count" FROM (
          SELECT 'plain' AS scale, * FROM ({_bins_sql("CAST(trunc(value) AS DOUBLE)", "events")})
          UNION ALL SELECT 'log', * FROM (
            {_bins_sql("CASE WHEN l_extendedprice > 0 THEN ln(l_extendedprice) END", "lineitem")}))""",
)
def bins(spark, sf_dir):
    both = stack_tagged(
        {
            "plain": histogram(table(spark, sf_dir, "events"), "value"),
            "log": histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", log=True),
        },
        "scale",
    )
    return both.select(
        "scale", "bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "count"
    )


def _cost_sql(c: str) -> str:
    return f"""SELECT '{c}_tokens' AS "column", CAST(sum(ceil(length({c}) / 4.0)) AS BIGINT) AS tokens,
        round(sum(ceil(length({c}) / 4.0)) / 1000 * 0.002 * 4, 9) AS cost FROM pages"""


@query("token_cost", _cost_sql("html") + " UNION ALL " + _cost_sql("url"))
def cost(spark, sf_dir):
    counted = add_token_counts(table(spark, sf_dir, "pages"), ["html", "url"])
    costs = token_cost(counted, ["html_tokens", "url_tokens"], multiplier=4)
    return costs.withColumn("cost", F.round("cost", 9))


@query(
    "distributions",
    """SELECT * FROM (SELECT 'lang' AS "column", lang AS value, count(*) AS "count" FROM documents GROUP BY ALL
       UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL
       UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), count(*)
         FROM documents JOIN labels USING (doc_id) GROUP BY ALL)""",
)
def distribution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return distributions(labelled, ["lang", "source", "quality"])


@query(
    "duplicated_rows",
    """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicated_rows
       FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)""",
)
def duplicated(spark, sf_dir):
    return duplicated_rows(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query(
    "crosstab_margins",
    """SELECT CASE WHEN grouping(event_type) = 1 THEN 'All' ELSE event_type END AS event_type,
         CASE WHEN grouping(band) = 1 THEN 'All' ELSE band END AS band, count(*) AS "count"
       FROM (SELECT event_type, CASE WHEN value < 20 THEN '0' WHEN value < 100 THEN '1' END AS band
             FROM events) WHERE band IS NOT NULL
       GROUP BY CUBE (event_type, band)""",
)
def crosstab(spark, sf_dir):
    value = F.col("value")
    band = F.when(value < 20, 0).when(value < 100, 1)
    return crosstab_margins(
        table(spark, sf_dir, "events").withColumn("band", band), "event_type", "band"
    )


@query(
    "crosstab_wide",
    """SELECT CASE WHEN grouping(lang) = 1 THEN 'All' ELSE lang END AS lang,
         count(*) FILTER (quality = 0) AS "0", count(*) FILTER (quality = 1) AS "1", count(*) AS "All"
       FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""",
)
def grid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return crosstab_wide(docs.join(table(spark, sf_dir, "labels"), "doc_id"), "lang", "quality", [0, 1])


@query(
    "confusion",
    """SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS TP,
         count(*) FILTER (quality = 0 AND toxic = 1) AS FP,
         count(*) FILTER (quality = 0 AND toxic = 0) AS TN,
         count(*) FILTER (quality = 1 AND toxic = 0) AS FN,
         count(*) FILTER (quality IS NULL OR toxic IS NULL) AS n_excluded
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
)
def cells(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return confusion(labelled, "quality", "toxic", ["lang"])


def rounded(summary):
    """Rates to nine places, for comparison."""
    return summary.withColumns({m: F.round(m, 9) for m in MEASURES})


@query(
    "rates_and_f1",
    summary_sql(
        """SELECT lang AS Task, source AS Prompt, CAST(quality AS VARCHAR) AS actual,
             CAST(toxic AS VARCHAR) AS predicted FROM documents JOIN labels USING (doc_id)"""
    ),
)
def grouped_rates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("Task"), F.col("source").alias("Prompt")
    )
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return rounded(f1_scores(rates(confusion(labelled, "quality", "toxic", ["Task", "Prompt"]))))


@query(
    "eval_metrics",
    summary_sql(
        """SELECT 'quality' AS Task, 'toxic' AS Prompt, CAST(quality AS VARCHAR) AS actual,
             CAST(toxic AS VARCHAR) AS predicted FROM labels
           UNION ALL SELECT 'quality', 'quality', CAST(quality AS VARCHAR), CAST(quality AS VARCHAR)
             FROM labels"""
    ),
)
def metrics(spark, sf_dir):
    return rounded(evaluate(table(spark, sf_dir, "labels"), "quality", ["toxic", "quality"]))


@query(
    "eval_metrics_human",
    with_tables("answers", "human_labels", "visits")
    + summary_sql(
        """SELECT a.task AS Task, p.Prompt, CAST(CASE WHEN v.admission_id IS NOT DISTINCT FROM '-1'
             THEN 0 ELSE 1 END AS VARCHAR) AS actual,
             CASE p.Prompt WHEN 'human' THEN h.human
               WHEN 'label' THEN CASE WHEN contains(a.content, '0') THEN '0'
                 WHEN contains(a.content, '1') THEN '1' ELSE 'neither' END END AS predicted
           FROM answers a JOIN visits v USING (encounter_id)
           LEFT JOIN human_labels h ON a.task = h.task AND a.encounter_id = h.encounter_id,
           (VALUES ('human'), ('label')) AS p(Prompt)"""
    ),
)
def metrics_human(spark, sf_dir):
    outcome = visits(spark, sf_dir).select(
        "encounter_id", flag_not_sentinel("admission_id").alias("outcome")
    )
    rows = answers(spark, sf_dir).withColumn("label", parse_label("content"))
    human = human_codes(spark, sf_dir).withColumn("human", human_label())
    labelled = attach_human_left(rows.join(outcome, "encounter_id"), human)
    return rounded(evaluate(labelled, "outcome", ["human", "label"], "task"))
