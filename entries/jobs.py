"""The multi-step jobs, from the source tables to the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.fixed_values import LABEL_COLUMNS
from caseflow.plans.answers import ingest_responses
from caseflow.plans.cohort import build_cohort
from caseflow.plans.notes import prepare_notes
from caseflow.plans.prompts import template_table
from caseflow.plans.reports import main_report, sensitivity_report, unbalanced_report, word_counts
from caseflow.plans.tasks import LABELLING as LABELLING_SET
from caseflow.plans.tasks import SampleSpec, scoring_requests, task_sets
from caseflow.sources import stage_table
from entries.profiles import rounded
from entries.registry import query
from entries.standins import (
    LABELLING,
    PAGE,
    PER_CLASS,
    SPECIALTIES,
    UNBALANCED,
    human_codes,
    responses,
    summary_sql,
    tables,
    with_tables,
    words,
)

SPEC = SampleSpec(per_class=PER_CLASS, unbalanced=UNBALANCED, labelling=LABELLING)


def joined(df, column, name):
    """A list column as one text, for comparison."""
    values = F.transform(
        column,
        lambda v: F.date_format(v, "yyyy-MM-dd HH:mm:ss") if "datetime" in column else v,
    )
    return F.array_join(values, "|").alias(name)


@query(
    "cohort",
    with_tables("cohort")
    + """SELECT patient_id, patient_id2, ed_visit_id, encounter_id, admission_id, arrivalmethod, sex,
           ethnicity, firstrace, multiracial, days, round(edvisit_age, 9) AS edvisit_age, note_id,
           service_date, note_text, part, imaging_orders, order_keys, generic_names, order_times,
           imaging_count, abx_count, abx_ordered_ed FROM cohort""",
)
def cohort(spark, sf_dir):
    df = build_cohort(tables(spark, sf_dir), SPECIALTIES, part_rows=PAGE)
    return df.select(
        "patient_id",
        "patient_id2",
        "ed_visit_id",
        "encounter_id",
        "admission_id",
        "arrivalmethod",
        "sex",
        "ethnicity",
        "firstrace",
        "multiracial",
        "days",
        F.round("edvisit_age", 9).alias("edvisit_age"),
        "note_id",
        "service_date",
        "note_text",
        "part",
        joined(df, "imaging_orders", "imaging_orders"),
        joined(df, "medicationorderkey_abx_list", "order_keys"),
        joined(df, "medicationgenericname_abx_list", "generic_names"),
        joined(df, "medicationorder_datetime_abx_list", "order_times"),
        "imaging_count",
        "abx_count",
        "abx_ordered_ed",
    )


def prepared_notes(spark, sf_dir):
    source = tables(spark, sf_dir)
    notes = build_cohort(source, SPECIALTIES, lists=False, text=False)
    return prepare_notes(notes, note_text=source["note_text"])


@query(
    "prepare_notes",
    with_tables("prepared")
    + """SELECT encounter_id, note_id, CAST(admitted AS INTEGER) AS admitted, txt AS note_text_processed,
           CAST(length(txt) AS INTEGER) AS note_length_words, history_text, examination_text,
           assessment_plan_text, note_tokens AS note_text_processed_tokens,
           he_tokens AS history_examination_text_tokens, imaging_orders_binary, abx_ordered_ed
         FROM prepared""",
)
def prepared(spark, sf_dir):
    return prepared_notes(spark, sf_dir).select(
        "encounter_id",
        "note_id",
        "admitted",
        "note_text_processed",
        "note_length_words",
        "history_text",
        "examination_text",
        "assessment_plan_text",
        "note_text_processed_tokens",
        "history_examination_text_tokens",
        "imaging_orders_binary",
        "abx_ordered_ed",
    )


def drawn_sets(spark, sf_dir):
    """Task sets from prepared notes that are written once, as a user would."""
    return task_sets(stage_table(prepared_notes(spark, sf_dir)), SPEC)


@query(
    "task_sets",
    with_tables("sets")
    + """SELECT task, sample, prompt_order, position, patient_id, ed_visit_id, patient_id2, admission_id,
           encounter_id, CAST(outcome AS INTEGER) AS outcome, history_text, examination_text,
           he_tokens AS history_examination_text_tokens FROM sets""",
)
def sets(spark, sf_dir):
    return drawn_sets(spark, sf_dir)


@query("scoring_requests", with_tables("requests") + "SELECT * FROM requests")
def requests(spark, sf_dir):
    return scoring_requests(drawn_sets(spark, sf_dir), template_table(spark))


def scored_sets(spark, sf_dir):
    drawn = stage_table(drawn_sets(spark, sf_dir))
    asked = scoring_requests(drawn, template_table(spark))
    return ingest_responses(drawn, asked, responses(spark, sf_dir))


@query(
    "ingest_responses",
    with_tables("scored")
    + "SELECT task, sample, position, encounter_id, CAST(outcome AS INTEGER) AS outcome, "
    + ", ".join(
        f"content{v} AS response_content_history_examination{v}, label{v} AS label_history_examination{v}"
        for v in (1, 2, 3, 4)
    )
    + " FROM scored",
)
def ingested(spark, sf_dir):
    df = scored_sets(spark, sf_dir)
    answers = [c for c in df.columns if c.startswith(("response_content", "label"))]
    return df.select("task", "sample", "position", "encounter_id", "outcome", *answers)


def main_human(spark, sf_dir, scored):
    """Codes of the cases that were handed out for labelling."""
    cases = scored.filter(F.col("sample") == LABELLING_SET).select("task", "encounter_id")
    return human_codes(spark, sf_dir).join(cases, ["task", "encounter_id"])


def _pairs(source: str, human: str | None) -> str:
    prompts = [(c, f"label{v}") for v, c in enumerate(LABEL_COLUMNS, 1)]
    if human:
        prompts.append(("human", human))
    return " UNION ALL ".join(
        f"SELECT task AS Task, '{p}' AS Prompt, CAST(outcome AS VARCHAR) AS actual, {c} AS predicted FROM {source}"
        for p, c in prompts
    )


_LABELLED = """(SELECT h.task, h.human, b.outcome, b.label1, b.label2, b.label3, b.label4
    FROM (SELECT * FROM scored WHERE sample = 'balanced') b
    RIGHT JOIN (SELECT l.* FROM human_labels l
      JOIN (SELECT task, encounter_id FROM scored WHERE sample = 'labelling') c
        USING (task, encounter_id)) h
    ON b.task = h.task AND b.encounter_id = h.encounter_id AND b.patient_id = h.patient_id
      AND b.ed_visit_id = h.ed_visit_id)"""


@query(
    "main_report",
    with_tables("scored", "human_labels")
    + summary_sql(_pairs("scored WHERE sample = 'balanced'", None), f"'{2 * PER_CLASS}' AS Sample,")
    + " UNION ALL "
    + summary_sql(_pairs(_LABELLED, "human"), f"'{LABELLING}' AS Sample,"),
)
def main(spark, sf_dir):
    scored = stage_table(scored_sets(spark, sf_dir))
    report = rounded(main_report(scored, main_human(spark, sf_dir, scored), SPEC))
    return report.select("Sample", *[c for c in report.columns if c != "Sample"])


@query(
    "response_word_counts",
    with_tables("scored")
    + """SELECT task, prompt, round_even(avg(n), 1) AS mean_word_count,
           round_even(stddev_samp(n), 1) AS std_word_count FROM ("""
    + " UNION ALL ".join(
        f"""SELECT task, 'response_content_history_examination{v}' AS prompt,
              {words(f'content{v}')} AS n FROM scored WHERE sample = 'balanced'"""
        for v in (1, 2, 3, 4)
    )
    + ") GROUP BY ALL",
)
def response_words(spark, sf_dir):
    return word_counts(scored_sets(spark, sf_dir).filter(F.col("sample") == "balanced"))


_UNBALANCED = """(SELECT s.*, CASE h.human_code WHEN 'Y' THEN '1' WHEN 'N' THEN '0' ELSE h.human_code
    END AS human FROM scored s LEFT JOIN human_codes h USING (task, encounter_id)
    WHERE s.sample = 'unbalanced')"""


@query(
    "unbalanced_report",
    with_tables("scored", "human_codes") + summary_sql(_pairs(_UNBALANCED, "human")),
)
def unbalanced(spark, sf_dir):
    scored = stage_table(scored_sets(spark, sf_dir))
    return rounded(unbalanced_report(scored, human_codes(spark, sf_dir)))


_REVERSED = """(SELECT s.*, h.human FROM scored s LEFT JOIN human_labels h USING (task, encounter_id)
    WHERE s.sample = 'reversed')"""


@query(
    "sensitivity_report",
    with_tables("scored", "human_labels") + summary_sql(_pairs(_REVERSED, "human")),
)
def sensitivity(spark, sf_dir):
    scored = stage_table(scored_sets(spark, sf_dir))
    return rounded(sensitivity_report(scored, human_codes(spark, sf_dir)))
