"""Text cleaning, sections, prompts, responses and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.functions.responses import parse_label, response_content
from caseflow.functions.text import (
    clean_text,
    contains_any,
    section_between,
    section_fallback,
    section_tail,
)
from caseflow.operators.metrics import word_count_stats
from caseflow.plans.notes import add_sections, drop_unusable
from caseflow.plans.prompts import build_prompts, template_table
from entries.registry import query, table
from entries.standins import (
    answers,
    between,
    clean,
    content,
    label,
    note_text,
    position,
    responses,
    tail,
    with_tables,
    words,
)

TITLE, BODY = ("<title>",), ("<body>", "<BODY>")
NAV, H1, MAIN, FOOTER = ("<nav>",), ("<h1",), ("<main",), ("<footer",)


@query(
    "clean_text",
    f"""SELECT doc_id, {clean('text')} AS cleaned, contains({clean('text')}, chr(10)) AS has_newline,
          contains(text, 'the ') OR contains(text, 'die ') AS has_article FROM documents""",
)
def cleaned(spark, sf_dir):
    df = table(spark, sf_dir, "documents").withColumn("cleaned", clean_text("text"))
    return df.select(
        "doc_id",
        "cleaned",
        F.col("cleaned").contains("\n").alias("has_newline"),
        contains_any("text", ("the ", "die ")).alias("has_article"),
    )


@query(
    "section_between",
    f"""SELECT page_id, {between('html', position('html', TITLE), position('html', BODY))} AS head,
          {between('html', position('html', BODY), position('html', TITLE))} AS swapped,
          {between('html', position('html', MAIN), position('html', FOOTER))} AS absent
        FROM pages""",
)
def sections(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        section_between("html", TITLE, BODY).alias("head"),
        section_between("html", BODY, TITLE).alias("swapped"),
        section_between("html", MAIN, FOOTER).alias("absent"),
    )


def _fallback(c: str) -> str:
    end = f"coalesce({position(c, MAIN)}, {position(c, H1)})"
    return between(c, position(c, NAV), end)


@query("section_fallback", f"SELECT page_id, {_fallback('html')} AS part FROM pages")
def fallback(spark, sf_dir):
    part = section_fallback("html", NAV, MAIN, H1)
    return table(spark, sf_dir, "pages").select("page_id", part.alias("part"))


@query(
    "section_tail",
    f"""SELECT page_id, {tail('html', f"coalesce({position('html', MAIN)}, {position('html', FOOTER)})")}
          AS part, {tail('html', position('html', MAIN))} AS absent FROM pages""",
)
def tails(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        section_tail("html", MAIN, FOOTER).alias("part"),
        section_tail("html", MAIN, ("<absent>",)).alias("absent"),
    )


_NOTE_SECTIONS = f"""
    SELECT note_id, {between('note_text', 'p1', 'p2')} AS history_text,
      {between('note_text', 'p2', 'p3')} AS examination_text,
      {tail('note_text', 'p3')} AS assessment_plan_text
    FROM (SELECT *, {position('note_text', ('Chief Complaint', 'CHIEF COMPLAINT'))} AS p1,
        {position('note_text', ('Physical Exam', 'PHYSICAL EXAM'))} AS p2,
        coalesce({position('note_text', ('Initial Assessment', 'INITIAL ASSESSMENT'))},
          {position('note_text', ('ED Course', 'ED course', 'ED COURSE'))}) AS p3
      FROM note_text)"""


@query("note_sections", with_tables("note_text") + _NOTE_SECTIONS)
def note_sections(spark, sf_dir):
    cut = add_sections(note_text(spark, sf_dir), "note_text")
    return cut.select("note_id", "history_text", "examination_text", "assessment_plan_text")


@query(
    "drop_unusable",
    with_tables("note_text")
    + f"""SELECT * FROM ({_NOTE_SECTIONS})
          WHERE history_text NOT IN ('unable_to_extract', '')
            AND examination_text NOT IN ('unable_to_extract', '')
            AND assessment_plan_text NOT IN ('unable_to_extract', '')""",
)
def usable(spark, sf_dir):
    return drop_unusable(note_sections(spark, sf_dir))


@query(
    "word_count_stats",
    f"""SELECT lang AS task, source AS prompt, round_even(avg({words('text')}), 1) AS mean_word_count,
          round_even(stddev_samp({words('text')}), 1) AS std_word_count
        FROM documents GROUP BY ALL""",
)
def word_stats(spark, sf_dir):
    df = table(spark, sf_dir, "documents").withColumnsRenamed({"lang": "task", "source": "prompt"})
    return word_count_stats(df, "text")


@query(
    "build_prompts",
    with_tables("templates")
    + """SELECT doc_id, task, prompt_order, """
    + ", ".join(
        f"""max(CASE WHEN variant = {v} THEN template || '  ' || chr(10) || chr(10) || '\"\"\"'
              || lang || ' ' || text || '\"\"\"' END) AS prompt_history_examination{v}"""
        for v in (1, 2, 3, 4)
    )
    + """ FROM (SELECT *, CASE WHEN n_chars % 2 = 0 THEN 'admitted' ELSE 'abx_ordered_ed' END AS task,
             CASE WHEN n_chars % 3 = 0 THEN 'reversed' ELSE 'forward' END AS prompt_order
           FROM documents) JOIN templates USING (task, prompt_order) GROUP BY ALL""",
)
def prompts(spark, sf_dir):
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(n % 2 == 0, "admitted").otherwise("abx_ordered_ed").alias("task"),
        F.when(n % 3 == 0, "reversed").otherwise("forward").alias("prompt_order"),
        F.col("lang").alias("history_text"),
        F.col("text").alias("examination_text"),
    )
    return build_prompts(rows, template_table(spark)).drop("history_text", "examination_text")


@query(
    "response_content",
    with_tables("responses")
    + f"""SELECT task, sample, encounter_id, variant, {content('response_json')} AS content
          FROM responses""",
)
def contents(spark, sf_dir):
    return responses(spark, sf_dir).select(
        "task", "sample", "encounter_id", "variant", response_content("response_json").alias("content")
    )


@query(
    "parse_label",
    with_tables("answers")
    + f"""SELECT task, encounter_id, variant, content, {label('content')} AS label,
          {label("CASE WHEN event_type = 'error' THEN 'response_error' ELSE content END")}
            AS label_or_error FROM answers""",
)
def labels(spark, sf_dir):
    failed = F.when(F.col("event_type") == "error", "response_error").otherwise(F.col("content"))
    return answers(spark, sf_dir).select(
        "task",
        "encounter_id",
        "variant",
        "content",
        parse_label("content").alias("label"),
        parse_label(failed).alias("label_or_error"),
    )
