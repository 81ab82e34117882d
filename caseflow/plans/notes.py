"""Cleaned, deduplicated, sectioned and filtered notes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.fixed_values import (
    CHIEF_COMPLAINT,
    ED_COURSE,
    INITIAL_ASSESSMENT,
    NO_SECTION,
    PHYSICAL_EXAM,
    TOKEN_LIMIT,
)
from caseflow.functions.text import (
    clean_text,
    cut_between,
    cut_from,
    first_position,
    token_count,
)
from caseflow.functions.values import flag_not_sentinel, flag_present, string_key
from caseflow.operators.dedupe import first_note
from caseflow.operators.frame import add_once, keep_notnull, merge
from caseflow.plans.cohort import text_of
from caseflow.sources import stage_table, write_filtered

HEADINGS = {
    "complaint": CHIEF_COMPLAINT,
    "exam": PHYSICAL_EXAM,
    "assessment": INITIAL_ASSESSMENT,
    "course": ED_COURSE,
}
SECTIONS = ("history_text", "examination_text", "assessment_plan_text")


def add_sections(
    df: DataFrame,
    text: str = "note_text_processed",
    headings: Mapping[str, Sequence[str]] = HEADINGS,
    sentinel: str = NO_SECTION,
) -> DataFrame:
    """History, examination and assessment/plan cut out of the text.

    The text is searched once per heading; the three sections share the places.
    """
    places = {f"_{name}": first_position(text, words) for name, words in headings.items()}
    close = F.coalesce("_assessment", "_course")
    sections = {
        "history_text": cut_between(text, F.col("_complaint"), F.col("_exam"), sentinel),
        "examination_text": cut_between(text, F.col("_exam"), close, sentinel),
        "assessment_plan_text": cut_from(text, close, sentinel),
    }
    return add_once(add_once(df, places), sections).drop(*places)


def add_token_counts(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """`<text>_tokens` for each text column that has no such column yet."""
    return df.withColumns(
        {f"{c}_tokens": token_count(c) for c in texts if f"{c}_tokens" not in df.columns}
    )


def drop_unusable(
    df: DataFrame, columns: Sequence[str] = SECTIONS, sentinel: str = NO_SECTION
) -> DataFrame:
    """Rows whose columns are all there: not NULL, not the sentinel, not ''."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & ~F.col(c).isin(sentinel, ""))
    return df


def _usable_steps(columns: Sequence[str], sentinel: str) -> dict[tuple[str, str], Column]:
    checks = {
        "null": lambda c: c.isNotNull(),
        "sentinel": lambda c: c != sentinel,
        "empty": lambda c: c != "",
    }
    return {(check, c): test(F.col(c)) for check, test in checks.items() for c in columns}


def write_usable(
    df: DataFrame, path: str, columns: Sequence[str] = SECTIONS, sentinel: str = NO_SECTION
) -> tuple[DataFrame, DataFrame]:
    """Write the rows of `drop_unusable` to `path`; the written table, and the counts of
    `unusable_counts` from the same pass."""
    steps = _usable_steps(columns, sentinel)
    usable, counts = write_filtered(df, path, {f"{check}:{c}": passed for (check, c), passed in steps.items()})
    names = F.split("name", ":")
    named = [names[0].alias("check"), F.when(F.size(names) > 1, names[1]).otherwise("").alias("column")]
    return usable, counts.select("step", *named, "rows")


def unusable_counts(
    df: DataFrame, columns: Sequence[str] = SECTIONS, sentinel: str = NO_SECTION
) -> DataFrame:
    """Rows left after each check of `drop_unusable`: step, check, column, rows.

    The order is NULL, sentinel, '' with all columns inside each; one scan counts
    every step.
    """
    kept, counts, names = F.lit(True), [F.count(F.lit(1)).alias("_0")], [("start", "")]
    for (check, c), passed in _usable_steps(columns, sentinel).items():
        kept = kept & passed
        names.append((check, c))
        counts.append(F.count(F.when(kept, 1)).alias(f"_{len(counts)}"))
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("step"),
                F.lit(check).alias("check"),
                F.lit(c).alias("column"),
                F.col(f"_{i}").alias("rows"),
            )
            for i, (check, c) in enumerate(names)
        ]
    )
    return df.agg(*counts).select(F.inline(rows))


def within_token_limit(
    df: DataFrame, tokens: str = "note_text_processed_tokens", limit: int = TOKEN_LIMIT
) -> DataFrame:
    """Rows below the limit; a text of exactly `limit` tokens is out."""
    return df.filter(F.col(tokens) < limit)


def rank_first_notes(notes: DataFrame, note_text: DataFrame) -> DataFrame:
    """First note per encounter of `notes`, which have no text: the length that ranks notes
    of one date is worked out where the texts are read, and only lengths are moved.
    """
    size = F.length(clean_text(string_key("note_text"))).alias("_length")
    ranked = merge(notes, note_text.select("note_id", size), "note_id", "note_id", "left")
    return first_note(ranked, length="_length").drop("_length")


def sectioned_notes(
    cohort: DataFrame,
    headings: Mapping[str, Sequence[str]] = HEADINGS,
    sentinel: str = NO_SECTION,
    note_text: DataFrame | None = None,
) -> DataFrame:
    """First note per encounter with outcome flag, clean text, sections, tokens.

    The clean text takes the place of `note_text`, so that only one of them moves. Of a
    cohort without text, and the texts (`note_text`, one per note_id) beside it, the first
    notes are found before any text is moved, and only theirs are.
    """
    keyed = keep_notnull(cohort, "encounter_id").withColumns(
        {"encounter_id": string_key("encounter_id"), "admitted": flag_not_sentinel("admission_id")}
    )
    clean = clean_text(string_key("note_text")).alias("note_text_processed")
    if note_text is None:
        first = first_note(keyed.withColumn("note_text_processed", clean).drop("note_text"))
    else:
        first = stage_table(rank_first_notes(keyed, text_of(cohort, note_text)))
        texts = text_of(first, note_text).select("note_id", clean)
        first = merge(first, texts, "note_id", "note_id", "left")
    cut = add_sections(
        first.withColumn("note_length_words", F.length("note_text_processed")),
        "note_text_processed",
        headings,
        sentinel,
    )
    return add_token_counts(cut, ["note_text_processed", *SECTIONS])


def prepare_notes(
    cohort: DataFrame,
    headings: Mapping[str, Sequence[str]] = HEADINGS,
    sentinel: str = NO_SECTION,
    limit: int = TOKEN_LIMIT,
    note_text: DataFrame | None = None,
) -> DataFrame:
    """Notes ready to sample from: all sections usable, text within the limit.

    Of a cohort in pages (`part`) the first page of each note is used; it has an order of
    every kind that the visit has. A cohort without lists brings imaging_orders_binary
    itself, one without text needs the texts as `note_text`.
    """
    if "part" in cohort.columns:
        cohort = cohort.filter("part = 0")
    sectioned = sectioned_notes(cohort, headings, sentinel, note_text)
    usable = within_token_limit(drop_unusable(sectioned, SECTIONS, sentinel), limit=limit)
    added = {
        "history_examination_text_tokens": F.col("history_text_tokens") + F.col("examination_text_tokens")
    }
    if "imaging_orders" in cohort.columns:
        added["imaging_orders_binary"] = flag_present("imaging_orders")
    return usable.withColumns(added)
