"""The cohort: one row per note of an adult visit, with what was ordered during it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caseflow.fixed_values import (
    ADULT_AGE,
    IMAGING_PREFIXES,
    MEDICATION_CLASS,
    NOTE_TYPE,
    SPECIALTIES,
)
from caseflow.functions.text import strip_commas
from caseflow.functions.values import (
    age_years,
    flag_present,
    order_timestamp,
    starts_with_any,
)
from caseflow.operators.frame import merge, parse_timestamps, split_by_age
from caseflow.operators.orders import (
    PART_ROWS,
    collect_per_key,
    orders_during_visit,
)
from caseflow.operators.skew import (
    FAN,
    MIN_HOT_ROWS,
    SALT,
    copy_hot,
    hot_keys,
    salted_join,
    spread_hot,
    spread_join,
)
from caseflow.schemas import NOTE_METADATA, VISITS, require_columns
from caseflow.sources import bucketed_by, stage_table

VISIT_TIMES = ("arrival_datetime", "departure_datetime")
MAX_BROADCAST_KEYS = 20_000_000  # hashed note keys, some half a gigabyte
DEMOGRAPHICS = ("sex", "ethnicity", "firstrace", "multiracial")


def add_demographics(visits: DataFrame, patients: DataFrame) -> DataFrame:
    """Patient columns on every visit; visits of unknown patients stay."""
    columns = patients.select("patient_id", *DEMOGRAPHICS)
    return merge(visits, columns, "patient_id", "patient_id", "left")


def add_age(visits: DataFrame, durations: DataFrame) -> DataFrame:
    """Days and age in years on every visit, looked up by the age key."""
    days = durations.select("durationkey", "days")
    return merge(visits, days, "agekey", "durationkey", "left").withColumn(
        "edvisit_age", age_years("days")
    )


def notes_with_text(metadata: DataFrame, text: DataFrame) -> DataFrame:
    """Note text on the metadata; notes without a text stay."""
    return merge(metadata, text.select("note_id", "note_text"), "note_id", "note_id", "left")


def text_of(notes: DataFrame, text: DataFrame, max_keys: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """`text` without most of the texts that none of `notes`, a stored table, needs.

    With up to `max_keys` notes, eight-byte hashes of their keys are broadcast and
    other texts are dropped where they are read; the join by key that follows settles
    the rest. With more notes all texts go on to the join. A table of texts that is bucketed
    by the note is not moved by the join, so it is left as it is, whatever its size.
    """
    if bucketed_by(text, "note_id") or notes.count() > max_keys:
        return text
    keys = notes.filter("note_id IS NOT NULL").select(F.xxhash64("note_id").alias("_note"))
    return text.join(F.broadcast(keys), F.xxhash64("note_id") == F.col("_note"), "left_semi")


def visit_notes(visits: DataFrame, notes: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Row per note of a visit; the note's own patient key is `patient_id_notes`.

    Notes stay partitioned on the visit and its salt, so that more can be joined to
    them without moving them again.
    """
    renamed = notes.withColumnsRenamed({"patient_id": "patient_id_notes"})
    return spread_join(renamed, visits, "encounter_id", "note_id", "inner", hot=hot)


def imaging_during_visit(
    imaging: DataFrame,
    visits: DataFrame,
    prefixes: Sequence[str] = IMAGING_PREFIXES,
    min_hot: int = MIN_HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Imaging orders of the wanted names placed during each visit, and the hot visits."""
    name = "firstprocedurename"
    wanted = imaging.filter(starts_with_any(name, prefixes)).select(
        "encounter_id", "imagingkey", name, "ordering_datetime"
    )
    hot = stage_table(hot_keys(wanted, "encounter_id", min_hot))
    timed = parse_timestamps(wanted, ["ordering_datetime"])
    return orders_during_visit(timed, visits, "ordering_datetime", "imagingkey", hot=hot), hot


def medications_during_visit(
    medications: DataFrame,
    visits: DataFrame,
    therapeutic_class: str = MEDICATION_CLASS,
    min_hot: int = MIN_HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Medication orders of the class placed during each visit, and the hot visits."""
    wanted = medications.filter(F.col("medicationtherapeuticclass") == therapeutic_class)
    timed = wanted.select(
        "encounter_id",
        "medicationorderkey",
        "medicationgenericname",
        order_timestamp("ordereddatekeyvalue", "orderedtimeofdaykeyvalue").alias(
            "medicationorder_datetime"
        ),
    )
    hot = stage_table(hot_keys(wanted, "encounter_id", min_hot))
    return orders_during_visit(timed, visits, "medicationorder_datetime", "medicationorderkey", hot=hot), hot


def imaging_lists(
    imaging: DataFrame,
    visits: DataFrame,
    prefixes: Sequence[str] = IMAGING_PREFIXES,
    min_hot: int = MIN_HOT_ROWS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Imaging orders placed during each visit, in pages: encounter_id, part,
    imaging_rows, imaging_orders.
    """
    placed, hot = imaging_during_visit(imaging, visits, prefixes, min_hot)
    named = placed.withColumn("imaging_orders", strip_commas("firstprocedurename"))
    order = ["ordering_datetime", "imagingkey"]
    lists = collect_per_key(named, "encounter_id", ["imaging_orders"], order, "", part_rows, hot=hot)
    return lists.withColumnRenamed("rows", "imaging_rows")


def medication_lists(
    medications: DataFrame,
    visits: DataFrame,
    therapeutic_class: str = MEDICATION_CLASS,
    min_hot: int = MIN_HOT_ROWS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Medication orders placed during each visit, in pages: encounter_id, part, abx_rows,
    and the orders as three `_abx_list` columns.
    """
    placed, hot = medications_during_visit(medications, visits, therapeutic_class, min_hot)
    lists = collect_per_key(
        placed,
        "encounter_id",
        ["medicationorderkey", "medicationgenericname", "medicationorder_datetime"],
        ["medicationorder_datetime", "medicationorderkey"],
        "_abx_list",
        part_rows,
        hot=hot,
    )
    return lists.withColumnRenamed("rows", "abx_rows")


def order_pages(imaging: DataFrame, medications: DataFrame) -> DataFrame:
    """Both lists of each visit side by side, a row per page (encounter_id, part), with the
    numbers of orders on the page: imaging_rows and abx_rows, NULL for none.
    """
    return imaging.join(medications, ["encounter_id", "part"], "full_outer")


def order_counts(pages: DataFrame) -> DataFrame:
    """One narrow row per visit with orders: encounter_id, imaging_count, abx_count (NULL for
    none). The pages of a visit are summed where they are before they meet, and their lists
    are not read.
    """
    counts = [F.sum(f"{c}_rows").alias(f"{c}_count") for c in ("imaging", "abx")]
    return pages.groupBy("encounter_id").agg(*counts)


def order_flags(
    imaging: DataFrame, medications: DataFrame, visits: DataFrame, min_hot: int = MIN_HOT_ROWS
) -> DataFrame:
    """Whether anything was ordered during a visit, without a list: one row per visit that
    had an order, with `imaging_ordered` and `abx_ordered`, true or NULL.

    The orders of a visit are reduced to one row before they are moved on, so neither
    their number nor a hot visit matters.
    """
    placed = {
        "imaging_ordered": imaging_during_visit(imaging, visits, min_hot=min_hot)[0],
        "abx_ordered": medications_during_visit(medications, visits, min_hot=min_hot)[0],
    }
    had = [df.select("encounter_id").distinct().withColumn(name, F.lit(True)) for name, df in placed.items()]
    return had[0].join(had[1], "encounter_id", "full_outer")


def add_order_lists(
    notes: DataFrame,
    pages: DataFrame,
    hot: DataFrame | None = None,
    min_hot: int = MIN_HOT_ROWS,
    per_visit: DataFrame | None = None,
) -> DataFrame:
    """Attach the order lists of each visit to its notes: one row per note and page.

    Every note gets every page, so a list is never cut off and no row is longer than a
    page. A visit of up to one page, or without orders, leaves one row per note, with part
    0. `per_visit` (one row per visit) is attached to all of them.

    The first page goes to the notes where they are, those of `hot` visits spread over salts
    and the page copied to each. Later pages, which few visits have, meet the notes by visit,
    page and salt: never all pages of a visit in one task. `pages` is read several times, so
    it is best a stored table.
    """
    hot = hot_keys(notes, "encounter_id", min_hot) if hot is None else hot
    salted = SALT in notes.columns
    if not salted:
        notes = spread_hot(notes, "encounter_id", "note_id", hot)
    # The last page of each visit, and what else there is one row per visit of.
    visits = pages.groupBy("encounter_id").agg(F.max("part").alias("_last"))
    if per_visit is not None:
        visits = visits.join(per_visit, "encounter_id", "left")
    known = salted_join(notes, visits, "encounter_id", hot, "left")
    first = salted_join(known, pages.filter("part = 0"), "encounter_id", hot, "left")
    first = first.withColumn("part", F.lit(0).cast("long"))
    numbered = known.filter("_last > 0").withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), "_last")))
    others = copy_hot(pages.filter("part > 0"), "encounter_id", hot)
    later = numbered.join(others, ["encounter_id", "part", SALT])
    joined = first.unionByName(later).drop("_last")
    return joined if salted else joined.drop(SALT, FAN)


def add_site_label(df: DataFrame, sites: DataFrame, locations: DataFrame) -> DataFrame:
    """Location value of each row's care site; rows of unknown sites stay."""
    full = merge(sites, locations, "location_id", "location_id", "outer")
    labels = full.select("care_site_id", "location_source_value")
    return merge(df, labels, "care_site_id", "care_site_id", "left")


def adult_visits(visits: DataFrame, durations: DataFrame) -> DataFrame:
    """Visits of adults with their age, their times parsed."""
    adults, _ = split_by_age(add_age(visits, durations), ADULT_AGE)
    return parse_timestamps(adults.drop("agekey"), VISIT_TIMES)


def provider_notes(metadata: DataFrame, specialties: Sequence[str] = SPECIALTIES) -> DataFrame:
    return metadata.filter(
        (F.col("note_type") == NOTE_TYPE) & F.col("prov_specialty").isin(*specialties)
    )


def build_cohort(
    tables: Mapping[str, DataFrame],
    specialties: Sequence[str] = SPECIALTIES,
    orders_per_note: bool = False,
    stage: bool = True,
    min_hot: int = MIN_HOT_ROWS,
    part_rows: int = PART_ROWS,
    lists: bool = True,
    text: bool = True,
) -> DataFrame:
    """The whole cohort from visits, patients, durations, note_metadata, note_text,
    imaging and medications.

    Note text is by far the widest column, so it is joined last, to the notes that
    are left, or not at all without `text` (see `prepare_notes`). Until then the notes of a
    visit with up to a page of orders move once: the visit and its orders are joined on the
    partitioning the notes already have. A note has a row for each page of `part_rows` orders
    of its visit (`add_order_lists`), which is one for nearly all. `orders_per_note` adds
    order_copies, the number of notes of the visit, which is how often each medication order
    counts then.

    Without `lists` a note has one row and, of the orders of its visit, the flags
    imaging_orders_binary and abx_ordered_ed alone: no list is made.

    With `stage` the order pages are written to the shared folder, and so are the notes
    before their text is joined. Their number is then known, and texts that no note needs are
    not moved; and however often the cohort is read, only the text join runs again.
    """
    for name in _NEEDED:
        require_columns(tables[name], _NEEDED[name], name)
    if orders_per_note and not lists:
        raise ValueError("orders_per_note needs lists")
    metadata = _known(provider_notes(tables["note_metadata"], specialties), NOTE_METADATA)
    visits = adult_visits(_known(tables["visits"], VISITS), tables["durations"])
    hot = stage_table(hot_keys(metadata, "encounter_id", min_hot))
    described = add_demographics(visits, tables["patients"])
    notes = visit_notes(described, metadata, hot)

    if lists:
        pages = order_pages(
            imaging_lists(tables["imaging"], visits, min_hot=min_hot, part_rows=part_rows),
            medication_lists(tables["medications"], visits, min_hot=min_hot, part_rows=part_rows),
        )
        pages = stage_table(pages) if stage else pages
        per_visit = order_counts(pages)
        if orders_per_note:
            copies = notes.groupBy("encounter_id").agg(F.count(F.lit(1)).alias("order_copies"))
            per_visit = per_visit.join(copies, "encounter_id", "left")
        notes = add_order_lists(notes, pages.drop("imaging_rows", "abx_rows"), hot, per_visit=per_visit)
        notes = notes.withColumn("abx_ordered_ed", flag_present("abx_count"))
    else:
        flags = order_flags(tables["imaging"], tables["medications"], visits, min_hot)
        notes = salted_join(notes, flags, "encounter_id", hot, "left").withColumns(
            {"imaging_orders_binary": flag_present("imaging_ordered"), "abx_ordered_ed": flag_present("abx_ordered")}
        )
        notes = notes.drop("imaging_ordered", "abx_ordered")
    notes, texts = notes.drop(SALT, FAN), tables["note_text"]
    if stage:
        notes = stage_table(notes)
    if not text:
        return notes
    return notes_with_text(notes, text_of(notes, texts) if stage else texts)


_NEEDED = {
    "visits": ("patient_id", "encounter_id", "agekey", *VISIT_TIMES),
    "patients": ("patient_id", *DEMOGRAPHICS),
    "durations": ("durationkey", "days"),
    "note_metadata": ("patient_id", "note_id", "encounter_id", "note_type", "prov_specialty"),
    "note_text": ("note_id", "note_text"),
    "imaging": ("encounter_id", "imagingkey", "firstprocedurename", "ordering_datetime"),
    "medications": (
        "encounter_id",
        "medicationorderkey",
        "medicationgenericname",
        "medicationtherapeuticclass",
        "ordereddatekeyvalue",
        "orderedtimeofdaykeyvalue",
    ),
}


def _known(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of `schema` that are there, and no others."""
    return df.select(*[c for c in schema.names if c in df.columns])


def funnel(steps: Mapping[str, Column], df: DataFrame) -> DataFrame:
    """Rows, patients and visits left after each filter: step, name, rows, patients, visits.

    `steps` maps a name to its condition; conditions add up in the given order. A row is
    thus described by how many of them it passes, a patient or visit by the most that
    any of its rows passes, and no row is repeated per step.
    """
    kept, passed = F.lit(True), F.lit(0)
    for condition in steps.values():
        kept = kept & F.coalesce(condition, F.lit(False))
        passed = passed + F.when(kept, 1).otherwise(0)
    levels = df.select(passed.alias("level"), "patient_id", "encounter_id")
    ids = F.array(
        F.struct(F.lit("patients").alias("kind"), F.col("patient_id").cast("string").alias("id")),
        F.struct(F.lit("visits").alias("kind"), F.col("encounter_id").cast("string").alias("id")),
    )
    highest = (
        levels.select("level", F.inline(ids))
        .filter("id IS NOT NULL")
        .groupBy("kind", "id")
        .agg(F.max("level").alias("level"))
    )
    counts = levels.select(F.lit("rows").alias("kind"), "level").unionByName(
        highest.select("kind", "level")
    )
    by_level = counts.groupBy("kind", "level").agg(F.count(F.lit(1)).alias("n"))

    def left(kind: str, step: int) -> Column:
        reached = (F.col("kind") == kind) & (F.col("level") > step)
        return F.coalesce(F.sum(F.when(reached, F.col("n"))), F.lit(0)).alias(kind)

    rows = by_level.agg(
        *[
            F.struct(*[left(kind, i) for kind in ("rows", "patients", "visits")]).alias(f"_{i}")
            for i in range(len(steps))
        ]
    )
    table = F.array(
        *[
            F.struct(
                F.lit(i).alias("step"),
                F.lit(name).alias("name"),
                *[F.col(f"_{i}.{kind}").alias(kind) for kind in ("rows", "patients", "visits")],
            )
            for i, name in enumerate(steps)
        ]
    )
    return rows.select(F.inline(table))


__all__ = [
    "add_age",
    "add_demographics",
    "add_order_lists",
    "add_site_label",
    "adult_visits",
    "build_cohort",
    "funnel",
    "imaging_during_visit",
    "imaging_lists",
    "medication_lists",
    "medications_during_visit",
    "notes_with_text",
    "order_counts",
    "order_flags",
    "order_pages",
    "provider_notes",
    "text_of",
    "visit_notes",
]
