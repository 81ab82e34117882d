"""Text columns against small independent Python versions, on random texts."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from caseflow.functions.responses import parse_label, response_content
from caseflow.functions.text import (
    build_prompt,
    clean_text,
    contains_any,
    section_between,
    section_fallback,
    section_tail,
    strip_commas,
    token_count,
    word_count,
)
from caseflow.plans.notes import (
    HEADINGS,
    add_sections,
    add_token_counts,
    drop_unusable,
    unusable_counts,
    within_token_limit,
    write_usable,
)
from caseflow.sources import shared_folder, write_filtered

PIECES = [
    *HEADINGS["complaint"], *HEADINGS["exam"], *HEADINGS["assessment"], *HEADINGS["course"],
    "chief complaint", "physical exam", " ", "  ", "\n", "\t", "pain", "é", "漢字", "🙂", "x,y", "0", "1", " ",
]


def texts(n=1500, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def notes(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "i int, t string").repartition(4)
    return df.cache()


def by_row(df, *columns):
    got = {r[0]: r[1:] for r in df.select("i", *columns).collect()}
    return [got[i] for i in range(len(got))]


def find(text, words):
    hit = re.search("|".join(words), text)
    return None if hit is None else hit.start()


def cut(text, starts, ends):
    a, b = find(text, starts), find(text, ends)
    return "unable_to_extract" if a is None or b is None else text[a:b]


def expected_sections(t):
    complaint, exam, assess, course = HEADINGS.values()
    history = cut(t, complaint, exam)
    if any(w in t for w in assess):
        examination = cut(t, exam, assess)
    elif any(w in t for w in course):
        examination = cut(t, exam, course)
    else:
        examination = "unable_to_extract"
    at = find(t, assess)
    at = find(t, course) if at is None else at
    return history, examination, "unable_to_extract" if at is None else t[at:]


def test_sections(notes):
    names = ("history_text", "examination_text", "assessment_plan_text")
    got = by_row(add_sections(notes, "t"), *names)
    want = [expected_sections(t) for t in texts()]
    assert got == want
    kinds = {"unable_to_extract", ""}
    assert all(kinds <= {w[i] for w in want} for i in (0, 1)), "the texts must cover all cases"


def test_single_section_columns(notes):
    complaint, exam, assess, course = HEADINGS.values()
    got = by_row(
        notes,
        section_between("t", complaint, exam),
        section_fallback("t", exam, assess, course),
        section_tail("t", assess, course),
    )
    assert got == [expected_sections(t) for t in texts()]


def test_one_heading(spark):
    df = spark.createDataFrame([(0, "a HEAD b END c"), (1, "none")], "i int, t string")
    got = by_row(df, section_between("t", ["HEAD"], ["END"]), section_tail("t", ["END"], ["HEAD"]))
    assert got == [("HEAD b ", "END c"), ("unable_to_extract",) * 2]


def test_clean_and_counts(notes):
    got = by_row(notes, clean_text("t"), word_count("t"), token_count("t"), strip_commas("t"))
    assert got == [
        (re.sub(" +", " ", t.replace("\n", "")), len(t.split()), -(-len(t) // 4), t.replace(",", ""))
        for t in texts()
    ]


def test_words_break_where_python_breaks_them(spark):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    others = ["​", "﻿", "_", "-"]
    rows = [(i, f"a{b}b") for i, b in enumerate(blanks + others)]
    got = by_row(spark.createDataFrame(rows, "i int, t string"), word_count("t"))
    assert got == [(len(t.split()),) for _, t in rows]


def test_missing_text(spark):
    df = spark.createDataFrame([(0, None)], "i int, t string")
    assert by_row(df, word_count("t")) == [(1,)]
    row = add_sections(df, "t").first()
    assert (row.history_text, row.examination_text) == ("unable_to_extract",) * 2


def test_contains_any(spark):
    df = spark.createDataFrame([(0, "ab"), (1, "cd"), (2, "x")], "i int, t string")
    assert by_row(df, contains_any("t", ["a", "d"])) == [(True,), (True,), (False,)]


def test_token_limit_leaves_out_the_limit_itself(spark):
    df = spark.createDataFrame([(0, "x" * 15996), (1, "x" * 15997), (2, "x" * 16001)], "i int, note_text_processed string")
    counted = add_token_counts(df, ["note_text_processed"])
    assert by_row(within_token_limit(counted), "note_text_processed_tokens") == [(3999,)]


def test_a_joined_token_count_is_kept(spark):
    df = spark.createDataFrame([(0, "some text", 7)], "i int, t string, t_tokens int")
    assert by_row(add_token_counts(df, ["t"]), "t_tokens") == [(7,)]


def test_unusable_counts_fall_to_what_drop_unusable_keeps(notes):
    cut_notes = add_sections(notes, "t")
    steps = [r.rows for r in unusable_counts(cut_notes).orderBy("step").collect()]
    kept = [t for t in texts() if not {"unable_to_extract", ""} & set(expected_sections(t))]
    assert len(steps) == 10 and steps == sorted(steps, reverse=True)
    assert steps[0] == len(texts()) and steps[-1] == len(kept) == drop_unusable(cut_notes).count()


def test_usable_notes_are_written_and_counted_in_one_pass(notes):
    cut_notes = add_sections(notes, "t")
    usable, counts = write_usable(cut_notes, shared_folder(notes.sparkSession))
    assert sorted(map(str, usable.collect())) == sorted(map(str, drop_unusable(cut_notes).collect()))
    assert [tuple(r) for r in counts.orderBy("step").collect()] == [tuple(r) for r in unusable_counts(cut_notes).orderBy("step").collect()]


def test_rows_are_counted_as_they_are_written(spark):
    df = spark.range(100).selectExpr("id", "IF(id % 10 = 0, NULL, id) AS x").repartition(7)
    steps = {"known": F.col("x").isNotNull(), "small": F.col("x") < 50, "null": F.lit(None).cast("boolean")}
    kept, counts = write_filtered(df, shared_folder(spark), dict(list(steps.items())[:2]))
    assert sorted(r.id for r in kept.collect()) == [i for i in range(50) if i % 10]
    assert [tuple(r) for r in counts.orderBy("step").collect()] == [(0, "start", 100), (1, "known", 90), (2, "small", 45)]
    kept, counts = write_filtered(df, shared_folder(spark), steps)
    assert kept.count() == 0 and counts.orderBy("step").collect()[-1].rows == 0


def test_prompt_layout(spark):
    df = spark.createDataFrame([("ask", "past", "now")], "t string, h string, e string")
    assert df.select(build_prompt("t", "h", "e")).first()[0] == 'ask  \n\n"""past now"""'


def reply(content):
    return json.dumps({"choices": [{"message": {"role": "assistant", "content": content}}]})


def test_response_content(spark):
    good = ["0: no", 'said "1"\nnext', "é🙂", ""]
    bad = ["", "{", "[]", '{"choices": []}', reply(None), reply("x") + " tail", reply("x").replace('"', "'"), None]
    df = spark.createDataFrame(list(enumerate([reply(g) for g in good] + bad)), "i int, j string")
    got = [r[0] for r in by_row(df, response_content("j"))]
    assert got == good + ["response_error"] * len(bad)


def test_labels(spark):
    answers = ["0: no", "1: yes", "0 or 1", "10", "none", "response_error", "", "21"]
    df = spark.createDataFrame(list(enumerate(answers)), "i int, t string")
    got = by_row(df, parse_label("t"), parse_label("t", strict=True))
    assert [g[0] for g in got] == ["0", "1", "0", "0", "neither", "error", "neither", "1"]
    assert [g[1] for g in got] == ["0", "1", "both_present", "both_present", "neither", "error", "neither", "1"]
