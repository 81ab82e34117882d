"""The jobs from end to end on the small clinic."""

from __future__ import annotations

import json
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from caseflow.fixed_values import LABEL_COLUMNS, PROMPT_COLUMNS
from caseflow.operators.frame import same_keys
from caseflow.operators.profile import cohort_stats
from caseflow.plans.answers import attach_responses, ingest_responses
from caseflow.plans.cohort import (
    add_order_lists,
    add_site_label,
    adult_visits,
    build_cohort,
    funnel,
    order_counts,
    text_of,
)
from caseflow.plans.notes import prepare_notes, rank_first_notes, sectioned_notes
from caseflow.plans.prompts import QUESTIONS, build_prompts, template_rows, template_table
from caseflow.plans.reports import (
    attach_human_left,
    main_report,
    sensitivity_report,
    unbalanced_report,
    word_counts,
)
from caseflow.plans.tasks import SampleSpec, scoring_requests, task_sets
from caseflow.schemas import RESPONSES
from caseflow.sources import stage_table
from tests import clinic
from tests.conftest import plan_of

SPECIALTIES = ("Emergency Medicine", "Site Code")
SPEC = SampleSpec(per_class=5, unbalanced=20, labelling=6)


@pytest.fixture(scope="module")
def tables(spark):
    return clinic.tables(spark)


@pytest.fixture(scope="module")
def cohort(tables):
    return build_cohort(tables, SPECIALTIES).cache()


@pytest.fixture(scope="module")
def prepared(cohort):
    return prepare_notes(cohort).cache()


@pytest.fixture(scope="module")
def sets(prepared):
    return task_sets(prepared, SPEC).cache()


def test_cohort_rows(cohort):
    assert sorted(r.note_id for r in cohort.collect()) == sorted(clinic.COHORT_NOTES)


def test_cohort_lists(cohort):
    for r in cohort.collect():
        e = r.encounter_id
        assert r.imaging_orders == clinic.IMAGING_LISTS.get(e), e
        keys, names = clinic.ABX_LISTS.get(e, (None, None))
        assert (r.medicationorderkey_abx_list, r.medicationgenericname_abx_list) == (keys, names), e
        assert r.abx_ordered_ed == ("Y" if keys else "N")
        assert r.part == 0
        assert r.imaging_count == (len(clinic.IMAGING_LISTS[e]) if e in clinic.IMAGING_LISTS else None)
        assert r.abx_count == (len(keys) if keys else None)


def test_cohort_columns(cohort):
    rows = {r.note_id: r for r in cohort.collect()}
    visits = {v["encounter_id"]: v for v in clinic.VISITS}
    sex = {p[0]: p[1] for p in clinic.PATIENTS}
    texts = {n[0]: n[5] for n in clinic.NOTES}
    for note, r in rows.items():
        assert r.patient_id == visits[r.encounter_id]["patient_id"] and r.patient_id_notes == "other"
        assert r.sex == sex.get(r.patient_id)
        assert r.edvisit_age == pytest.approx(r.days / 365.25) and r.edvisit_age >= 18
        assert r.note_text == texts[note]
    assert rows["n2"].days == 6575
    assert not [c for c in cohort.columns if c.startswith("_")]


@pytest.mark.parametrize("min_hot, stage", [(1, False), (2, True), (10**6, False)])
def test_hot_visits_and_staging_change_nothing(tables, cohort, min_hot, stage):
    salted = build_cohort(tables, SPECIALTIES, stage=stage, min_hot=min_hot)
    assert salted.columns == cohort.columns
    assert sorted(map(str, salted.collect())) == sorted(map(str, cohort.collect()))


@pytest.mark.parametrize("min_hot", [1, 2, 10**6])
def test_pages_put_end_to_end_are_the_lists(tables, min_hot):
    paged = build_cohort(tables, SPECIALTIES, min_hot=min_hot, part_rows=2)
    lists = ["imaging_orders", "medicationorderkey_abx_list", "medicationgenericname_abx_list"]
    joined = defaultdict(lambda: [[], [], []])
    flags = defaultdict(set)
    for r in sorted(paged.collect(), key=lambda r: r.part):
        for whole, c in zip(joined[r.note_id], lists):
            assert len(r[c] or []) <= 2
            whole += r[c] or []
        flags[r.encounter_id].add((r.abx_ordered_ed, r.imaging_count, r.abx_count))
    assert set(joined) == set(clinic.COHORT_NOTES)
    for r in build_cohort(tables, SPECIALTIES).collect():
        assert joined[r.note_id] == [r[c] or [] for c in lists]
        assert flags[r.encounter_id] == {(r.abx_ordered_ed, r.imaging_count, r.abx_count)}
    assert sorted(map(str, prepare_notes(paged).drop("part", *lists, "medicationorder_datetime_abx_list").collect())) == sorted(
        map(str, prepare_notes(build_cohort(tables, SPECIALTIES)).drop("part", *lists, "medicationorder_datetime_abx_list").collect())
    )


@pytest.mark.parametrize("min_hot, stage", [(1, True), (2, False), (10**6, True)])
def test_a_cohort_of_flags_has_no_lists_and_the_same_flags(tables, cohort, min_hot, stage):
    flags = build_cohort(tables, SPECIALTIES, min_hot=min_hot, stage=stage, lists=False)
    assert not {"part", "imaging_orders", "imaging_count", "abx_count"} & set(flags.columns)
    want = {r.note_id: ("N" if r.imaging_orders is None else "Y", r.abx_ordered_ed, r.note_text) for r in cohort.collect()}
    assert {r.note_id: (r.imaging_orders_binary, r.abx_ordered_ed, r.note_text) for r in flags.collect()} == want
    with pytest.raises(ValueError):
        build_cohort(tables, SPECIALTIES, lists=False, orders_per_note=True)


@pytest.mark.parametrize("lists", [True, False])
def test_notes_prepared_with_their_text_last_are_the_same(tables, prepared, lists):
    notes = build_cohort(tables, SPECIALTIES, lists=lists, text=False)
    assert "note_text" not in notes.columns
    late = prepare_notes(notes, note_text=tables["note_text"])
    both = [c for c in prepared.columns if c in late.columns]
    assert {"note_text_processed", "imaging_orders_binary", "history_text"} <= set(both)
    assert sorted(map(str, late.select(both).collect())) == sorted(map(str, prepared.select(both).collect()))


def test_no_text_is_moved_to_find_first_notes(tables):
    notes = build_cohort(tables, SPECIALTIES, lists=False, text=False)
    ranked = rank_first_notes(notes, text_of(notes, tables["note_text"]))
    plan = ranked._jdf.queryExecution().explainString(ranked.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = re.findall(r"\n\(\d+\) (\w+)[^\n]*\n(?:Left keys[^\n]*\n|Right keys[^\n]*\n)?Input *(?:\[\d+\])?: \[([^\n]*)\]", plan)
    moved = {name: columns for name, columns in nodes if name in ("Exchange", "BroadcastExchange", "Window", "Sort", "WindowGroupLimit")}
    assert "Window" in moved and "_length" in moved["Window"]
    assert not any("note_text#" in columns for columns in moved.values())


def test_no_list_is_made_for_prepared_notes(spark, tables):
    plan = plan_of(build_cohort(tables, SPECIALTIES, stage=False, lists=False, text=False))
    assert "collect_list" not in plan and "array_sort" not in plan


def test_pages_of_a_visit_do_not_meet(spark, tables):
    """No exchange deals pages, with their lists, out by the visit alone."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        notes = spark.createDataFrame([("v", "n1"), ("v", "n2"), ("w", "n3")], "encounter_id string, note_id string")
        rows = [("v", i, [f"o{i}"], 1) for i in range(5)] + [("w", 0, ["p"], 1)]
        pages = stage_table(spark.createDataFrame(rows, "encounter_id string, part bigint, l array<string>, imaging_rows bigint").withColumn("abx_rows", F.lit(None).cast("bigint")))
        listed = add_order_lists(notes, pages.drop("imaging_rows", "abx_rows"), min_hot=1, per_visit=order_counts(pages))
        plan = plan_of(listed)
        got = sorted((r.note_id, r.part, r.l, r.imaging_count, r.abx_count) for r in listed.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted([(n, i, [f"o{i}"], 5, None) for n in ("n1", "n2") for i in range(5)] + [("n3", 0, ["p"], 1, None)])
    assert "Window" not in plan
    lines = plan.splitlines()
    joins = [l for l in lines if "SortMergeJoin" in l and "part" in l]
    assert joins and all("_salt" in l and "encounter_id" in l for l in joins)
    # What is dealt out by the visit alone is counted, one row per visit, and has no list.
    alone = [i for i, l in enumerate(lines) if "Exchange hashpartitioning(encounter_id#" in l and "part#" not in l and "_salt" not in l]
    assert all("Aggregate" in lines[i + 1] or "Aggregate" in lines[i + 2] for i in alone)


def test_notes_of_a_stored_cohort_without_pages(cohort, prepared):
    stored = prepare_notes(cohort.drop("part", "imaging_count", "abx_count"))
    keys = ["encounter_id", "imaging_orders_binary", "abx_ordered_ed"]
    assert sorted(map(tuple, stored.select(keys).collect())) == sorted(map(tuple, prepared.select(keys).collect()))


def test_orders_per_note(tables):
    per_note = {r.note_id: r for r in build_cohort(tables, SPECIALTIES, orders_per_note=True).collect()}
    assert len(per_note) == len(clinic.COHORT_NOTES)
    assert (per_note["n5a"].medicationorderkey_abx_list, per_note["n5a"].order_copies) == (["m1", "m2"], 3)
    assert (per_note["n7a"].medicationorderkey_abx_list, per_note["n7a"].order_copies) == (["m7"], 2)
    assert per_note["n14"].order_copies == 1


def test_cohort_stats_and_funnel(cohort):
    assert cohort_stats(cohort).first().rows == len(clinic.COHORT_NOTES)
    steps = funnel({"all": F.lit(True), "abx": F.col("abx_ordered_ed") == "Y", "img": F.col("imaging_orders").isNotNull()}, cohort)
    got = {r.name: (r.rows, r.visits) for r in steps.collect()}
    both = set(clinic.ABX_LISTS) & set(clinic.IMAGING_LISTS)
    assert got["abx"][1] == len(clinic.ABX_LISTS)
    assert got["img"][1] == len(both)
    assert got["all"][0] == len(clinic.COHORT_NOTES)
    none = funnel({"none": F.lit(None).cast("boolean"), "all": F.lit(True)}, cohort).collect()
    assert [tuple(r) for r in none] == [(0, "none", 0, 0, 0), (1, "all", 0, 0, 0)]


def test_missing_input_columns_raise(tables):
    with pytest.raises(ValueError, match="visits: missing columns"):
        build_cohort(tables | {"visits": tables["visits"].drop("agekey")})


def test_cohort_plan(spark, sf_dir):
    """Nothing in Python, no cross join; note text is joined last, orders move once."""
    from entries.standins import SPECIALTIES as codes
    from entries.standins import tables as driver_tables

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(build_cohort(driver_tables(spark, sf_dir), codes, stage=False))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
    joins = [l for l in plan.splitlines() if "SortMergeJoin" in l]
    assert "note_id" in joins[0] and "LeftOuter" in joins[0]  # the outermost join
    scans = [l for l in plan.splitlines() if "FileScan" in l and "documents" in l]
    assert sum("text:string" in l for l in scans) == 1


def test_texts_nobody_needs_stay_where_they_are(spark, tables):
    notes = spark.createDataFrame([("n5a",), ("n16",), (None,), ("none",)], "note_id string")
    assert sorted(r.note_id for r in text_of(notes, tables["note_text"]).collect()) == ["n16", "n5a"]
    assert text_of(notes, tables["note_text"], max_keys=3).count() == len(clinic.NOTES)


def test_first_notes(cohort):
    kept = {r.encounter_id: r for r in sectioned_notes(cohort).collect()}
    assert len(kept) == len({r.encounter_id for r in cohort.collect()})
    for e, n in clinic.FIRST_NOTES.items():
        assert kept[e].note_id == n
    assert kept["e3"].admitted == 1  # no admission key at all
    assert (kept["e2"].admitted, kept["e5"].admitted) == (1, 0)
    assert kept["e11"].history_text == "" and kept["e12"].history_text == "unable_to_extract"
    assert kept["e14"].history_text == "Chief Complaint: Fieberund Übelkeit 漢字\t! "
    assert kept["e14"].note_text_processed.endswith("ED Course: a b")
    assert kept["e13"].examination_text == "PHYSICAL EXAM: c "
    assert kept["e13"].assessment_plan_text == "INITIAL ASSESSMENT: d ED COURSE: e"


def test_prepared(prepared, cohort):
    want = {r.encounter_id for r in cohort.collect()} - clinic.UNUSABLE
    rows = {r.encounter_id: r for r in prepared.collect()}
    assert set(rows) == want
    for r in rows.values():
        assert r.imaging_orders_binary == ("Y" if r.encounter_id in clinic.IMAGING_LISTS else "N")
        assert r.history_examination_text_tokens == -(-len(r.history_text) // 4) + -(-len(r.examination_text) // 4)
        assert r.note_text_processed_tokens < 4000
        assert r.note_length_words == len(r.note_text_processed)


def test_task_sets(sets, prepared):
    rows = sets.collect()
    sizes = {}
    for r in rows:
        sizes.setdefault((r.task, r.sample), []).append(r)
    assert set(sizes) == {(t, s) for t in QUESTIONS for s in ("balanced", "unbalanced", "labelling", "reversed")}
    outcome = {r.encounter_id: r for r in prepared.collect()}
    value = {"Y": 1, "N": 0, 1: 1, 0: 0}
    for (task, sample), group in sizes.items():
        n = {"balanced": 10, "unbalanced": 20, "labelling": 6, "reversed": 6}[sample]
        assert sorted(r.position for r in group) == list(range(1, n + 1))
        assert len({r.encounter_id for r in group}) == n
        if sample != "unbalanced":
            assert sum(r.outcome for r in group) == n / 2
        assert {r.prompt_order for r in group} == {"reversed" if sample == "reversed" else "forward"}
        for r in group:
            assert r.outcome == value[outcome[r.encounter_id][task]]
            assert r.history_text == outcome[r.encounter_id].history_text
    for task in QUESTIONS:
        keys = {s: {r.encounter_id for r in sizes[task, s]} for s in ("balanced", "labelling", "reversed")}
        assert keys["labelling"] == keys["reversed"] <= keys["balanced"]
    draws = [{r.encounter_id for r in sizes[t, "unbalanced"]} for t in QUESTIONS]
    assert draws[0] == draws[1] == draws[2]


def test_sets_need_enough_rows(spark, prepared):
    spark.sparkContext.setLogLevel("OFF")
    with pytest.raises(Exception, match="cannot draw 30 rows from"):
        task_sets(prepared, SampleSpec(per_class=30, unbalanced=5, labelling=2)).collect()
    spark.sparkContext.setLogLevel("ERROR")


def test_templates():
    rows = template_rows()
    assert len(rows) == len(set(rows)) == 24
    by = {(t, o, v): x for t, o, v, x in rows}
    for task, (question, restraint, zero, one) in QUESTIONS.items():
        for v in (1, 2, 3, 4):
            forward, backward = by[task, "forward", v], by[task, "reversed", v]
            assert question in forward and (restraint in forward) == (v > 1)
            assert forward.index(zero) < forward.index(one) and backward.index(one) < backward.index(zero)
            assert ("step by step" in forward) == (v == 4)


def test_prompts_and_requests_agree(spark, sets):
    templates = template_table(spark)
    wide = build_prompts(sets, templates).collect()
    asked = {(r.task, r.sample, r.encounter_id, r.variant): r.prompt for r in scoring_requests(sets, templates).collect()}
    assert len(asked) == 4 * len(wide)
    for r in wide:
        for v, name in enumerate(PROMPT_COLUMNS, 1):
            assert asked[r.task, r.sample, r.encounter_id, v] == r[name]
            assert r[name].endswith(f'  \n\n"""{r.history_text} {r.examination_text}"""')


def test_a_repeated_encounter_keeps_its_last_row(spark, sets):
    late = sets.withColumn("position", F.col("position") + 100).withColumn("history_text", F.lit("late"))
    asked = scoring_requests(sets.union(late), template_table(spark))
    assert asked.count() == 4 * sets.count()
    assert asked.filter(~F.col("prompt").contains("late")).count() == 0


def reply(text):
    return json.dumps({"choices": [{"message": {"content": text}}]})


@pytest.fixture(scope="module")
def scored(spark, sets):
    """Right answers from variant 1, always 0 from 2, errors and both digits after."""
    rows = []
    for r in sets.collect():
        answers = [f"{r.outcome}: sure", "0: never", f"{r.outcome} 10" if r.position % 2 else "cannot say", "1"]
        for v, text in enumerate(answers, 1):
            body = "{broken" if v == 4 and r.position == 2 else reply(text)
            if v == 4 and r.position == 3:
                continue  # no response: the case is left out
            rows.append((r.task, r.sample, r.encounter_id, v, body))
    responses = spark.createDataFrame(rows, RESPONSES)
    asked = scoring_requests(sets, template_table(spark))
    return ingest_responses(sets, asked, responses).cache()


def test_ingest(scored, sets):
    kept = scored.collect()
    assert len(kept) == sets.filter("position <> 3").count()
    for r in kept:
        labels = [r[c] for c in LABEL_COLUMNS]
        assert labels[0] == str(r.outcome) and labels[1] == "0"
        assert labels[2] == ("0" if r.position % 2 else "neither")
        assert labels[3] == ("error" if r.position == 2 else "1")
        assert r.response_content_history_examination2 == "0: never"


def human(spark, sets, sample, code):
    rows = [
        (r.task, r.patient_id, r.ed_visit_id, r.encounter_id, code(r))
        for r in sets.filter(F.col("sample") == sample).collect()
    ]
    return spark.createDataFrame(rows, clinic.SCHEMA_OF_HUMAN)


def code(r):
    if r.position == 1:
        return "?"
    if r.task == "imaging_orders_binary":
        return "CT" if r.outcome else "N"
    return "Y" if r.outcome else "N"


def test_main_report(spark, sets, scored):
    rows = {(r.Sample, r.Task, r.Prompt): r for r in main_report(scored, human(spark, sets, "labelling", code)).collect()}
    assert len(rows) == 3 * 4 + 3 * 5
    for task in QUESTIONS:
        first = rows["10000", task, LABEL_COLUMNS[0]]
        assert (first.TP + first.TN, first.FP + first.FN, first.F1_macro) == (9, 0, 1.0)
        never = rows["10000", task, LABEL_COLUMNS[1]]
        assert (never.TP, never.FP, never.Sensitivity, never.Specificity) == (0, 0, 0.0, 1.0)
        person = rows["200", task, "human"]
        assert (person.FP, person.FN) == (0, 0)
        labelled = 6
        assert person.TP + person.TN + person.n_excluded == labelled and person.n_excluded >= 1


def test_unbalanced_and_sensitivity_reports(spark, sets, scored):
    def yes_no(r):
        return "Y" if r.outcome else "N"

    report = {(r.Task, r.Prompt): r for r in unbalanced_report(scored, human(spark, sets, "unbalanced", yes_no)).collect()}
    assert len(report) == 15
    assert {t for t, _ in report} == set(QUESTIONS)
    assert all(report[t, "human"].F1_micro == 1.0 for t in QUESTIONS)
    other = {(r.Task, r.Prompt): r for r in sensitivity_report(scored, human(spark, sets, "reversed", code)).collect()}
    assert len(other) == 15
    assert all(other[t, "human"].n_excluded == 1 for t in QUESTIONS)


def test_word_counts(scored):
    rows = {(r.task, r.prompt): r for r in word_counts(scored.filter("sample = 'balanced'")).collect()}
    assert len(rows) == 12
    assert rows["admitted", "response_content_history_examination1"].mean_word_count == 2.0
    assert rows["admitted", "response_content_history_examination1"].std_word_count == 0.0


def test_samples_have_the_same_cases(sets):
    def keys(task, sample):
        return sets.filter((F.col("task") == task) & (F.col("sample") == sample))

    pairs = same_keys({t: keys(t, "unbalanced") for t in QUESTIONS}, "encounter_id", "position")
    assert [r.same for r in pairs.collect()] == [True] * 3


def test_site_label(spark):
    df = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, None), (4, "s9")], "i int, care_site_id string")
    sites = spark.createDataFrame([("s1", "l1"), ("s2", "l9"), (None, "l2")], "care_site_id string, location_id string")
    locations = spark.createDataFrame([("l1", "north"), ("l2", "south"), ("l3", "east")], "location_id string, location_source_value string")
    got = sorted((r.i, r.location_source_value) for r in add_site_label(df, sites, locations).collect())
    assert got == [(1, "north"), (2, None), (3, None), (4, None)]


def test_one_whole_response_of_several(spark):
    def answer(text):
        return json.dumps({"choices": [{"message": {"content": text}}]})

    keys = [("t", "s", f"e{i}", v) for i in range(2) for v in (1, 2, 3, 4)]
    requests = spark.createDataFrame(keys, "task string, sample string, encounter_id string, variant int")
    given = [(*k, answer("0: no")) for k in keys]
    given += [("t", "s", "e0", 1, answer("answer 1")), ("t", "s", "e1", 2, "broken"), ("t", "s", "e1", 2, answer("perhaps"))]
    given = [g for g in given if g != ("t", "s", "e1", 2, answer("0: no"))] + [("t", "s", "e1", 2, answer("1: yes"))]
    responses = spark.createDataFrame(given, "task string, sample string, encounter_id string, variant int, response_json string")
    sets = spark.createDataFrame([("t", "s", "e0"), ("t", "s", "e1")], "task string, sample string, encounter_id string")
    got = {r.encounter_id: r for r in ingest_responses(sets, requests, responses).collect()}
    name = "_history_examination"
    assert (got["e0"][f"response_content{name}1"], got["e0"][f"label{name}1"]) == ("0: no", "0")
    assert (got["e1"][f"response_content{name}2"], got["e1"][f"label{name}2"]) == ("1: yes", "1")


def test_responses_are_not_broadcast(spark):
    """However few Spark takes them for: a generator may make many rows of a small table."""
    samples = F.explode(F.array(F.lit("s"), F.lit("s2"))).alias("sample")
    key, variant = F.lit("e").alias("encounter_id"), (F.col("id") + 1).cast("int").alias("variant")
    body = F.lit(json.dumps({"choices": [{"message": {"content": "0"}}]})).alias("response_json")
    responses = spark.range(4).select(F.lit("t").alias("task"), samples, key, variant, body)
    requests = spark.range(4).select(F.lit("t").alias("task"), F.lit("s").alias("sample"), key, variant)
    attached = attach_responses(requests, responses)
    assert "Broadcast" not in plan_of(attached) and attached.count() == 4
    # Few requests go to the responses, which are not moved.
    sets = spark.createDataFrame([("t", "s", "e")], "task string, sample string, encounter_id string")
    wide = ingest_responses(sets, requests, responses)
    plan = plan_of(wide)
    at = plan.index("Generate explode")
    joined = plan.rindex("BroadcastHashJoin", 0, at)
    assert "BuildLeft" in plan[joined:at] and "SortMergeJoin" not in plan[joined:at]
    assert [r["label_history_examination4"] for r in wide.collect()] == ["0"]


def test_human_labels_are_not_broadcast(spark):
    tasks = F.explode(F.array(F.lit("t"), F.lit("t2"))).alias("task")
    human = spark.range(3).select(tasks, F.col("id").cast("string").alias("encounter_id"), F.lit(1).alias("human"))
    scored = spark.createDataFrame([("t", "1"), ("t", "9"), ("t", None)], "task string, encounter_id string")
    labelled = attach_human_left(scored, human)
    assert "Broadcast" not in plan_of(labelled)
    assert {(r.encounter_id, r.human) for r in labelled.collect()} == {("1", 1), ("9", None), (None, None)}
