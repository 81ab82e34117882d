from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from caseflow.llm import exact_dedup
from tests.conftest import plan_of


def by_hand(rows):
    """(doc_id, keep_id, group_size, sha) -> (rows, kept rows)."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        text = text or ""
        bare = "".join(c for c in text if c not in " \t\n\x0b\x0c\r")
        groups[bare].append((-len(text), doc_id is None, doc_id or 0, doc_id))
    seen, kept = Counter(), Counter()
    for bare, members in groups.items():
        sha = hashlib.sha256(bare.encode()).hexdigest()
        best = min(members, key=lambda m: m[:3])
        for m in members:
            seen[(m[3], best[3], len(members), sha)] += 1
        kept[(best[3], best[3], len(members), sha)] += 1
    return seen, kept


ROWS = [
    (5, "a b c"), (3, "abc"), (9, "a  b  c"), (7, "a\tb\n\nc"),  # the longest, then the smallest id
    (1, None), (2, ""), (4, " \n "), (None, "   "), (None, "abc"),
    (11, "unlike"), (12, "Unlike"), (13, "un like"), (14, "un like\x0b\x0c\r"),
    (20, "same"), (20, "same"), (20, "same"), (21, "sa me"), (21, "sa me"),
    (30, "é" * 70_000), (31, "é " * 70_000),
    *[(100 + i, "hot text") for i in range(300)],
    *[(500 + i, f"text {i % 40}") for i in range(120)],
]


@pytest.mark.parametrize(("parts", "fan"), [(1, 16), (7, 2), (23, 3), (23, 16)])
def test_groups_are_those_of_brute_force(spark, documents, parts, fan):
    groups = exact_dedup.duplicate_groups(documents(ROWS).repartition(parts), fan)
    rows = groups.select("doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()
    seen, kept = by_hand(ROWS)
    assert Counter(tuple(r)[:4] for r in rows) == seen
    assert Counter(tuple(r)[:4] for r in rows if r.kept) == kept


def test_rows_that_stay_keep_their_columns(spark, documents):
    docs = documents(ROWS)
    left = exact_dedup.drop_duplicates(docs, 3)
    assert left.columns == docs.columns
    _, kept = by_hand(ROWS)
    assert Counter(r.doc_id for r in left.collect()) == Counter(k[0] for k in kept)


def test_empty_table_and_single_round(spark, documents):
    assert exact_dedup.duplicate_groups(documents([])).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.duplicate_groups(documents([]), fan=1)


def test_rounds_leave_one_group_and_as_many_partitions():
    for runs in (1, 2, 16, 17, 211, 5000):
        plan = exact_dedup.rounds(runs, 16)
        assert all(joined <= 16 for joined, _, _ in plan)
        assert not plan or (plan[-1][1] == 1 and plan[-1][2] < 4 * runs)


def test_no_task_of_a_round_gets_more_than_a_record_per_group_of_a_hot_text(spark, documents):
    docs = documents([(i, "hot") for i in range(4000)]).repartition(32)
    runs = exact_dedup.first_runs(exact_dedup.digested(docs))
    assert runs.count() == 32  # one record of the text for each partition
    once = exact_dedup.merge(runs, 16, 2, 16)
    assert once.count() == 2
    plan = plan_of(once)
    assert plan.count("shufflepartitionidpassthrough") == 1 and plan.count("Exchange") == 3  # the input, the first runs, the round
    assert exact_dedup.merge(once, 2, 1, 32).agg(F.sum("n")).first()[0] == 4000
