"""Summary reports of model and human labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.fixed_values import CONTENT_COLUMNS, LABEL_COLUMNS, MODALITY, YES_NO
from caseflow.functions.values import map_codes, replace_codes
from caseflow.operators.frame import stack_tagged
from caseflow.operators.metrics import evaluate, word_count_stats
from caseflow.plans.tasks import BALANCED, REVERSED_SAMPLE, UNBALANCED, SampleSpec

HUMAN = "human"
MAIN_KEYS = ("task", "patient_id", "ed_visit_id", "encounter_id")
SHORT_KEYS = ("task", "encounter_id")
# Codes of the human labels: yes/no for two tasks, the modality for imaging.
HUMAN_CODES = {"admitted": YES_NO, "imaging_orders_binary": MODALITY, "abx_ordered_ed": YES_NO}


def human_label(code: str = "human_code", codes: Mapping[str, Mapping] = HUMAN_CODES):
    """0/1 of a human code by the code list of its task; other codes are NULL."""
    by_task = [F.when(F.col("task") == t, map_codes(code, m)) for t, m in codes.items()]
    return F.coalesce(*by_task).alias(HUMAN)


def attach_human_right(
    scored: DataFrame, human: DataFrame, keys: Sequence[str] = MAIN_KEYS
) -> DataFrame:
    """Scored rows of the labelled cases; a labelled case without one stays, empty."""
    return scored.join(human.select(*keys, HUMAN), list(keys), "right")


def attach_human_left(
    scored: DataFrame, human: DataFrame, keys: Sequence[str] = SHORT_KEYS
) -> DataFrame:
    """Human label on every scored row, NULL where nobody labelled it.

    Labels are never broadcast by Spark's size check, whose estimate does not see the rows
    that a generator adds.
    """
    return scored.join(human.select(*keys, HUMAN).hint("merge"), list(keys), "left")


def word_counts(scored: DataFrame) -> DataFrame:
    """Word count statistics of the answers: task, prompt, mean, deviation."""
    long = scored.select(
        "task",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("prompt"), F.col(c).alias("text"))
                    for c in CONTENT_COLUMNS
                ]
            )
        ),
    )
    return word_count_stats(long, "text")


def main_report(scored: DataFrame, human: DataFrame, spec: SampleSpec = SampleSpec()) -> DataFrame:
    """Model on the whole balanced set, then human and model on its labelled part, both named
    by the sizes of `spec`.

    `human` has the three case keys, the task and `human_code`.
    """
    balanced = scored.filter(F.col("sample") == BALANCED)
    labelled = attach_human_right(balanced, human.withColumn(HUMAN, human_label()))
    return stack_tagged(
        {
            str(2 * spec.per_class): evaluate(balanced, "outcome", LABEL_COLUMNS, "task"),
            str(spec.labelling): evaluate(labelled, "outcome", [HUMAN, *LABEL_COLUMNS], "task"),
        },
        "Sample",
    )


def unbalanced_report(scored: DataFrame, human: DataFrame) -> DataFrame:
    """Human and model on the unbalanced set; `human_code` is Y or N for all tasks."""
    rows = scored.filter(F.col("sample") == UNBALANCED)
    coded = human.withColumn(HUMAN, replace_codes("human_code", YES_NO))
    return evaluate(attach_human_left(rows, coded), "outcome", [HUMAN, *LABEL_COLUMNS], "task")


def sensitivity_report(scored: DataFrame, human: DataFrame) -> DataFrame:
    """Human and model on the labelled cases with the answers in reversed order."""
    rows = scored.filter(F.col("sample") == REVERSED_SAMPLE)
    coded = human.withColumn(HUMAN, human_label())
    return evaluate(attach_human_left(rows, coded), "outcome", [HUMAN, *LABEL_COLUMNS], "task")
