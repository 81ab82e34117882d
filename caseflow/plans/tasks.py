"""Task sets: balanced, unbalanced, labelling and reversed, as one long table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.fixed_values import (
    BALANCED_PER_CLASS,
    LABELLING_ROWS,
    OUTCOMES,
    SEED,
    UNBALANCED_ROWS,
    YES_NO,
)
from caseflow.functions.text import build_prompt
from caseflow.functions.values import map_codes
from caseflow.operators.dedupe import first_by
from caseflow.operators.sampling import draw_per_group, seeded_hash
from caseflow.operators.skew import broadcast_if_small
from caseflow.plans.prompts import FORWARD, MAX_TEMPLATES, REVERSED
from caseflow.schemas import KEYS

BALANCED, UNBALANCED = "balanced", "unbalanced"
LABELLING, REVERSED_SAMPLE = "labelling", "reversed"
TEXTS = ("history_text", "examination_text", "history_examination_text_tokens")


@dataclass(frozen=True)
class SampleSpec:
    per_class: int = BALANCED_PER_CLASS
    unbalanced: int = UNBALANCED_ROWS
    labelling: int = LABELLING_ROWS
    seed: int = SEED
    outcomes: Mapping[str, str] = field(default_factory=lambda: dict(OUTCOMES))


def outcome_value(df: DataFrame, column: str) -> Column:
    """Outcome as 0/1, from Y/N text or from numbers."""
    if dict(df.dtypes)[column] == "string":
        return map_codes(column, {**YES_NO, "1": 1, "0": 0})
    return F.col(column).cast("int")


def task_sets(prepared: DataFrame, spec: SampleSpec = SampleSpec()) -> DataFrame:
    """All sets: task, sample, prompt_order, position, keys, outcome, texts.

    Per task, `balanced` has `per_class` rows of either outcome and `unbalanced` the
    same draw from all rows for every task. `labelling` is the shuffled start of the
    balanced draw, `reversed` the same rows for the reversed prompts.

    Every row belongs to the draws of its outcomes, and all draws are made together:
    `prepared` is read twice, not once per set, first without its texts.
    """
    sizes = {"all": spec.unbalanced}
    uses = [("all", task, UNBALANCED, FORWARD) for task in spec.outcomes]
    for task in spec.outcomes:
        for value in (1, 0):
            sizes[f"{task} {value}"] = spec.per_class
            sizes[f"first {task} {value}"] = spec.labelling // 2
            uses += [
                (f"{task} {value}", task, BALANCED, FORWARD),
                (f"first {task} {value}", task, LABELLING, FORWARD),
                (f"first {task} {value}", task, REVERSED_SAMPLE, REVERSED),
            ]

    outcomes = {t: outcome_value(prepared, c) for t, c in spec.outcomes.items()}
    rows = prepared.select(*KEYS, *TEXTS, *[y.alias(f"_{t}") for t, y in outcomes.items()])
    draws = [F.lit("all")]
    for task in spec.outcomes:
        # NULL, and dropped, where the outcome is missing.
        draws += [F.concat(F.lit(f"{kind}{task} "), F.col(f"_{task}")) for kind in ("", "first ")]
    members = rows.withColumn("draw", F.explode(F.array_compact(F.array(*draws))))
    drawn = draw_per_group(members, "draw", sizes, spec.seed, "encounter_id")

    # A table of literals, one row per use of a draw.
    used = prepared.sparkSession.createDataFrame(
        uses, "draw string, task string, sample string, prompt_order string"
    )
    outcome = F.coalesce(*[F.when(F.col("task") == t, F.col(f"_{t}")) for t in spec.outcomes])
    placed = drawn.join(F.broadcast(used), "draw").withColumn("outcome", outcome)
    return placed.withColumn("position", _position(spec.seed)).select(
        "task", "sample", "prompt_order", "position", *KEYS, "outcome", *TEXTS
    )


def _position(seed: int) -> Column:
    """Place of a row in its set. Labelling sets are shuffled anew, so that the
    outcome cannot be read off the order; balanced sets list the positive class first.
    """
    shuffled = F.col("sample").isin(LABELLING, REVERSED_SAMPLE)
    place = Window.partitionBy("task", "sample").orderBy(
        F.when(F.col("sample") == BALANCED, -F.col("outcome")).otherwise(0),
        F.when(shuffled, seeded_hash(seed + 1, "encounter_id")).otherwise(
            seeded_hash(seed, "encounter_id")
        ),
        "encounter_id",
    )
    return F.row_number().over(place)


def scoring_requests(sets: DataFrame, templates: DataFrame) -> DataFrame:
    """Row per set, encounter and prompt variant, with the prompt to be sent.

    An encounter listed twice in a set keeps its last row.
    """
    last = first_by(sets, ["task", "sample", "encounter_id"], [F.col("position").desc()])
    few = broadcast_if_small(templates, MAX_TEMPLATES)
    return last.join(few, ["task", "prompt_order"]).select(
        "task",
        "sample",
        "encounter_id",
        "variant",
        build_prompt("template", "history_text", "examination_text").alias("prompt"),
    )
