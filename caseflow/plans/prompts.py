"""Prompt templates as data, and prompt columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.fixed_values import PROMPT_COLUMNS, VARIANTS
from caseflow.functions.text import build_prompt
from caseflow.operators.skew import broadcast_if_small

FORWARD, REVERSED = "forward", "reversed"
MAX_TEMPLATES = 1_000  # rows to broadcast; there are 24

ROLE = "Act as the physician of an emergency department who reads the note below."
STEPS = "Reason step by step."
BARE = "Answer with that choice alone and give no reasons."

# Per task: the question, the restraint, and the answers for 0 and 1.
QUESTIONS = {
    "admitted": (
        "Decide if this patient has to be admitted to the hospital.",
        "Choose admission only where it cannot be avoided.",
        "0: no hospital admission",
        "1: hospital admission",
    ),
    "imaging_orders_binary": (
        "Decide if this patient needs imaging such as X-ray, ultrasound, CT or MRI.",
        "Choose imaging only where it cannot be avoided.",
        "0: no imaging",
        "1: imaging",
    ),
    "abx_ordered_ed": (
        "Decide if this patient needs antibiotics.",
        "Choose antibiotics only where they cannot be avoided.",
        "0: no antibiotics",
        "1: antibiotics",
    ),
}


def template_rows() -> list[tuple[str, str, int, str]]:
    """(task, prompt_order, variant, template) for every task, order and variant.

    Variant 1 asks; 2 adds the restraint; 3 allows reasons; 4 asks for steps first.
    """
    rows = []
    for task, (question, restraint, zero, one) in QUESTIONS.items():
        for order, pair in ((FORWARD, (zero, one)), (REVERSED, (one, zero))):
            answers = f"Choose one of two answers: '{pair[0]}' '{pair[1]}'."
            texts = (
                [ROLE, question, answers, BARE],
                [ROLE, question, restraint, answers, BARE],
                [ROLE, question, restraint, answers],
                [ROLE, question, STEPS, restraint, answers],
            )
            rows += [(task, order, v, " ".join(t)) for v, t in zip(VARIANTS, texts)]
    return rows


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        template_rows(), "task string, prompt_order string, variant int, template string"
    )


def build_prompts(task_sets: DataFrame, templates: DataFrame) -> DataFrame:
    """One prompt column per variant.

    The templates of a task and order become one row.
    """
    wide = (
        templates.groupBy("task", "prompt_order")
        .pivot("variant", list(VARIANTS))
        .agg(F.first("template"))
    )
    prompts = {
        name: build_prompt(F.col(str(v)), "history_text", "examination_text")
        for v, name in zip(VARIANTS, PROMPT_COLUMNS)
    }
    joined = task_sets.join(broadcast_if_small(wide, MAX_TEMPLATES), ["task", "prompt_order"])
    return joined.withColumns(prompts).drop(*[str(v) for v in VARIANTS])
