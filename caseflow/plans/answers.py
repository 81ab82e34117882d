"""Model responses: attach, read, label, and widen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.fixed_values import NO_RESPONSE, SUFFIX, VARIANTS
from caseflow.functions.responses import parse_label, response_content
from caseflow.operators.skew import broadcast_if_small
from caseflow.sources import stage_table

REQUEST = ["task", "sample", "encounter_id", "variant"]
#: Requests whose keys are broadcast at most; more of them meet the responses in a shuffle.
MAX_REQUESTS = 100_000


def attach_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their response; requests without one are left out.

    Matched on set, encounter and variant, never on the prompt text.
    """
    answered = responses.filter(F.col("response_json").isNotNull()).select(*REQUEST, "response_json")
    # Not left to Spark's size check: its estimate does not see the rows that a generator
    # adds, so that responses of any number could be broadcast.
    return requests.join(answered.hint("merge"), REQUEST)


def label_responses(attached: DataFrame) -> DataFrame:
    """Add the answer text and its label."""
    return attached.withColumn("response_content", response_content("response_json")).withColumn(
        "label", parse_label("response_content")
    )


def ingest_responses(sets: DataFrame, requests: DataFrame, responses: DataFrame) -> DataFrame:
    """The task sets with `response_content…` and `label…` for the four variants.

    Encounters that lack a response to any variant are left out. Of several responses to
    one request one is taken whole: one with a label of 0 or 1 before one without, one with
    an answer before a failed one, and then the first by its text. Prompts are not carried
    through the shuffles: only answers and keys are. The keys of the requests are written
    once and counted; if they are few, they go to the responses, which stay where they are.
    """
    asked = broadcast_if_small(stage_table(requests.select(*REQUEST)), MAX_REQUESTS)
    labelled = label_responses(attach_responses(asked, responses))
    whole = F.struct(
        (~F.col("label").isin("0", "1")).alias("unread"),
        (F.col("response_content") == NO_RESPONSE).alias("failed"),
        "response_content",
        "label",
    )
    chosen = [F.min(F.when(F.col("variant") == v, whole)).alias(f"_{v}") for v in VARIANTS]
    picked = labelled.groupBy("task", "sample", "encounter_id").agg(*chosen)
    values = [
        F.col(f"_{v}.{c}").alias(f"{c}{SUFFIX}{v}")
        for c in ("response_content", "label")
        for v in VARIANTS
    ]
    wide = picked.select("task", "sample", "encounter_id", *values)
    complete = wide.dropna(subset=[f"label{SUFFIX}{v}" for v in VARIANTS])
    return sets.join(complete, ["task", "sample", "encounter_id"])
