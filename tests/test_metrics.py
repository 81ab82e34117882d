"""Label metrics against a direct computation per label vector."""

from __future__ import annotations

import random

import pytest

from caseflow.operators.metrics import confusion, evaluate, word_count_stats


def f1(pairs, positive):
    tp = sum(a == p == positive for a, p in pairs)
    predicted = sum(p == positive for _, p in pairs)
    actual = sum(a == positive for a, _ in pairs)
    precision = tp / predicted if predicted else 0.0
    recall = tp / actual if actual else 0.0
    return 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def direct(pairs):
    n = len(pairs)
    present = {v for pair in pairs for v in pair}
    actual = {v: sum(a == v for a, _ in pairs) for v in (0, 1)}
    right = {v: sum(a == p == v for a, p in pairs) for v in (0, 1)}
    return (
        right[1] / actual[1] if actual[1] else None,
        right[0] / actual[0] if actual[0] else None,
        f1(pairs, 1),
        sum(right.values()) / n if n else 0.0,
        sum(f1(pairs, v) for v in present) / len(present) if present else 0.0,
        sum(f1(pairs, v) * actual[v] for v in (0, 1)) / n if n else 0.0,
    )


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(9)
    out = {}
    for i in range(60):
        p, q = rng.choice([0, 0.1, 0.5, 1]), rng.choice([0, 0.3, 0.9, 1])
        pairs = [(int(rng.random() < p), int(rng.random() < q)) for _ in range(rng.randint(1, 25))]
        out[f"t{i}"] = pairs
    return out


def test_metrics(spark, vectors):
    rows = [(t, a, str(p), rng) for t, pairs in vectors.items() for rng, (a, p) in enumerate(pairs)]
    noise = [("t0", 1, "error", -1), ("t0", 0, "neither", -1), ("t0", None, "1", -1), ("t1", 1, None, -1)]
    df = spark.createDataFrame(rows + noise, "task string, y int, label string, i int")
    out = {r.Task: r for r in evaluate(df, "y", ["label"], "task").collect()}
    assert set(out) == set(vectors)
    for task, pairs in vectors.items():
        r = out[task]
        cells = [sum((a, p) == c for a, p in pairs) for c in ((1, 1), (0, 1), (0, 0), (1, 0))]
        assert [r.TP, r.FP, r.TN, r.FN] == cells
        got = (r.Sensitivity, r.Specificity, r.F1_binary, r.F1_micro, r.F1_macro, r.F1_weighted)
        assert got == pytest.approx(direct(pairs), nan_ok=True), task
    assert (out["t0"].n_excluded, out["t1"].n_excluded, out["t2"].n_excluded) == (3, 1, 0)


def test_label_columns_side_by_side(spark):
    df = spark.createDataFrame([(1, 1, "0"), (0, 1, "0"), (1, 0, "1")], "y int, human int, model string")
    out = evaluate(df, "y", ["human", "model"])
    assert out.columns == [
        "Task", "Prompt", "TP", "FP", "TN", "FN", "Sensitivity", "Specificity",
        "F1_binary", "F1_micro", "F1_macro", "F1_weighted", "n_excluded"]
    got = {r.Prompt: (r.Task, r.TP, r.FP, r.TN, r.FN) for r in out.collect()}
    assert got == {"human": ("y", 1, 1, 0, 1), "model": ("y", 1, 0, 1, 1)}


def test_class_never_predicted(spark):
    df = spark.createDataFrame([(1, "0"), (0, "0")], "y int, p string")
    r = evaluate(df, "y", ["p"]).first()
    assert (r.TP, r.FP, r.TN, r.FN) == (0, 0, 1, 1)
    assert (r.Sensitivity, r.Specificity, r.F1_binary) == (0.0, 1.0, 0.0)


def test_nothing_to_evaluate(spark):
    df = spark.createDataFrame([(1, "error"), (None, "1")], "y int, p string")
    r = evaluate(df, "y", ["p"]).first()
    assert (r.Sensitivity, r.Specificity, r.F1_micro, r.F1_macro, r.n_excluded) == (None, None, 0.0, 0.0, 2)


def test_confusion_of_whole_frame(spark):
    df = spark.createDataFrame([(1.0, "1"), (0.0, "1")], "y double, p string")
    assert confusion(df, "y", "p").first().asDict() == {"TP": 1, "FP": 1, "TN": 0, "FN": 0, "n_excluded": 0}


def test_word_counts(spark):
    df = spark.createDataFrame(
        [("a", "p", "one two three"), ("a", "p", "one"), ("a", "p", None), ("b", "p", "x y")],
        "task string, prompt string, t string",
    )
    got = {r.task: (r.mean_word_count, r.std_word_count) for r in word_count_stats(df, "t").collect()}
    assert got == {"a": (1.7, 1.2), "b": (2.0, None)}
    half = spark.createDataFrame([("a", "p", "w " * n) for n in (1,) * 3 + (2,)], "task string, prompt string, t string")
    assert word_count_stats(half, "t").first().mean_word_count == 1.2  # 1.25, half to even
