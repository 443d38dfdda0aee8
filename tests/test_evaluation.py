"""Evaluation against four published confusion matrices and their printed scores."""

import pytest
from pyspark.sql import functions as F

from snapweave.functions.labels import predicted_label, true_label
from snapweave.operators import evaluation as ev
from snapweave.schema import HUMAN_NAMES, LABEL_NAMES

# Confusion matrices (rows true, columns predicted, in label order) and the
# printed accuracy, weighted P/R/F1 and macro P/R/F1.
MATRICES = {
    "one": (
        [
            [12, 1, 1, 0, 0, 0, 0],
            [0, 2, 0, 0, 0, 0, 0],
            [0, 0, 7, 4, 0, 0, 0],
            [0, 0, 2, 2, 0, 0, 0],
            [0, 0, 0, 0, 1, 0, 0],
            [1, 0, 0, 0, 0, 0, 0],
            [1, 0, 0, 0, 0, 0, 0],
        ],
        [0.7059, 0.6873, 0.7059, 0.6922, 0.5082, 0.5705, 0.5320],
    ),
    "two": (
        [
            [12, 1, 1, 0, 0, 0, 0],
            [0, 2, 0, 0, 0, 0, 0],
            [0, 0, 8, 3, 1, 0, 0],
            [0, 0, 2, 2, 0, 0, 0],
            [0, 0, 0, 0, 1, 0, 0],
            [1, 0, 1, 0, 0, 0, 0],
            [1, 0, 0, 0, 0, 0, 0],
        ],
        [0.6944, 0.6509, 0.6944, 0.6679, 0.4415, 0.5748, 0.4907],
    ),
    "three": (
        [
            [11, 2, 1, 0, 0, 0, 0],
            [0, 2, 0, 0, 0, 0, 0],
            [0, 0, 5, 3, 1, 1, 2],
            [0, 0, 1, 3, 0, 0, 0],
            [0, 0, 0, 0, 1, 0, 0],
            [1, 0, 0, 0, 0, 1, 0],
            [0, 0, 0, 0, 0, 0, 0],
        ],
        [0.6571, 0.7401, 0.6571, 0.6732, 0.5187, 0.6361, 0.5437],
    ),
    "four": (
        [
            [12, 0, 1, 0, 0, 1, 0],
            [0, 2, 0, 0, 0, 0, 0],
            [0, 0, 8, 2, 2, 0, 0],
            [0, 0, 1, 3, 0, 0, 0],
            [0, 0, 0, 0, 1, 0, 0],
            [1, 0, 0, 0, 0, 1, 0],
            [1, 0, 0, 0, 0, 0, 0],
        ],
        [0.7500, 0.7593, 0.7500, 0.7471, 0.5844, 0.6820, 0.6073],
    ),
}


@pytest.fixture(scope="module")
def tables(spark):
    """Truth and predictions whose join gives the matrices, with loose spellings on both sides."""
    truth, predictions, exercise = [], [], 0
    for model, (matrix, _) in MATRICES.items():
        for i, row in enumerate(matrix):
            for j, n in enumerate(row):
                for _ in range(n):
                    exercise += 1
                    truth.append(("Student_10", exercise, f" {HUMAN_NAMES[i]} "))
                    predictions.append(("Student_10", exercise, model, [LABEL_NAMES, HUMAN_NAMES][exercise % 2][j]))
    predictions += [("Student_10", 1, "one", "other_or_uncertain"), ("Student_99", 1, "one", "strategy_shifter")]
    return (
        spark.createDataFrame(truth, "user_id string, exercise_id int, label string"),
        spark.createDataFrame(predictions, "user_id string, exercise_id int, model string, label string"),
    )


def test_published_scores(tables):
    names = ["accuracy"] + [f"{k}_{m}" for k in ("weighted", "macro") for m in ("precision", "recall", "f1")]
    got = {r["model"]: r for r in ev.evaluate(*tables).collect()}
    for model, (matrix, scores) in MATRICES.items():
        assert [round(got[model][n], 4) for n in names] == scores, model
        assert got[model]["rows_mapped"] == sum(map(sum, matrix))
    assert got["one"]["rows_matched"] == got["one"]["rows_mapped"] + 1


def test_published_matrices_and_reports(tables):
    pairs = ev.mapped(ev.pair_counts(ev.matched(*tables)))
    cells = {(r["model"], r["y_true"]): [r[n] for n in LABEL_NAMES] for r in ev.confusion_matrix(pairs).collect()}
    for model, (matrix, _) in MATRICES.items():
        assert [cells[model, n] for n in LABEL_NAMES] == matrix
    assert ev.confusion_long(pairs).count() == 4 * 49
    report = {(r["model"], r["label"]): r for r in ev.class_report(pairs).collect()}
    empty = report["three", "low_validation_completer"]
    assert (empty["precision"], empty["recall"], empty["f1"], empty["support"]) == (0.0, 0.0, 0.0, 0)
    assert round(report["three", "tinkerer_explorer"]["f1"], 4) == 0.5263
    assert report["four", "accuracy"]["f1"] == 0.75 and report["four", "macro avg"]["support"] == 36
    ranked = ev.rank_models(ev.evaluate(*tables)).orderBy("rank").collect()
    assert [r["model"] for r in ranked] == ["four", "one", "two", "three"]
    assert ev.best_model(ev.evaluate(*tables)).first()["model"] == "four"


def test_occurring_labels_change_the_macro_denominator(spark):
    pairs = spark.createDataFrame([("m", "a", "a", 3), ("m", "b", "a", 1)], "model string, y_true string, y_pred string, n long")
    f1 = ev.macro_scores(ev.class_scores(pairs, labels=None)).first()["macro_f1"]
    assert f1 == pytest.approx((6 / 7 + 0) / 2)
    fixed = ev.macro_scores(ev.class_scores(pairs, labels=["a", "b", "c"])).first()["macro_f1"]
    assert fixed == pytest.approx((6 / 7) / 3)


def test_unmapped_and_coverage(tables, spark):
    truth, predictions = tables
    unmapped = ev.unmapped_labels(ev.matched(truth, predictions)).collect()
    assert [(r["side"], r["model"], r["label"], r["n"]) for r in unmapped] == [("pred", "one", "other_or_uncertain", 1)]
    small = spark.createDataFrame([("u", 1, "x"), ("u", 2, "x")], "user_id string, exercise_id int, label string")
    twice = spark.createDataFrame([("u", 1, "m", "x"), ("u", 1, "m", "x"), ("u", 1, "m", "x"), ("u", 3, "m", "x")], "user_id string, exercise_id int, model string, label string")
    got = ev.coverage(small, twice).first()
    assert (got["true_only"], got["pred_only"], got["true_difference"], got["pred_difference"]) == (1, 1, -1, 1)


def test_label_spellings(spark):
    said = {
        "Tinkerer / Explorer": "tinkerer_explorer",
        "AIGuided Integrator": "ai_guided_integrator",
        "DEBUGGERCENTRIC-FIXER": "debugger_centric_fixer",
        "planthenburst implementer": "plan_then_burst_implementer",
        "__Strategy--Shifter__": "strategy_shifter",
        "low_validation_completer": "low_validation_completer",
        "unsure": "",
        None: "",
    }
    df = spark.createDataFrame([(k,) for k in said], "s string")
    assert [r[0] for r in df.select(predicted_label(F.col("s"))).collect()] == list(said.values())
    meant = {"Strategy Shifter": "strategy_shifter", " Strategy Shifter\t".strip("\t"): "strategy_shifter", "strategy shifter": "", None: ""}
    df = spark.createDataFrame([(k,) for k in meant], "s string")
    assert [r[0] for r in df.select(true_label(F.col("s"))).collect()] == list(meant.values())
