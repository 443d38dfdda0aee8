"""Predictions against ground truth, for any number of models in one job.

Everything is derived from one count per (model, true, predicted); the tables after
that have at most models x classes x classes rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from snapweave.functions.labels import predicted_label, true_label
from snapweave.operators.tables import attach, keep_values
from snapweave.schema import DEFAULT_TEST_USERS, KEYS, LABEL_NAMES

MODEL = ["model"]


def matched(
    truth: DataFrame,
    predictions: DataFrame,
    test_users: Sequence[str] | None = DEFAULT_TEST_USERS,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Truth joined with predictions, with canonical ``y_true`` and ``y_pred`` (empty = unmapped)."""
    truth = keep_values(truth, "user_id", test_users)
    predictions = keep_values(predictions, "user_id", test_users)
    joined = attach(truth, predictions, keys, "inner", suffixes=("_true", "_pred"))
    return joined.withColumns(
        {"y_true": true_label(F.col("label_true")), "y_pred": predicted_label(F.col("label_pred"))}
    )


def mapped(joined: DataFrame) -> DataFrame:
    return joined.filter("y_true <> '' AND y_pred <> ''")


def match_counts(joined: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows_matched"),
        F.count_if((F.col("y_true") != "") & (F.col("y_pred") != "")).alias("rows_mapped"),
    )


def unmapped_labels(joined: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Label texts that no rule maps, per side, with counts; missing texts are not counted."""

    def side(name: str) -> DataFrame:
        bad = joined.filter((F.col(f"y_{name}") == "") & F.col(f"label_{name}").isNotNull())
        counts = bad.groupBy(*by, F.col(f"label_{name}").alias("label")).agg(F.count(F.lit(1)).alias("n"))
        return counts.select(F.lit(name).alias("side"), *by, "label", "n")

    return side("true").unionByName(side("pred"))


def pair_counts(rows: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    return rows.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def class_scores(
    pairs: DataFrame, by: Sequence[str] = MODEL, labels: Sequence[str] | None = tuple(LABEL_NAMES)
) -> DataFrame:
    """Precision, recall, F1 and support per class.

    ``labels`` fixes the class list, absent classes scoring 0; None uses the classes that
    occur as true or predicted.
    """
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    sides = [
        F.struct(F.col("y_true").alias("label"), hit.alias("tp"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")),
    ]
    long = pairs.select(*by, F.explode(F.array(*sides)).alias("s")).select(*by, "s.*")
    if labels is not None:
        zero = F.lit(0).cast("long")
        listed = F.explode(F.array(*[F.lit(name) for name in labels])).alias("label")
        groups = pairs.select(*by).distinct() if by else pairs.agg(F.lit(1).alias("_one"))
        blank = groups.select(*by, listed).select(
            *by, "label", zero.alias("tp"), zero.alias("t"), zero.alias("p")
        )
        long = long.filter(F.col("label").isin(list(labels))).unionByName(blank)
    sums = long.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "t", "p")])

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom == 0, F.lit(0.0)).otherwise(top / F.nullif(bottom, F.lit(0)))

    tp, t, p = F.col("tp"), F.col("t"), F.col("p")
    return sums.select(
        *by,
        "label",
        ratio(tp, p).alias("precision"),
        ratio(tp, t).alias("recall"),
        ratio(2 * tp, t + p).alias("f1"),
        t.alias("support"),
    )


def accuracy(pairs: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    return pairs.groupBy(*by).agg(
        (F.sum(hit) / F.sum("n")).alias("accuracy"), F.sum("n").alias("support")
    )


def macro_scores(scores: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    return scores.groupBy(*by).agg(
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")]
    )


def weighted_scores(scores: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    total = F.sum("support")
    return scores.groupBy(*by).agg(
        *[
            F.try_divide(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}")
            for m in ("precision", "recall", "f1")
        ]
    )


def class_report(
    pairs: DataFrame, by: Sequence[str] = MODEL, labels: Sequence[str] | None = tuple(LABEL_NAMES)
) -> DataFrame:
    """Rows per class plus ``accuracy``, ``macro avg`` and ``weighted avg``."""
    scores = class_scores(pairs, by, labels)
    total = F.sum("support")
    metrics = ("precision", "recall", "f1")
    macro = scores.groupBy(*by).agg(
        F.lit("macro avg").alias("label"), *[F.avg(m).alias(m) for m in metrics], total.alias("support")
    )
    weighted = scores.groupBy(*by).agg(
        F.lit("weighted avg").alias("label"),
        *[F.try_divide(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in metrics],
        total.alias("support"),
    )
    overall = accuracy(pairs, by).select(
        *by,
        F.lit("accuracy").alias("label"),
        F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"),
        F.col("accuracy").alias("f1"),
        "support",
    )
    return scores.unionByName(overall).unionByName(macro).unionByName(weighted)


def confusion_long(
    pairs: DataFrame, by: Sequence[str] = MODEL, labels: Sequence[str] = tuple(LABEL_NAMES)
) -> DataFrame:
    """Every (true, predicted) cell of the fixed label grid, zeros included."""
    listed = [F.lit(name) for name in labels]
    groups = pairs.select(*by).distinct() if by else pairs.agg(F.lit(1).alias("_one"))
    grid = groups.select(*by, F.explode(F.array(*listed)).alias("y_true"))
    grid = grid.select(*by, "y_true", F.explode(F.array(*listed)).alias("y_pred"))
    cells = grid.join(pairs, [*by, "y_true", "y_pred"], "left")
    return cells.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def confusion_matrix(
    pairs: DataFrame, by: Sequence[str] = MODEL, labels: Sequence[str] = tuple(LABEL_NAMES)
) -> DataFrame:
    """One row per true label, one column per predicted label."""
    return confusion_long(pairs, by, labels).groupBy(*by, "y_true").agg(
        *[F.sum(F.when(F.col("y_pred") == name, F.col("n")).otherwise(F.lit(0))).alias(name) for name in labels]
    )


def coverage(
    truth: DataFrame, predictions: DataFrame, by: Sequence[str] = MODEL, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Rows of one side without partner, per model: real anti-join counts and row differences.

    The differences repeat the usual report; they are off where keys repeat.
    """
    by, keys = list(by), list(keys)
    per_pred = predictions.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("_p"))
    per_true = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"))
    both = per_pred.join(per_true, keys, "left").groupBy(*by).agg(
        F.sum("_p").alias("rows_pred"),
        F.coalesce(F.sum(F.when(F.col("_t").isNull(), F.col("_p"))), F.lit(0)).alias("pred_only"),
        F.coalesce(F.sum("_t"), F.lit(0)).alias("_true_met"),
        F.coalesce(F.sum(F.col("_p") * F.col("_t")), F.lit(0)).alias("rows_matched"),
    )
    total = truth.agg(F.count(F.lit(1))).scalar()
    return both.withColumn("rows_true", total).select(
        *by,
        "rows_true",
        "rows_pred",
        "rows_matched",
        (F.col("rows_true") - F.col("_true_met")).alias("true_only"),
        "pred_only",
        (F.col("rows_true") - F.col("rows_matched")).alias("true_difference"),
        (F.col("rows_pred") - F.col("rows_matched")).alias("pred_difference"),
    )


def evaluate(
    truth: DataFrame,
    predictions: DataFrame,
    test_users: Sequence[str] | None = DEFAULT_TEST_USERS,
    by: Sequence[str] = MODEL,
    labels: Sequence[str] | None = tuple(LABEL_NAMES),
) -> DataFrame:
    """One row per model: matched and mapped rows, accuracy, macro and weighted scores."""
    by = list(by)
    joined = matched(truth, predictions, test_users)
    all_pairs = pair_counts(joined, by)
    pairs = mapped(all_pairs)
    rows = all_pairs.groupBy(*by).agg(
        F.sum("n").alias("rows_matched"),
        F.coalesce(F.sum(F.when((F.col("y_true") != "") & (F.col("y_pred") != ""), F.col("n"))), F.lit(0)).alias(
            "rows_mapped"
        ),
    )
    scores = class_scores(pairs, by, labels)
    return (
        rows.join(accuracy(pairs, by).drop("support"), by, "left")
        .join(macro_scores(scores, by), by, "left")
        .join(weighted_scores(scores, by), by, "left")
    )


def rank_models(summary: DataFrame, score: str = "accuracy", name: str = "model") -> DataFrame:
    """Best first. One row per model, so the unpartitioned rank is over a handful of rows."""
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(name).alias("name")))
    )
    ranked = summary.agg(ordered.alias("r")).select(F.posexplode("r").alias("i", "r"))
    return ranked.select(
        (F.col("i") + 1).alias("rank"), F.col("r.name").alias(name), (-F.col("r.s")).alias(score)
    )


def best_model(summary: DataFrame, score: str = "accuracy", name: str = "model") -> DataFrame:
    return summary.agg(F.max_by(name, F.struct(score, name)).alias(name), F.max(score).alias(score))
