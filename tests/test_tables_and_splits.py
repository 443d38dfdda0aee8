"""Joins, filters, splits and preparation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapweave.operators import prep, splits
from snapweave.operators import tables as tab
from snapweave.plans import training

KEYS = ["user_id", "exercise_id"]


def test_join_checks_and_suffixes(spark):
    left = spark.createDataFrame([("a", 1, "l"), ("a", 1, "l2"), (None, 1, "n")], "user_id string, exercise_id int, label string")
    right = spark.createDataFrame([("a", 1, "r"), (None, 1, "x")], "user_id string, exercise_id int, label string")
    doubled = right.unionByName(right)
    joined = tab.attach(left, right, validate="m:1", suffixes=("_true", "_pred"))
    rows = {(r["label_true"], r["label_pred"]) for r in joined.collect()}
    assert rows == {("l", "r"), ("l2", "r"), ("n", None)}
    with pytest.raises(tab.DuplicateKeys):
        tab.attach(left, doubled, validate="m:1")
    with pytest.raises(tab.DuplicateKeys):
        tab.attach(left, right, validate="1:1")
    assert tab.attach(left, doubled, how="inner").count() == 4


def test_missing_values_are_null(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "v string")
    assert [r["v"] for r in tab.coerce_numbers(df, ["v", "absent"]).collect()] == [1.5, None, None, None]
    nan = spark.createDataFrame([(float("nan"),), (2.0,)], "v double")
    assert [r["v"] for r in tab.nan_to_null(nan).collect()] == [None, 2.0]
    times = spark.createDataFrame([("2024-01-02 03:04:05",), ("soon",)], "timestamp string")
    got = [r["timestamp"] for r in tab.coerce_timestamps(times).collect()]
    assert got[0].hour == 3 and got[1] is None
    keyed = spark.createDataFrame([("a", 1), (None, 1), ("a", None)], "user_id string, exercise_id int")
    assert tab.with_keys(keyed).count() == 1


def test_keep_first_and_last(spark):
    rows = [("a", 1, i) for i in range(2000)] + [("b", 1, 5)]
    df = spark.createDataFrame(rows, "user_id string, exercise_id int, v int").repartition(5)
    assert {(r["user_id"], r["v"]) for r in tab.keep_first(df, KEYS, ["v"]).collect()} == {("a", 0), ("b", 5)}
    assert {(r["user_id"], r["v"]) for r in tab.keep_last(df, KEYS, ["v"]).collect()} == {("a", 1999), ("b", 5)}
    assert [r["v"] for r in tab.top_n(df, "v", 2, "user_id").collect()] == [1999, 1998]


@pytest.fixture(scope="module")
def sessions(spark):
    rows = [(f"u{u}", e, f"l{(u * e) % 4}") for u in range(97) for e in range(1 + u % 5)]
    return spark.createDataFrame(rows, "user_id string, exercise_id int, label string").cache()


def users_of(df, value):
    return {r[0] for r in df.filter(F.col("split") == value).select("user_id").distinct().collect()}


def test_splits_never_share_users(sessions):
    exact = splits.split_by_user(sessions, exact=True)
    assert len(users_of(exact, "test")) == 20  # ceil(0.2 * 97)
    drawn = splits.with_validation(splits.split_by_user(sessions))
    sides = [users_of(drawn, s) for s in ("train", "validation", "test")]
    assert all(sides) and sum(map(len, sides)) == 97 and set.union(*sides) == {f"u{u}" for u in range(97)}
    again = splits.split_by_user(sessions.limit(50))
    assert users_of(again, "test") <= sides[2]
    other = splits.split_by_user(sessions, seed=67)
    assert users_of(other, "test") != sides[2]


def test_stratified_and_tail_validation(sessions):
    base = splits.split_by_user(sessions)
    train = base.filter("split = 'train'")
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    moved = splits.stratified_validation(base).filter("split = 'validation'").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in moved} == {k: int(np.floor(0.2 * n + 0.5)) for k, n in sizes.items()}
    keys = sorted((r[0], r[1]) for r in train.select(*KEYS).collect())
    tail = {(r[0], r[1]) for r in splits.tail_validation(base).filter("split = 'validation'").select(*KEYS).collect()}
    assert tail == set(keys[int(np.floor(0.85 * len(keys))) :])


def test_fallback_keeps_every_class_in_train(spark):
    rows = [(f"u{u}", e, "common") for u in range(30) for e in range(3)] + [(f"u{u}", 9, f"only{u}") for u in range(30)]
    rows += [(f"u{u}", 10 + i, f"only{u}") for u in range(30) for i in range(4)]
    base = spark.createDataFrame(rows, "user_id string, exercise_id int, label string").withColumn("split", F.lit("train"))
    assert not splits.lost_classes(splits.with_validation(base)).isEmpty()
    split = splits.train_validation(base)
    assert splits.lost_classes(split).isEmpty()
    assert split.filter("split = 'validation'").count() > 0


def test_folds_cover_rows_once(sessions):
    for folds in (splits.user_folds(sessions), splits.balanced_user_folds(sessions)):
        per_user = folds.groupBy("user_id").agg(F.count_distinct("fold").alias("k"))
        assert per_user.filter("k <> 1").isEmpty()
        sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
        assert len(sizes) == 5 and sum(sizes) == sessions.count()
    assert max(sizes) - min(sizes) <= 8


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_percentiles_are_exact(spark, accuracy):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), rng.integers(0, 3, 500)])
    df = spark.createDataFrame([(float(v), float(i)) for i, v in enumerate(values)], "v double, w double")
    df = df.withColumn("empty", F.lit(None).cast("double"))
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = prep.column_percentiles(df, ["v", "w", "empty"], points, accuracy).collect()
    found = {(r["feature"], r["point"]): r["value"] for r in got}
    assert len(found) == 12
    for p in points:
        assert found["v", p] == pytest.approx(np.quantile(values, p), abs=1e-12)
        assert found["w", p] == pytest.approx(np.quantile(np.arange(5000), p), abs=1e-9)


def test_statistics_come_from_train_rows_only(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,), (5.0,)], "v double")
    test = spark.createDataFrame([(1000.0,), (None,)], "v double")
    assert [r[0] for r in prep.fit_mean_fill(train, ["v"]).apply(test).collect()] == [1000.0, 3.0]
    assert [r[0] for r in prep.fit_median_fill(train, ["v"]).apply(test).collect()] == [1000.0, 3.0]
    scaler = prep.fit_scaler(train, ["v"])
    assert scaler.scale["v"] == pytest.approx(np.std([1, 3, 5]))
    assert prep.fit_scaler(train.filter("v = 1"), ["v"]).scale["v"] == 1.0
    empty = train.withColumn("v", F.lit(None).cast("double"))
    assert prep.fit_mean_fill(empty, ["v"]).values == {"v": 0.0}
    leaky = prep.global_mean_fill(train.unionByName(test), ["v"]).collect()
    assert leaky[2][0] == pytest.approx((1 + 3 + 5 + 1000) / 4)


def test_column_choice(spark):
    rows = [(float(i), None if i % 2 else 1.0, 7.0, "ab"[i % 2], f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "good double, gappy double, flat double, two string, many string")
    choice = prep.choose_snapshot_columns(df, ["good", "gappy", "flat"], ["two", "many"])
    assert choice.kept == ["good", "two"]
    assert choice.dropped == {"gappy": "missing", "flat": "low_variance", "many": "cardinality"}
    assert prep.choose_session_columns(df, ["good", "gappy", "flat"]).kept == ["good"]


def test_information_prefers_the_telling_column(spark):
    rng = np.random.default_rng(0)
    rows = [("yes" if i % 2 else "no", float(i % 2) + rng.random() * 0.1, float(rng.random())) for i in range(400)]
    df = spark.createDataFrame(rows, "label string, telling double, noise double")
    assert prep.choose_by_information(df, ["noise", "telling"], 1) == ["telling"]


def test_padded_sequences(spark):
    rows = [("a", 1, i, float(i)) for i in range(5)] + [("b", 1, 0, 9.0)]
    df = spark.createDataFrame(rows, "user_id string, exercise_id int, snapshot_sequence_num int, v double")
    for hot_rows in (None, 2):
        got = {r["user_id"]: r["sequence"] for r in prep.padded_sequences(df, ["v", "v"], 3, hot_rows=hot_rows).collect()}
        assert got == {"a": [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]], "b": [[9.0, 9.0], [0.0, 0.0], [0.0, 0.0]]}


def test_label_codes_reject_unknown_labels(spark):
    train = spark.createDataFrame([("b",), ("a",)], "label string")
    codes = prep.label_codes(train)
    assert {r["label"]: r["label_index"] for r in codes.collect()} == {"a": 0, "b": 1}
    with pytest.raises(Exception, match="not seen in fit"):
        prep.encode_labels(spark.createDataFrame([("c",)], "label string"), codes).collect()


def test_one_hot_of_unseen_value_is_zero(spark):
    train = spark.createDataFrame([("x",), ("y",)], "c string")
    model = training.one_hot(train, ["c"])
    got = model.transform(spark.createDataFrame([("x",), ("y",), ("z",)], "c string")).collect()
    assert [r["c_onehot"].toArray().tolist() for r in got] == [[1, 0], [0, 1], [0, 0]]


def test_pca_is_centred_with_fixed_signs(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(60, 3)) @ np.diag([3.0, 1.0, 0.2]) + 10
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(data)], "id int, e array<double>")
    model = training.fit_embedding_pca(df, "e", 3, 2)
    rows = training.apply_embedding_pca(df, "e", 3, model).orderBy("id").collect()
    got = np.array([r["e_pca"] for r in rows])
    centred = data - data.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(axis=1)])[:, None]
    np.testing.assert_allclose(got, centred @ axes.T, atol=1e-8)
    assert training.fit_embedding_pca(df.limit(2), "e", 3, 2) is None
    assert training.fit_embedding_pca(df, "e", 0, 2) is None
