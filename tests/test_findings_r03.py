"""Findings of round 03: what moves and what a task holds."""

import datetime
import glob
import math

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from catalog import inputs
from catalog.inputs import snapshots
from snapweave.operators.ordering import fill_with_group_mean, filled
from snapweave.plans import kernel, training
from snapweave.sources import files


def test_compressed_csv_is_read_back(spark, tmp_path):
    text = 'line one\nline "two", three ' * 500
    df = spark.createDataFrame([("u", k, text + str(k)) for k in range(40)] + [("u", 41, None)], "user_id string, exercise_id int, code_snapshot string")
    files.write_csv(df, f"{tmp_path}/plain")
    files.write_csv(df, f"{tmp_path}/packed", compression="gzip")
    back = files.read_snapshots(spark, f"{tmp_path}/packed", df.schema)
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    assert not glob.glob(f"{tmp_path}/plain/*.gz") and glob.glob(f"{tmp_path}/packed/*.csv.gz")


def test_embeddings_become_doubles_after_they_moved(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    events = [(k, start + datetime.timedelta(hours=k), k % 4, "click", float(k), '{"k": 1}') for k in range(60)]
    vectors = [(k, [k + 0.25] * 64) for k in range(7)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = snapshots(spark, str(tmp_path), chars=False, embeddings=True)
    assert [df.schema[c].dataType.simpleString() for c in ("code_embedding", "task_embedding")] == ["array<double>"] * 2
    rows = {r["event_id"]: r for r in df.collect()}
    assert len(rows) == 60 and rows[23]["code_embedding"] is None and rows[17]["code_embedding"] == [17 % 7 + 0.25] * 60
    assert rows[5]["code_embedding"] == [5.25] * 64
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(code_embedding" in plan.split("Join")[0] and "as array<double>" not in plan.split("Join", 1)[1]


@pytest.mark.parametrize("few", [True, False])
def test_rows_of_one_exercise_do_not_meet_in_a_task(spark, tmp_path, monkeypatch, few):
    if not few:
        monkeypatch.setattr(inputs, "BROADCAST_KEYS", 0)
    vectors = [(0, [0.5]), (1, [1.5]), (1, None), (2, [2.5]), (None, [9.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(k, (0, 0, 0, 1, 7, None)[k % 6]) for k in range(30)]
    df = spark.createDataFrame(rows, "event_id long, x long")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = inputs.with_embeddings(spark, str(tmp_path), df)
        assert ("BroadcastHashJoin [x#" in out._jdf.queryExecution().executedPlan().toString()) == few
        got = sorted(map(str, out.select("event_id", "x", "task_embedding").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    # The code's vector is number event_id % 5: none for 3 and 4, two for 1.
    task = {0: [[0.5]], 1: [[1.5], None]}
    want = [Row(event_id=k, x=x, task_embedding=e) for k, x in rows for _ in range((1, 2, 1, 0, 0)[k % 5]) for e in task.get(x, [None])]
    assert got == sorted(map(str, want))


@pytest.mark.parametrize("few", [True, False])
def test_means_of_few_huge_groups_are_broadcast(spark, few):
    rows = [("a", 1.0), ("a", None), ("a", 3.0), ("b", None), ("b", 5.0)] * 20
    df = spark.createDataFrame(rows, "k string, v double")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = fill_with_group_mean(df, ["k"], ["v"], few)
        assert ("BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()) == few
        got = {(r["k"], r["v"]): r[filled("v")] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert got == {("a", 1.0): 1.0, ("a", None): 2.0, ("a", 3.0): 3.0, ("b", None): 5.0, ("b", 5.0): 5.0}


def test_kernel_features_of_more_rows_than_a_piece(spark, monkeypatch):
    features = kernel.FourierFeatures(("a", "b"), 0.3, size=32)
    n = 2 * kernel.CHUNK + 7
    df = spark.range(0, n, 1, 1).select("id", F.sin("id").alias("a"), F.cos("id").alias("b"))
    got = features.apply(df).orderBy("id").collect()
    w, p = features.draws()
    x = np.array([[r["a"], r["b"]] for r in got])
    np.testing.assert_allclose([r["fourier"] for r in got], math.sqrt(2 / 32) * np.cos(x @ w + p), atol=1e-12)


def test_tasks_of_a_forest_hold_little(spark):
    """Four tasks at once stay far below an executor's memory; an explicit setting is taken."""
    assert training.random_forest().getMaxMemoryInMB() <= 256
    assert training.random_forest(maxMemoryInMB=64).getMaxMemoryInMB() == 64


def test_huge_sessions_are_found_without_running_the_joins(spark):
    from snapweave.operators.aggregates import session_features

    rows = [(k, "a" if k % 3 else "b", 1, k, float(k % 5), "x" if k % 3 else None) for k in range(60)]
    rows += [(99, None, 1, 1, 2.0, "x")] * 50
    snaps = spark.createDataFrame(rows, "event_id long, user_id string, exercise_id int, snapshot_sequence_num long, v double, label string")
    labelled = snaps.filter("label IS NOT NULL")
    joined = labelled.withColumn("v", F.when(F.col("event_id") >= 0, F.raise_error(F.lit("the join ran")).cast("double")))
    planned = session_features(joined, ["v"], carry=["label"], hot_rows=100, counted=snaps)  # plans, and runs no join
    assert "label" in planned.columns
    want = session_features(labelled, ["v"], carry=["label"], hot_rows=None).collect()
    for most in (10, 30, 1000):  # 10: also the session without a label is huge; 1000: none is
        got = session_features(labelled, ["v"], carry=["label"], hot_rows=most, counted=snaps).collect()
        assert len(got) == len(want) == 1
        for name, value in want[0].asDict().items():
            assert got[0][name] == value or abs(got[0][name] - value) < 1e-9, name
