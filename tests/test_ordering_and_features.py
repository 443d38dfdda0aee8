"""Ordering, downsampling and session statistics against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from snapweave.operators.aggregates import (
    class_weights,
    column_profile,
    intake_report,
    length_percentile,
    session_features,
)
from snapweave.operators.ordering import (
    POS,
    SIZE,
    global_positions,
    number_by_slices,
    number_rows,
    previous,
    prompt_order,
)
from snapweave.operators.sessions import column_roles, downsample

KEYS = ["user_id", "exercise_id"]


@pytest.fixture(scope="module")
def events():
    """Sessions of 1, 2, 3, 7 and 400 rows; gaps in one feature, a column missing in a whole session."""
    rng = np.random.default_rng(7)
    rows, event = [], 0
    for user, size in (("a", 1), ("b", 2), ("c", 3), ("d", 7), ("hot", 400)):
        clock = np.sort(rng.integers(0, max(3, size // 2), size)).astype(float)
        for i in range(size):
            gap = rng.random() < 0.2 and user != "a"
            rows.append(
                {
                    "event_id": event,
                    "user_id": user,
                    "exercise_id": 1,
                    "seconds_from_start": clock[i] * 1.5,
                    "snapshot_sequence_num": i + 1,
                    "chars_in_snapshot": None if gap else float(rng.integers(0, 50)),
                    "task_code_cosine": None if user == "c" else float(rng.random()),
                    "min_interval_seconds": 60.0,
                }
            )
            event += 1
    return pd.DataFrame(rows).astype({"chars_in_snapshot": float, "task_code_cosine": float})


@pytest.fixture(scope="module")
def frame(spark, events):
    df = spark.createDataFrame(events.sample(frac=1, random_state=1))
    doubles = ["chars_in_snapshot", "task_code_cosine"]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles}).repartition(5)


def as_pandas(df, by):
    return df.toPandas().sort_values(by).reset_index(drop=True)


@pytest.mark.parametrize("hot_rows", [None, 1_000_000, 5, 0])
def test_numbering_is_the_same_for_ordinary_and_split_sessions(frame, events, hot_rows):
    lags = ["chars_in_snapshot", "seconds_from_start"]
    got = number_rows(frame, order=prompt_order(frame), lags=lags, fill=["chars_in_snapshot"], hot_rows=hot_rows)
    got = as_pandas(got, "event_id")
    want = events.sort_values(["user_id", "seconds_from_start", "event_id"]).copy()
    by_session = want.groupby("user_id")
    want["chars_in_snapshot"] = by_session["chars_in_snapshot"].transform(lambda s: s.fillna(s.mean()))
    want["pos"] = by_session.cumcount()
    want["n"] = by_session["event_id"].transform("size")
    for c in lags:
        want["lag_" + c] = want.groupby("user_id")[c].shift()
    want = want.sort_values("event_id").reset_index(drop=True)
    assert got[POS].tolist() == want["pos"].tolist()
    assert got[SIZE].tolist() == want["n"].tolist()
    np.testing.assert_allclose(got["chars_in_snapshot"].astype(float), want["chars_in_snapshot"])
    for c in lags:
        np.testing.assert_allclose(got[previous(c)].astype(float), want["lag_" + c])


def test_slices_with_ties_and_missing_values(spark):
    rows = [("k", i % 3 if i % 5 else None, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(7)
    order = [F.col("v").asc_nulls_last(), F.col("id").desc()]
    got = {r["id"]: r[POS] for r in number_by_slices(df, ["g"], order, slices=6).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, -r[2]))
    assert [got[r[2]] for r in want] == list(range(200))


def test_global_positions(spark):
    df = spark.range(500).withColumn("h", F.md5(F.col("id").cast("string")))
    got = [r["h"] for r in global_positions(df, [F.col("h")]).orderBy(POS).collect()]
    assert got == sorted(got) and len(got) == 500


def linspace_positions(n, m):
    if n <= m:
        return list(range(n))
    return sorted(set(np.round(np.linspace(0, n - 1, num=m)).astype(int).tolist()))


@pytest.mark.parametrize("m", [1, 2, 3, 8, 20])
def test_downsample_keeps_the_evenly_spaced_rows(spark, m):
    sizes = list(range(1, 64)) + [97, 200, 641]
    rows = [(f"u{n}", 1, float(i), i) for n in sizes for i in range(n)]
    df = spark.createDataFrame(rows, "user_id string, exercise_id int, seconds_from_start double, event_id int")
    kept = downsample(df, m, hot_rows=None).groupBy("user_id").agg(F.sort_array(F.collect_list(POS)).alias("p"))
    got = {r["user_id"]: r["p"] for r in kept.collect()}
    for n in sizes:
        assert got[f"u{n}"] == linspace_positions(n, m), (n, m)
        assert got[f"u{n}"][0] == 0 and len(got[f"u{n}"]) <= m
        assert m == 1 or got[f"u{n}"][-1] == n - 1


def brute_features(session, names):
    session = session.sort_values("snapshot_sequence_num")
    n, out = len(session), {"sequence_length": len(session)}
    for f in names:
        v = session[f].to_numpy(float)
        if np.isnan(v).all():
            continue
        v = np.where(np.isnan(v), np.nanmean(v), v)
        out |= {f"{f}_mean": v.mean(), f"{f}_std": v.std(), f"{f}_min": v.min(), f"{f}_max": v.max()}
        out |= {f"{f}_{k}": np.percentile(v, q) for k, q in (("q1", 25), ("median", 50), ("q3", 75))}
        if n > 1:
            d = np.diff(v)
            out |= {f"{f}_diff_mean": d.mean(), f"{f}_diff_std": d.std(), f"{f}_diff_max": np.abs(d).max()}
            out[f"{f}_trend"] = np.polyfit(np.arange(n), v, 1)[0]
    t = session["seconds_from_start"].to_numpy()
    out["total_duration"] = t[-1] - t[0]
    out["avg_time_between"] = (t[-1] - t[0]) / (n - 1) if n > 1 else 0.0
    out["time_std"] = np.diff(t).std() if n > 2 else 0.0
    out["final_snapshot_num"] = n
    out["avg_chars_per_snapshot"] = out.get("chars_in_snapshot_mean", 0.0)
    return out


@pytest.mark.parametrize("hot_rows", [None, 6, 0])
def test_session_features_match_numpy(frame, events, hot_rows):
    names = ["seconds_from_start", "chars_in_snapshot", "task_code_cosine", "min_interval_seconds"]
    got = session_features(frame, names, hot_rows=hot_rows).toPandas().set_index("user_id")
    for user, session in events.groupby("user_id"):
        want = brute_features(session, names)
        for c in got.columns.difference(["exercise_id", "total_keystrokes", "total_saves"]):
            value = got.loc[user, c]
            if c in want:
                assert value == pytest.approx(want[c], rel=1e-9, abs=1e-9), (user, c)
            else:
                assert pd.isna(value), (user, c)
    assert got.loc["b", "chars_in_snapshot_diff_std"] == 0
    assert (got["total_saves"] == 0).all()


def test_column_roles(spark):
    rows = [("a", 1, 5, None, "x"), ("a", 1, 5, 1.0, "y"), ("a", 1, 5, None, None), ("b", 1, 1, None, None)]
    df = spark.createDataFrame(rows, "user_id string, exercise_id int, same int, gappy double, text string")
    got = {r["user_id"]: r for r in column_roles(df, ["same", "gappy", "text"]).collect()}
    assert got["a"]["session_cols"] == ["same", "gappy"] and got["a"]["snapshot_cols"] == ["text"]
    assert got["b"]["session_cols"] == ["same"] and got["b"]["snapshot_cols"] == []


def test_profiles_and_small_summaries(spark):
    df = spark.createDataFrame([("a", 1, 1.0, "x"), ("b", 1, None, "x"), (None, 1, 3.0, None)], "user_id string, exercise_id int, v double, label string")
    profile = {r["feature"]: r for r in column_profile(df, ["v"], ["label"]).collect()}
    assert profile["v"]["missing_rate"] == pytest.approx(1 / 3) and profile["v"]["variance"] == 2.0
    assert profile["label"]["n_distinct"] == 1
    intake = intake_report(df).first().asDict()
    assert intake == {
        "rows_seen": 3, "rows_without_key": 1, "rows_without_label": 0, "sessions_seen": 2, "sessions_aggregated": 2,
    }
    weights = {r["label"]: r["weight"] for r in class_weights(spark.createDataFrame([("p",), ("p",), ("q",)], "label string")).collect()}
    assert weights == {"p": 0.75, "q": 1.5}
    lengths = spark.createDataFrame([(n,) for n in range(1, 12)], "seq_len long")
    assert length_percentile(lengths, 0.9).first()["maxlen"] == 10
    assert length_percentile(lengths.limit(0), 0.9).first()["maxlen"] == 2


def test_empty_input(spark, frame):
    assert session_features(frame.limit(0), ["chars_in_snapshot"]).count() == 0
    assert downsample(frame.limit(0)).count() == 0
