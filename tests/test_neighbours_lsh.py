"""Approximate neighbours: recall against the exact join, hot buckets in blocks, degenerate input."""

import math

import numpy as np
import pytest

from snapweave.operators.neighbours import nearest_neighbours
from snapweave.operators.neighbours_lsh import approximate_neighbours, calibrate, recall


def frame(spark, data, tag):
    rows = [(f"{tag}{i:04d}", 1, f"l{i % 3}", *map(float, r)) for i, r in enumerate(data)]
    return spark.createDataFrame(rows, "user_id string, exercise_id int, label string, a double, b double, c double")


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 3)) * 8
    train = np.vstack([centres[rng.integers(0, 12, 800)] + rng.normal(size=(800, 3)), np.zeros((300, 3))])  # a hot point
    test = np.vstack([centres[rng.integers(0, 12, 80)] + rng.normal(size=(80, 3)), np.zeros((3, 3))])
    return test, train


@pytest.mark.parametrize("blocks", [(20_000, 50_000), (60, 9)])
def test_recall(spark, points, blocks):
    test, train = (frame(spark, p, t) for p, t in zip(points, "tn"))
    near = approximate_neighbours(test, train, ["a", "b", "c"], 5, train_block=blocks[0], test_block=blocks[1]).cache()
    true = nearest_neighbours(test, train, ["a", "b", "c"], 5)
    assert recall(near, true).first()["recall"] >= 0.9
    rows = near.collect()
    assert len({(r["session"], r["neighbour"]) for r in rows}) == len(rows)  # no pair twice
    ranks = {}
    for r in sorted(rows, key=lambda r: (r["session"], r["rank"])):
        ranks.setdefault(r["session"], []).append(r["distance"])
    assert all(d == sorted(d) and len(d) <= 5 for d in ranks.values())
    assert ranks["t0080|1"] == [0.0] * 5


def test_blocks_change_nothing(spark, points):
    test, train = (frame(spark, p, t) for p, t in zip(points, "tn"))
    whole, cut = (
        {tuple(r) for r in approximate_neighbours(test, train, ["a", "b", "c"], 3, train_block=n, test_block=m).collect()} for n, m in ((10**6, 10**6), (50, 7))
    )
    assert whole == cut


def test_buckets_meet_fewer_pairs_than_all(points):
    test, train = points
    found = calibrate(test, train, 5, 10, 4, 0.95, 1)
    met = (found.buckets(test)[:, None, :] == found.buckets(train)[None]).any(2).mean()
    assert math.isfinite(found.width) and met < 0.6


def test_few_rows(spark):
    one = frame(spark, np.zeros((1, 3)), "n")
    got = approximate_neighbours(frame(spark, np.ones((2, 3)), "t"), one, ["a", "b", "c"], 5).collect()
    assert {r["neighbour"] for r in got} <= {"n0000|1"} and len(got) == 2
    assert approximate_neighbours(frame(spark, np.ones((2, 3)), "t").limit(0), one, ["a", "b", "c"]).collect() == []
    with pytest.raises(ValueError):
        approximate_neighbours(one, one.limit(0), ["a", "b", "c"])
