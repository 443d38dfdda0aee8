"""Neighbours against brute force, model fitting, search and saving."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapweave.operators.neighbours import nearest_neighbours, vote
from snapweave.operators.splits import user_folds
from snapweave.plans import training


@pytest.mark.parametrize("blocks", [(20_000, 50_000), (7, 5)])
def test_neighbours_match_brute_force(spark, blocks):
    rng = np.random.default_rng(4)
    train = np.round(rng.normal(size=(150, 3)), 1)
    train[:50] = train[0]  # a third of the train rows are copies
    test = np.vstack([np.round(rng.normal(size=(30, 3)), 1), train[:2]])
    frame = lambda data, tag: spark.createDataFrame(
        [(f"{tag}{i:03d}", 1, f"l{i % 3}", *map(float, r)) for i, r in enumerate(data)],
        "user_id string, exercise_id int, label string, a double, b double, c double",
    )
    got = nearest_neighbours(frame(test, "t"), frame(train, "n"), ["a", "b", "c"], 5, train_block=blocks[0], test_block=blocks[1], pivots=6)
    found = {}
    for r in got.orderBy("session", "rank").collect():
        found.setdefault(r["session"], []).append((r["distance"], r["neighbour"]))
    for i, row in enumerate(test):
        d = np.sqrt(((train - row) ** 2).sum(axis=1))
        want = sorted((float(x), f"n{j:03d}|1") for j, x in enumerate(d))[:5]
        assert found[f"t{i:03d}|1"] == want
    votes = vote(got)
    assert votes.count() == len(test) and votes.filter("votes < 1 OR votes > 5").isEmpty()


def test_train_blocks_travel_only_where_they_are_visited(spark, monkeypatch):
    """Ten far groups, each asked for by one part of the test rows: no part gets the whole train side."""
    from snapweave.operators import neighbours

    rng = np.random.default_rng(9)
    points = lambda n: np.repeat(np.arange(10) * 1000.0, n)[:, None] + rng.normal(size=(10 * n, 2))
    frame = lambda data, tag: spark.createDataFrame(
        [(f"{tag}{i}", 1, "l", float(a), float(b)) for i, (a, b) in enumerate(data)],
        "user_id string, exercise_id int, label string, a double, b double",
    )
    sent = spark.sparkContext.accumulator(0)
    plain = neighbours._nearest_in_block

    def counted(test, train, k):
        sent.add(len(train))
        return plain(test, train, k)

    monkeypatch.setattr(neighbours, "_nearest_in_block", counted)
    got = nearest_neighbours(frame(points(4), "t"), frame(points(60), "n"), ["a", "b"], 3, test_block=4, pivots=20)
    assert got.count() == 40 * 3
    # 600 train rows to each of the ten parts would be 6000; near groups and a few neighbouring pivots are enough.
    assert 0 < sent.value < 6000
    assert neighbours.pivot_count(100) == 32 and neighbours.pivot_count(10**6) == 250 and neighbours.pivot_count(10**12) == 512


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(8)
    rows = []
    for u in range(40):
        for e in range(3):
            k = (u + e) % 3
            rows.append((f"u{u}", e, "abc"[k], k + rng.normal() * 0.2, rng.normal(), None if rng.random() < 0.1 else float(k), 1.0))
    df = spark.createDataFrame(rows, "user_id string, exercise_id int, label string, x double, noise double, gappy double, flat double")
    df = user_folds(df, 3)
    return training.label_indexer(df).transform(df).cache()


COLUMNS = ["x", "noise", "gappy", "flat"]


def test_pipeline_search_and_reload(spark, frame, tmp_path):
    pipeline = training.model_pipeline(training.random_forest(5, maxDepth=4), COLUMNS, k=2)
    step, _, forest = pipeline.getStages()
    space = {step.k: [1, 2], forest.maxDepth: [2, 4]}
    search = training.grouped_search(frame, pipeline, space, n=3, folds=3)
    assert len(search.avgMetrics) == 3 and max(search.avgMetrics) > 0.8
    chosen = search.bestModel.stages[0].getOrDefault("columns")
    assert set(chosen) <= {"x", "gappy"}
    path = str(tmp_path / "model")
    training.save_model(search.bestModel, path)
    names = ["a", "b", "c"]
    before = training.predictions(search.bestModel, frame, names)
    after = training.predictions(training.PipelineModel.load(path), frame, names)
    shown = ["user_id", "exercise_id", "pred_label"]
    assert before.select(*shown).exceptAll(after.select(*shown)).isEmpty()
    total = before.select((F.col("proba_a") + F.col("proba_b") + F.col("proba_c")).alias("s"))
    assert total.filter("abs(s - 1) > 1e-9").isEmpty()


def test_model_families(spark, frame):
    ready = training.assemble(frame.fillna(1.0, COLUMNS), COLUMNS).withColumn("weight", F.lit(1.0))
    models = {
        "forest": training.random_forest(5, maxDepth=4, weight="weight"),
        "extra": training.extra_trees(5, maxDepth=4),
        "boosted": training.boosted_trees(2, weight="weight"),
        "svm": training.linear_svm(maxIter=5),
        "logistic": training.logistic_regression(120, 50),
        "network": training.sequence_perceptron(4, 3, (4,)),
        "broken": training.sequence_perceptron(4, 2),
    }
    outcomes = training.fit_all(ready, models)
    status = {o.name: o.model is not None for o in outcomes}
    assert status == {name: name != "broken" for name in models}
    assert training.status_table(spark, outcomes).filter("status LIKE 'failed%'").count() == 1
    compared = {r["model"]: r for r in training.compare_models(training.all_predictions(outcomes, ready, ["a", "b", "c"])).collect()}
    assert len(compared) == 6 and compared["forest"]["accuracy"] > 0.8
    top = training.importances(spark, outcomes[0].model, COLUMNS, 2).collect()
    assert len(top) == 2 and top[0]["importance"] >= top[1]["importance"]


def test_drawn_settings_are_repeatable(frame):
    pipeline = training.model_pipeline(training.random_forest(5), COLUMNS)
    space = training.forest_space(pipeline, 50)
    first, second = (training.drawn_param_maps(space, 10) for _ in range(2))
    assert first == second and len({tuple(m.values()) for m in first}) == 10
    assert training.column_choices(50) == [20, 40, 50] and training.column_choices(1) == [1]


def test_resampling_follows_weights(spark):
    rows = [(f"u{i}", 1, 2.5 if i % 2 else 0.5) for i in range(2000)]
    df = spark.createDataFrame(rows, "user_id string, exercise_id int, weight double")
    sizes = {r["weight"]: r["count"] for r in training.balanced_resample(df).groupBy("weight").count().collect()}
    assert abs(sizes[2.5] - 2500) < 100 and abs(sizes[0.5] - 500) < 100
