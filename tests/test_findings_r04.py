"""Findings of round 04: models are fitted on all rows."""

import numpy as np
import pytest

from pyspark.ml.classification import LinearSVC

from snapweave.plans import boosting, draws, extra_trees as xt, growing, kernel, recurrent
from snapweave.plans.fit_rows import fit_rows

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def many(spark):
    """More rows than models were once fitted on."""
    return spark.range(0, 24_000, 1, 3).selectExpr(
        "concat('u', id % 97) AS user_id", "cast(id AS int) AS exercise_id", "cast(id % 3 AS int) AS label_index",
        "1 + id % 2 AS weight", "double((id * 7919) % 1009 + 300 * (id % 3)) AS a", "double((id * 104729) % 17) AS b", "double(id % 5) AS c",
    ).cache()


@pytest.fixture(scope="module")
def few(many):
    return many.filter("exercise_id < 900").cache()


def as_dict(forest):
    out = []
    for names, (feature, cut, left, shares) in zip(forest.names, forest.trees):
        assert all(names[left[i]] == 2 * names[i] and names[left[i] + 1] == 2 * names[i] + 1 for i in np.flatnonzero(left >= 0))
        out.append({n: (f, round(c, 9), tuple(np.round(s, 6))) for n, f, c, s in zip(names.tolist(), feature.tolist(), cut.tolist(), shares)})
    return out


def test_all_rows_are_fit_rows(many):
    assert fit_rows(many, COLUMNS).count() == 24_000


def test_trees_stand_on_all_rows(many):
    forest = xt.fit_extra_trees(many, COLUMNS, 3, trees=2, depth=2)
    assert [shares[0].sum() for *_, shares in forest.trees] == [24_000] * 2


def test_boosting_stands_on_all_rows(many):
    model = boosting.fit_boosted(many.withColumn("weight", many.weight * 1.0), COLUMNS, 3, weight="weight", settings=boosting.Settings(rounds=1, depth=1))
    y = many.groupBy("label_index").agg({"weight": "sum"}).orderBy("label_index").collect()
    assert np.exp(model.start) == pytest.approx([r[1] / 36_000 for r in y], abs=1e-12)


def test_the_net_is_fitted_on_all_rows(spark, monkeypatch):
    seen = []
    real = recurrent._gradient_sums
    monkeypatch.setattr(recurrent, "_gradient_sums", lambda rows, *rest: seen.append(rows.count()) or real(rows, *rest))
    df = spark.range(21_000).selectExpr("'u' AS user_id", "cast(id AS int) AS exercise_id", "array(array(double(id % 2))) AS sequence", "1 AS length", "cast(id % 2 AS int) AS label_index")
    recurrent.fit_recurrent(df, 1, 2, hidden=2, steps=1)
    assert seen == [21_000]


def test_draws_of_arrays_are_those_of_texts(monkeypatch):
    rng = np.random.default_rng(1)
    names = np.concatenate([rng.integers(1, 2**61, 40), rng.integers(1, 99, 40), 2 ** np.arange(61)])
    features = rng.integers(0, 130, (len(names), 5))
    for seed, tree in ((42, 0), (7, 299), (10**20, 123_456)):
        want = [[xt.plain_draw(seed, "order", tree, n, f) for f in row] for n, row in zip(names.tolist(), features.tolist())]
        assert (draws.plain_draws(seed, "order", tree, names, features) == want).all()
        monkeypatch.setattr(draws, "FEW", 0)
        assert (draws.plain_draws(seed, "order", tree, names, features) == want).all()


@pytest.mark.parametrize("weight, least", [(None, 1), ("weight", 3)])
def test_parts_of_trees_are_the_whole_trees(few, monkeypatch, weight, least):
    whole = as_dict(xt.fit_extra_trees(few, COLUMNS, 3, weight=weight, trees=3, least=least))
    monkeypatch.setattr(xt, "task_rows", lambda columns: 70)
    monkeypatch.setattr(xt, "ROW_TREES", 2_000)
    assert as_dict(xt.fit_extra_trees(few.repartition(5), COLUMNS, 3, weight=weight, trees=3, least=least)) == whole


def test_few_values_are_treated_as_many(few, monkeypatch):
    rows = few.orderBy("exercise_id").collect()
    data = np.array([[r[c] for c in COLUMNS] for r in rows]), np.array([r["label_index"] for r in rows]), np.ones(900), np.arange(900)
    for best in (False, True):
        rule = growing.Rule(3, 60, 1, 2, 3, best=best, bagged=best)
        found = []
        for limit in (0, 1_000, 10**9):
            monkeypatch.setattr(growing, "FEW_VALUES", limit)
            found.append(growing.grow(*data, 1, rule))
        assert all(np.allclose(p, q) for other in found[1:] for p, q in zip(found[0], other))


def plain_best_tree(x, y, w, tree, rule, name=1):
    """The tree of best cuts by plain recursion: node name to (feature, cut) or class weights."""
    shares = np.bincount(y, w, minlength=rule.classes)
    order = sorted(range(x.shape[1]), key=lambda f: (xt.plain_draw(rule.seed, "order", tree, name, f), f))
    best = None
    if len(set(y)) > 1:
        for f in sorted([f for f in order if x[:, f].min() < x[:, f].max()][: rule.candidates]):
            values = np.unique(x[:, f])
            for low, high in zip(values, values[1:]):
                left = x[:, f] <= low
                score = round(sum((p**2).sum() / p.sum() for p in (np.bincount(y[m], w[m], minlength=rule.classes) for m in (left, ~left))), 9)
                if best is None or score > best[0]:
                    best = (score, f, (low + high) / 2, left)
    if best is None:
        return {name: shares}
    _, f, cut, left = best
    parts = (plain_best_tree(x[m], y[m], w[m], tree, rule, child) for m, child in ((left, 2 * name), (~left, 2 * name + 1)))
    return {name: (f, cut)} | next(parts) | next(parts)


def test_forests_of_best_cuts_are_those_of_plain_recursion(few):
    rows = few.filter("exercise_id < 300").orderBy("exercise_id").collect()
    x, y = np.array([[r[c] for c in COLUMNS] for r in rows]), np.array([r["label_index"] for r in rows])
    rule = growing.Rule(5, 60, 1, 2, 3, best=True, bagged=True)
    names, feature, cut, left, shares = growing.grow(x, y, np.ones(300), np.arange(300), 4, rule)
    times = growing.bag(np.arange(300), 4, 5)
    kept = times > 0
    want = plain_best_tree(x[kept], y[kept], times[kept].astype(float), 4, rule)
    assert set(names.tolist()) == set(want)
    for name, f, c, s in zip(names.tolist(), feature, cut, shares):
        assert want[name] == (f, pytest.approx(c)) if f >= 0 else np.allclose(want[name], s)


def test_bootstrap_samples():
    times = np.array([growing.bag(np.arange(20_000), t, 42) for t in range(20)])
    assert abs(times.mean() - 1) < 0.01 and abs(times.var() - 1) < 0.02 and abs((times == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(times)[np.triu_indices(20, 1)]).max() < 0.04


@pytest.mark.parametrize("fits", [10**6, 200])
def test_random_forests_predict(few, monkeypatch, fits):
    monkeypatch.setattr(xt, "task_rows", lambda columns: fits)
    forest = xt.fit_random_forest(few, COLUMNS, 3, trees=6)
    scored = forest.predict(few).collect()
    assert all(sum(r["probability"]) == pytest.approx(1) for r in scored)
    assert np.mean([r["prediction"] == r["label_index"] for r in scored]) > 0.9
    sums = [shares[0].sum() for *_, shares in forest.trees]
    assert len(set(sums)) > 1 and all(700 < s < 1100 for s in sums)
    with pytest.raises(ValueError):
        xt.fit_random_forest(few.limit(0), COLUMNS, 3, trees=2)


@pytest.mark.parametrize("sketch", [100, 1_000, 100_000])
def test_bin_edges_are_exact_whatever_the_sketch_tells(many, monkeypatch, sketch):
    monkeypatch.setattr(boosting, "SKETCH", sketch)
    rows = fit_rows(many, COLUMNS)
    x = np.sort(np.array([r["x"] for r in rows.select("x").collect()]), axis=0)
    for f, found in enumerate(boosting.bin_edges(rows, 3, 16)):
        assert found.tolist() == np.unique(x[[-(-24_000 * i // 16) - 1 for i in range(1, 16)], f]).tolist()


def test_classes_of_large_machines_are_fitted_one_by_one(spark, few, monkeypatch):
    features = kernel.FourierFeatures(tuple(COLUMNS), 1e-5, 32)
    ready = kernel.with_kernel_vector(few.withColumn("label_index", few.label_index * 1.0), features)
    machine = kernel.rbf_svm(900, parallelism=4, iterations=20)
    want = machine.fit(ready).transform(ready).select("exercise_id", "prediction")
    running, kept, real = [], [], LinearSVC._fit

    def fit(self, df):
        running.append(1)
        kept.append((len(running), spark.sparkContext._jsc.getPersistentRDDs().size()))
        try:
            return real(self, df)
        finally:
            running.pop()

    monkeypatch.setattr(LinearSVC, "_fit", fit)
    monkeypatch.setattr(kernel, "CACHED_BYTES", 1_000)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    model = kernel.fit_by_class(machine, ready, 900, 32)
    assert kept == [(1, before)] * 3
    got = model.transform(ready).select("exercise_id", "prediction")
    assert got.join(want, ["exercise_id", "prediction"]).count() >= 895


def test_kernel_queries_write_no_features(spark, monkeypatch):
    from catalog import fitted_queries, model_queries

    df = spark.range(40).selectExpr(
        "concat('u', id) AS user_id", "cast(id AS int) AS exercise_id", "'l' || id % 2 AS label", "id % 2 * 1.0D AS label_index",
        "if(id % 4 < 3, 'train', 'test') AS split", "id * 1.0D AS a", "id % 3 * 1.0D AS b",
    )
    real = kernel.rbf_svm
    monkeypatch.setattr(kernel, "rbf_svm", lambda rows, parallelism: real(rows, parallelism=parallelism, iterations=2))
    written = []
    for module in (fitted_queries, model_queries):
        monkeypatch.setattr(module, "materialize", lambda rows, name="stage", *rest: written.append(name) or rows)
    monkeypatch.setattr(fitted_queries, "COLUMNS", ["a", "b"])
    monkeypatch.setattr(fitted_queries, "scaled_sessions", lambda spark, sf: (df, ["l0", "l1"]))
    monkeypatch.setattr(model_queries, "model_frame", lambda spark, sf: (df.withColumn("weight", df.a), ["l0", "l1"], ["a", "b"]))
    assert fitted_queries.m5_full(spark, "").count() == 10 and model_queries._kernel_svm(spark, "").count() == 10
    assert "kernel" not in written
