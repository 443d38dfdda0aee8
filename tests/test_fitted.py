"""Tree ensembles, kernel features, the recurrent net and neighbour information against plain versions."""

import math

import numpy as np
import pytest

from snapweave.operators import information
from snapweave.plans import boosting, extra_trees as xt, kernel, recurrent
from snapweave.plans.fit_rows import fit_rows

COLUMNS = ["a", "b", "c", "flat"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        y = i % 3
        a, b = y + rng.normal() * 0.6, round(rng.normal() + (y == 2), 1)
        rows.append((f"u{i % 40}", i, y, [1.0, 1.0, 2.0][y], float(a), float(b), float(rng.integers(0, 4)), 1.0))
    rows.append(("u0", 999, None, 1.0, 0.0, 0.0, 0.0, 1.0))
    df = spark.createDataFrame(rows, "user_id string, exercise_id int, label_index int, weight double, a double, b double, c double, flat double")
    return df.repartition(3).cache()


def arrays(table):
    rows = table.filter("label_index IS NOT NULL").orderBy("exercise_id").collect()
    return np.array([[r[c] for c in COLUMNS] for r in rows]), np.array([r["label_index"] for r in rows]), np.array([r["weight"] for r in rows])


# --- extra trees ---


def plain_tree(x, y, w, tree, seed, k, least, depth, name=1, level=0):
    """The tree by plain recursion: node name to (feature, cut) or class weights."""
    shares = np.bincount(y, w, minlength=3)
    order = sorted(range(x.shape[1]), key=lambda f: (xt.plain_draw(seed, "order", tree, name, f), f))
    differing = [f for f in order if x[:, f].min() < x[:, f].max()][:k]
    best = None
    if level < depth and len(x) >= max(2, 2 * least) and len(set(y)) > 1:
        for f in sorted(differing):
            cut = x[:, f].min() + xt.plain_draw(seed, "cut", tree, name, f) * (x[:, f].max() - x[:, f].min())
            left = x[:, f] < cut
            if min(left.sum(), (~left).sum()) < least:
                continue
            parts = [np.bincount(y[m], w[m], minlength=3) for m in (left, ~left)]
            score = round(sum((p**2).sum() / p.sum() for p in parts), 9)
            if best is None or score > best[0]:
                best = (score, f, cut, left)
    if best is None:
        return {name: shares}
    _, f, cut, left = best
    out = {name: (f, cut)}
    for m, child in ((left, 2 * name), (~left, 2 * name + 1)):
        out |= plain_tree(x[m], y[m], w[m], tree, seed, k, least, depth, child, level + 1)
    return out


@pytest.mark.parametrize("weight, least, depth", [(None, 1, 60), ("weight", 4, 60), (None, 1, 2)])
def test_extra_trees_are_those_of_plain_recursion(table, weight, least, depth):
    x, y, w = arrays(table)
    w = w if weight else np.ones(len(y))
    forest = xt.fit_extra_trees(table, COLUMNS, 3, weight=weight, trees=4, seed=7, least=least, depth=depth)
    for number, ((feature, cut, left, shares), names) in enumerate(zip(forest.trees, forest.names)):
        want = plain_tree(x, y, w, number, 7, 2, least, depth)
        assert set(names.tolist()) == set(want)
        for name, f, c, s in zip(names.tolist(), feature, cut, shares):
            if f >= 0:
                assert want[name][0] == f and want[name][1] == pytest.approx(c)
            else:
                assert np.allclose(want[name], s)


def test_extra_trees_predict(table):
    forest = xt.fit_extra_trees(table, COLUMNS, 3, trees=30)
    scored = forest.predict(table.filter("label_index IS NOT NULL")).collect()
    assert all(r["prediction"] == r["label_index"] and sum(r["probability"]) == pytest.approx(1) for r in scored)
    found = forest.importances()
    assert found["a"] == max(found.values()) and found["flat"] == 0 and sum(found.values()) == pytest.approx(1)


def test_trees_in_batches_do_not_depend_on_each_other(table, monkeypatch):
    whole = xt.fit_extra_trees(table, COLUMNS, 3, trees=5, depth=3)
    monkeypatch.setattr(xt, "ROW_TREES", 700)
    parts = xt.fit_extra_trees(table.repartition(7), COLUMNS, 3, trees=5, depth=3)
    for a, b in zip(whole.trees, parts.trees):
        assert all(np.allclose(p, q) for p, q in zip(a, b))


def test_a_single_class_and_no_rows(table):
    one = xt.fit_extra_trees(table.filter("label_index = 1"), COLUMNS, 3, trees=2)
    assert [len(t[0]) for t in one.trees] == [1, 1]
    with pytest.raises(ValueError):
        xt.fit_extra_trees(table.filter("label_index IS NULL"), COLUMNS, 3, trees=2)


def test_fit_rows_are_bounded(table):
    assert fit_rows(table, COLUMNS).count() == 300
    assert 60 < fit_rows(table, COLUMNS, most=100).count() < 140


# --- boosting ---


def plain_round(x, y, w, scores, edges, s):
    """New scores after one round, by recursion over row sets."""
    p = boosting.softmax(scores)
    out = scores.copy()
    for c in range(3):
        g, h = w * (p[:, c] - (y == c)), w * p[:, c] * (1 - p[:, c])

        def grow(rows, level):
            best = (1e-9, None)
            if level < s.depth:
                for f, edge in enumerate(edges):
                    for e in edge:
                        left = x[rows, f] <= e
                        if min(left.sum(), (~left).sum()) < s.least:
                            continue
                        parts = [(g[rows[m]].sum(), h[rows[m]].sum()) for m in (left, ~left)]
                        gain = round(sum(a * a / (b + s.hold) for a, b in parts) - g[rows].sum() ** 2 / (h[rows].sum() + s.hold), 9)
                        if gain > best[0]:
                            best = (gain, left)
            if best[1] is None:
                out[rows, c] -= s.rate * g[rows].sum() / (h[rows].sum() + s.hold)
            else:
                grow(rows[best[1]], level + 1)
                grow(rows[~best[1]], level + 1)

        grow(np.arange(len(x)), 0)
    return out


def test_boosting_rounds_are_those_of_plain_recursion(table, monkeypatch):
    monkeypatch.setattr(boosting, "CARRY", 2)
    x, y, w = arrays(table)
    s = boosting.Settings(rounds=5, depth=2, bins=8, least=3)
    model = boosting.fit_boosted(table, COLUMNS, 3, weight="weight", settings=s)
    edges = [np.unique(np.sort(x[:, f])[[math.ceil(len(x) * i / 8) - 1 for i in range(1, 8)]]) for f in range(4)]
    scores = np.tile(np.log(np.bincount(y, w) / w.sum()), (len(y), 1))
    assert np.allclose(model.start, scores[0])
    for n in range(5):
        loss = -(w * np.log(boosting.softmax(scores)[np.arange(len(y)), y])).sum() / w.sum()
        assert model.losses[n] == pytest.approx(loss)
        scores = plain_round(x, y, w, scores, edges, s)
        assert np.allclose(boosting.add_trees(np.tile(model.start, (len(y), 1)), model.rounds[: n + 1], x), scores)
    assert model.losses == sorted(model.losses, reverse=True) and len(model.losses) == 6


def test_boosting_predicts(table):
    model = boosting.fit_boosted(table, COLUMNS, 3, settings=boosting.Settings(rounds=12))
    scored = model.predict(table.filter("label_index IS NOT NULL")).orderBy("exercise_id").collect()
    x, y, _ = arrays(table)
    want = boosting.softmax(boosting.add_trees(np.tile(model.start, (len(y), 1)), model.rounds, x))
    assert np.allclose([r["probability"] for r in scored], want)
    assert [r["prediction"] for r in scored] == want.argmax(1).tolist() and (want.argmax(1) == y).mean() > 0.7
    assert model.predict(table.limit(0)).collect() == []


# --- kernel ---


def test_fourier_features_come_near_the_kernel(table):
    x, _, _ = arrays(table)
    gamma = kernel.scale_gamma(table.filter("label_index IS NOT NULL"), COLUMNS)
    assert gamma == pytest.approx(1 / (4 * x.var()))
    features = kernel.FourierFeatures(tuple(COLUMNS), gamma, 2048)
    z = np.array([r["fourier"] for r in features.apply(table.filter("label_index IS NOT NULL")).orderBy("exercise_id").collect()])
    exact = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - exact).max() < 0.12 and np.abs(z @ z.T - exact).mean() < 0.02


def test_kernel_separates_what_a_line_cannot(spark):
    rng = np.random.default_rng(2)
    points = rng.uniform(-2, 2, (300, 2))
    rows = [(float(a), float(b), int(a * a + b * b < 1.5)) for a, b in points]
    df = spark.createDataFrame(rows, "a double, b double, label_index int")
    ready = kernel.with_kernel_vector(df, kernel.FourierFeatures(("a", "b"), 0.5, 128))
    scored = kernel.rbf_svm(300, 10.0, iterations=50).fit(ready).transform(ready)
    assert scored.filter("prediction = label_index").count() > 285


# --- recurrent net ---


def sequence_rows(n=240, steps=7, seed=3):
    """The class is which of two channels moved last: the order matters, sums do not."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        length = int(rng.integers(2, steps + 1))
        x = np.zeros((steps, 2))
        first, last = (0, 1) if i % 2 else (1, 0)
        x[0, first], x[length - 1, last] = 1, 1
        x[length:] = 9.0  # padding that must not be read
        rows.append((f"u{i % 20}", i, x.tolist(), length, i % 2, i % 20 < 4))
    return rows


SEQUENCE = "user_id string, exercise_id int, sequence array<array<double>>, length int, label_index int, validation boolean"


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    net = recurrent.first_weights(3, 4, 3, 5)
    x, lengths = rng.normal(size=(5, 6, 3)), np.array([6, 1, 3, 0, 4])
    y, w = np.array([0, 1, 2, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0, 3.0])
    _, grad = recurrent.loss_and_gradient(net, x, lengths, y, w)
    values, slope = recurrent.flat(net), recurrent.flat(grad)
    for k in rng.choice(len(values), 60, replace=False):
        up, down = values.copy(), values.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        numeric = (recurrent.loss_and_gradient(recurrent.shaped(up, net), x, lengths, y, w)[0] - recurrent.loss_and_gradient(recurrent.shaped(down, net), x, lengths, y, w)[0]) / 2e-6
        assert slope[k] == pytest.approx(numeric, abs=1e-5)


def test_masked_steps_are_not_read():
    net = recurrent.first_weights(2, 4, 2, 0)
    x, lengths = np.random.default_rng(0).normal(size=(3, 5, 2)), np.array([2, 5, 0])
    other = x.copy()
    other[0, 2:], other[2] = 100, 100
    assert np.allclose(recurrent.forward(net, x, lengths)[0], recurrent.forward(net, other, lengths)[0])


def test_sums_over_tasks_are_those_of_all_rows(spark):
    rows = sequence_rows(50)
    df = spark.createDataFrame([(np.array(r[2]).ravel().tolist(), r[3], r[4], 1.0, int(r[5])) for r in rows], "x array<double>, n bigint, y int, w double, held int")
    net = recurrent.first_weights(2, 3, 2, 1)
    grad, loss, total, held_loss, held_n = recurrent._gradient_sums(df.repartition(4), net, 2, chunk=7)
    mine = [r for r in rows if not r[5]]
    want_loss, want = recurrent.loss_and_gradient(net, np.array([r[2] for r in mine]), np.array([r[3] for r in mine]), np.array([r[4] for r in mine]), np.ones(len(mine)))
    assert np.allclose(grad, recurrent.flat(want)) and loss == pytest.approx(want_loss) and total == len(mine) and held_n == 50 - len(mine) and held_loss > 0


def test_the_net_learns_order_and_stops_early(spark):
    df = spark.createDataFrame(sequence_rows(), SEQUENCE)
    model = recurrent.fit_recurrent(df, 2, 2, held="validation", hidden=8, steps=60, rate=0.05, patience=5)
    scored = model.predict(df).collect()
    assert sum(r["prediction"] == r["label_index"] for r in scored) > 0.95 * len(scored)
    best = min(v for _, v in model.losses)
    assert len(model.losses) <= 60 and best < 0.3


# --- neighbour information ---


def plain_information(x, y, k=3):
    keep = np.array([(y == c).sum() > 1 for c in y])
    x, y = x[keep], y[keep]
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))
    total = 0.0
    for v, c in zip(x, y):
        same = x[y == c]
        wanted = min(k, len(same) - 1)
        r = np.sort(np.abs(same - v))[wanted]
        m = (np.abs(x - v) <= r * (1 - 1e-9)).sum()
        total += psi(wanted) - psi(len(same)) - psi(m)
    return max(0.0, psi(len(x)) + total / len(x))


@pytest.mark.parametrize("block", [100_000, 7])
def test_neighbour_information(spark, block, monkeypatch):
    monkeypatch.setattr(information, "BLOCK", block)
    monkeypatch.setattr(information.with_radius, "__defaults__", (3, block))
    rng = np.random.default_rng(11)
    y = rng.integers(0, 3, 200)
    y[0] = 7  # a label with one row
    data = {"close": y + rng.normal(size=200) * 0.3, "noise": rng.normal(size=200), "ties": np.round(y + rng.normal(size=200)), "same": np.zeros(200)}
    rows = [(f"l{y[i]}", *[float(v[i]) for v in data.values()]) for i in range(200)] + [(None, 1.0, 1.0, 1.0, 1.0), ("l1", None, None, float("nan"), None)]
    df = spark.createDataFrame(rows, "label string, close double, noise double, ties double, same double")
    got = {r["feature"]: r["mi"] for r in information.neighbour_information(df, list(data)).collect()}
    assert got == {c: pytest.approx(plain_information(v, y), abs=1e-9) for c, v in data.items()}
    assert information.choose_by_neighbours(df, list(data), 1) == ["close"]
    assert information.neighbour_information(df.limit(0), list(data)).collect() == []


def test_forests_lie_in_files_and_not_on_the_driver(table):
    forest = xt.fit_extra_trees(table, COLUMNS, 3, trees=6, depth=3)
    held = [v for v in vars(forest).values() if isinstance(v, (list, tuple, dict, np.ndarray)) and v != forest.columns]
    assert not held and forest.size == 6
    nodes = forest.split_table(table.sparkSession).groupBy("tree").count().collect()
    assert {r["tree"]: r["count"] for r in nodes} == {t: len(names) for t, names in enumerate(forest.names)}


def test_forests_of_any_size_predict(table, monkeypatch):
    monkeypatch.setattr(xt, "MOST_NODES", 3, raising=False)  # was: an error above that many nodes
    forest = xt.fit_extra_trees(table, COLUMNS, 3, trees=4)
    assert forest.predict(table).count() == table.count()
    assert forest.predict(table.limit(0)).collect() == []
