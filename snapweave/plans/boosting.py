"""Gradient boosting with one softmax loss over all classes, from histograms.

A round grows one tree per class. Each level takes one pass over the fit rows: sums of gradient and
curvature by (class, node, feature, bin), all classes together, added up per task with numpy and then by
Spark; what reaches the driver has a fixed number of cells, whatever the number of rows. The cut with the greatest gain
wins. Raw scores follow from the trees; every ``CARRY`` rounds they are written with the rows, so
that a pass never walks more than that many rounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from snapweave.plans.extra_trees import with_prediction
from snapweave.plans.fit_rows import fit_rows, matrix
from snapweave.runtime import materialize

CARRY = 25
_CELLS = "class int, node int, feature int, bin int, g double, h double, n bigint"
_CELL_TYPES = [("class", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("g", pa.float64()), ("h", pa.float64()), ("n", pa.int64())]


@dataclass
class StepTree:
    """A full tree of fixed depth: cut ``k`` has the children 2k + 1 and 2k + 2; a node without a cut sends all to the left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaf(self, x: np.ndarray, levels: int | None = None) -> np.ndarray:
        """Place of each row among the nodes of the last (or the given) level."""
        depth = int(np.log2(len(self.feature) + 1))
        at = np.zeros(len(x), np.int64)
        row = np.arange(len(x))
        for _ in range(depth if levels is None else levels):
            at = 2 * at + 1 + (x[row, self.feature[at]] > self.cut[at])
        return at - (2 ** (depth if levels is None else levels) - 1)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def add_trees(scores: np.ndarray, rounds: Sequence[Sequence[StepTree]], x: np.ndarray) -> np.ndarray:
    scores = scores.copy()
    for trees in rounds:
        for c, tree in enumerate(trees):
            scores[:, c] += tree.value[tree.leaf(x)]
    return scores


SKETCH = 100_000  # ranks that a sketch tells apart


def bin_edges(rows: DataFrame, features: int, bins: int) -> list[np.ndarray]:
    """Distinct inner quantiles of each feature: the value at rank ceil(n * i / bins) for i = 1 to bins - 1.

    Sketches are exact for few rows. Of more, they bracket every rank; the values inside the brackets are counted.
    """
    n = rows.count()
    ranks = [-(-n * i // bins) for i in range(1, bins)]
    if 2 * n <= SKETCH:
        found = _sketched(rows, features, [i / bins for i in range(1, bins)])
        return [np.unique(np.array(f or [], float)) for f in found]
    ends = _sketched(rows, features, [min(1.0, max(0.0, i / bins + s / SKETCH)) for i in range(1, bins) for s in (-4, 4)])
    spans = np.array(ends).reshape(features, bins - 1, 2)  # lowest and highest value that the rank may have

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.sort(matrix(batch.column("x")), axis=0)
            for f in range(features):
                first, end = np.searchsorted(x[:, f], spans[f, :, 0], "left"), np.searchsorted(x[:, f], spans[f, :, 1], "right")
                inside = [np.unique(x[a:b, f], return_counts=True) for a, b in zip(first, end)]
                point = np.concatenate([np.arange(bins - 1), np.repeat(np.arange(bins - 1), [len(v) for v, _ in inside])])
                value = pa.concat_arrays([pa.nulls(bins - 1, pa.float64()), pa.array(np.concatenate([v for v, _ in inside]))])
                count = np.concatenate([first, *[c for _, c in inside]]).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"feature": pa.array(np.full(len(point), f, np.int32)), "point": pa.array(point.astype(np.int32)), "value": value, "n": pa.array(count)})

    # A null value counts the rows below the bracket. What reaches the driver are a few 1 / SKETCH of the rows a rank.
    tally = rows.mapInArrow(run, "feature int, point int, value double, n bigint").groupBy("feature", "point", "value").agg(F.sum("n").alias("n"))
    tally = tally.toPandas().sort_values(["feature", "point", "value"], na_position="first")
    edges = [set() for _ in range(features)]
    for (f, point), part in tally.groupby(["feature", "point"]):
        reached = np.flatnonzero(part["n"].cumsum().to_numpy() >= ranks[point])
        if not len(reached) or not reached[0]:
            raise RuntimeError("a quantile lies outside the bracket of its sketch")
        edges[f].add(float(part["value"].iloc[reached[0]]))
    return [np.array(sorted(e)) for e in edges]


def _sketched(rows: DataFrame, features: int, points: Sequence[float]) -> list[list[float] | None]:
    found = rows.agg(*[F.percentile_approx(F.col("x")[i], list(points), SKETCH).alias(f"f{i}") for i in range(features)]).first()
    return list(found)


def histograms(rows: DataFrame, rounds, growing: Sequence[StepTree], level: int, edges: Sequence[np.ndarray], classes: int) -> pa.Table:
    """Sums by (class, node of the level, feature, bin). Class -1 holds the loss (``g``) and the weight (``h``) of all rows.

    At most classes * nodes * features * bins rows come to the driver.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((list(rounds), list(growing), list(edges)))  # trees of at most CARRY rounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, edges = shared.value
        width = max(len(e) for e in edges) + 1
        cells = np.zeros((3, classes, len(edges), 2**level * width))  # g, h, n: as large whatever the task's rows
        whole = np.zeros(3)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, score = matrix(batch.column("x")), matrix(batch.column("score"))
            y, w = np.asarray(batch.column("y")), np.asarray(batch.column("w"))
            p = softmax(add_trees(score, done, x))
            binned = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]
            whole += -(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum(), w.sum(), len(y)
            for c in range(classes):
                g, h = w * (p[:, c] - (y == c)), w * p[:, c] * (1 - p[:, c])
                node = now[c].leaf(x, level) if level else np.zeros(len(x), np.int64)
                for f in range(len(edges)):
                    key = node * width + binned[f]
                    for sums, v in zip(cells, (g, h, None)):
                        sums[c, f] += np.bincount(key, v, minlength=sums.shape[2])
        if not whole[2]:
            return
        c, f, key = np.nonzero(cells[2])
        out = [c, key // width, f, key % width, *cells[:, c, f, key]]
        columns = [np.concatenate([[first], rest]) for first, rest in zip((-1, 0, 0, 0, *whole), out)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, (_, t) in zip(columns, _CELL_TYPES)], names=[n for n, _ in _CELL_TYPES])

    sums = F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")
    found = rows.mapInArrow(run, _CELLS).groupBy("class", "node", "feature", "bin").agg(*sums).toArrow()
    shared.destroy()
    return found


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    depth: int = 3
    rate: float = 0.1
    least: int = 1  # rows of a leaf
    hold: float = 1.0  # added to the curvature of a leaf
    bins: int = 64


def choose_cuts(cells: np.ndarray, edges: Sequence[np.ndarray], level: int, classes: int, s: Settings) -> list[dict[int, tuple[int, float]]]:
    """Per class the cut (feature, value) of each node that has one with positive gain. ``cells``: g, h, n by class, node, feature, bin."""
    out: list[dict[int, tuple[int, float]]] = []
    for c in range(classes):
        taken: dict[int, tuple[int, float]] = {}
        for node in range(2**level):
            best = (1e-9, None)
            for f, edge in enumerate(edges):
                g, h, n = cells[c, node, f, : len(edge) + 1].T
                left = np.cumsum(np.stack([g, h, n]), 1)[:, :-1]
                if not left.shape[1]:
                    continue
                whole = np.array([g.sum(), h.sum(), n.sum()])[:, None]
                right = whole - left
                gain = left[0] ** 2 / (left[1] + s.hold) + right[0] ** 2 / (right[1] + s.hold) - whole[0] ** 2 / (whole[1] + s.hold)
                gain = np.where((left[2] >= s.least) & (right[2] >= s.least), np.round(gain, 9), -1.0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, float(edge[k])))
            if best[1]:
                taken[node] = best[1]
        out.append(taken)
    return out


@dataclass
class Boosted:
    start: np.ndarray
    rounds: list[list[StepTree]]
    losses: list[float]  # mean training loss before each round, and after the last
    columns: list[str]
    classes: int

    def cut_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (n, c, k, self.columns[int(t.feature[k])], float(t.cut[k]))
            for n, trees in enumerate(self.rounds)
            for c, t in enumerate(trees)
            for k in range(len(t.feature))
            if np.isfinite(t.cut[k])
        ]
        return spark.createDataFrame(rows, "round int, class int, node int, feature string, cut double")

    def leaf_table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, c, k, float(v)) for n, trees in enumerate(self.rounds) for c, t in enumerate(trees) for k, v in enumerate(t.value)]
        return spark.createDataFrame(rows, "round int, class int, leaf int, value double")

    def loss_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.losses)), "round int, loss double")

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` and ``prediction`` (the first greatest)."""
        shared = df.sparkSession.sparkContext.broadcast((self.start, self.rounds))  # rounds * classes small trees

        @F.pandas_udf("array<double>")
        def chances(x):
            import pandas as pd

            start, rounds = shared.value
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
            return pd.Series(list(softmax(add_trees(np.tile(start, (len(rows), 1)), rounds, rows))) if len(rows) else [], dtype=object)

        vector = F.array(*[F.col(c).cast("double") for c in self.columns])
        return with_prediction(df.withColumn("probability", chances(vector)))


def fit_boosted(
    train: DataFrame,
    columns: Sequence[str],
    classes: int,
    label: str = "label_index",
    weight: str | None = None,
    settings: Settings = Settings(),
    most_rows: int | None = None,
) -> Boosted:
    """Boost from the log of the class shares. Missing values have to be filled before."""
    columns, s = list(columns), settings
    rows = fit_rows(train, columns, label, weight, most_rows)
    shares = np.zeros(classes)
    for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect():
        shares[r["y"]] = r["w"]
    if not shares.sum():
        raise ValueError("no labelled rows to boost on")
    start = np.log(np.maximum(shares / shares.sum(), 1e-9))
    edges = bin_edges(rows, len(columns), s.bins)
    rows = materialize(rows.withColumn("score", F.array(*[F.lit(float(v)) for v in start])), "boost")
    rounds: list[list[StepTree]] = []
    losses: list[float] = []
    carried = 0
    width = max(len(e) for e in edges) + 1
    for number in range(s.rounds + 1):
        if number - carried == CARRY:
            rows, carried = _carry(rows, rounds[carried:], classes), number
        inner = 2**s.depth - 1
        trees = [StepTree(np.zeros(inner, np.int32), np.full(inner, np.inf), np.zeros(2**s.depth)) for _ in range(classes)]
        for level in range(s.depth):
            cells = np.zeros((classes, 2**level, len(columns), width, 3))
            found = histograms(rows, rounds[carried:], trees, level, edges, classes)
            c, *places, g, h, n = (column.to_numpy() for column in found.columns)
            whole, some = np.flatnonzero(c < 0)[0], np.flatnonzero(c >= 0)
            loss = float(g[whole] / h[whole])
            cells[c[some], places[0][some], places[1][some], places[2][some]] = np.stack([g, h, n], 1)[some]
            if not level:
                losses.append(loss)
                if number == s.rounds:
                    return Boosted(start, rounds, losses, columns, classes)
            _grow_level(trees, cells, edges, level, classes, s)
        rounds.append(trees)
    raise AssertionError("unreachable")


def _grow_level(trees: Sequence[StepTree], cells: np.ndarray, edges: Sequence[np.ndarray], level: int, classes: int, s: Settings) -> None:
    """Set the cuts of a level and the values of what lies below it: Newton's step, shrunk by the rate."""
    for c, taken in enumerate(choose_cuts(cells, edges, level, classes, s)):
        tree, span = trees[c], 2 ** (s.depth - level)
        for node in range(2**level):
            g, h, _ = cells[c, node, 0].sum(0)
            first = node * span
            if node not in taken:
                if cells[c, node, 0, :, 2].sum():
                    tree.value[first : first + span] = -s.rate * g / (h + s.hold)
                continue
            f, cut = taken[node]
            k = 2**level - 1 + node
            tree.feature[k], tree.cut[k] = f, cut
            left = cells[c, node, f, : np.searchsorted(edges[f], cut) + 1].sum(0)
            for half, (a, b) in enumerate((left[:2], (g - left[0], h - left[1]))):
                tree.value[first + half * span // 2 : first + (half + 1) * span // 2] = -s.rate * a / (b + s.hold)


def _carry(rows: DataFrame, rounds, classes: int) -> DataFrame:
    """Rows with the scores after further rounds, written once."""
    shared = rows.sparkSession.sparkContext.broadcast(list(rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = add_trees(matrix(batch.column("score")), shared.value, matrix(batch.column("x")))
                yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(list(score), pa.list_(pa.float64())))

    return materialize(rows.mapInArrow(run, rows.schema), "boost")
