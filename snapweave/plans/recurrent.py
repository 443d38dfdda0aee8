"""A gated recurrent classifier over padded sequences.

All labelled sequences are fit rows, written once; padded steps are masked, so the state stops at the
last real one. Each training step is one Spark pass: tasks run the net forward and backward in numpy over their own rows and give back one summed gradient, Spark adds these up,
and the driver takes one step of Adam. Training stops when the loss on validation users has not
improved for ``patience`` steps; the best weights are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from snapweave.plans.boosting import softmax
from snapweave.plans.extra_trees import with_prediction
from snapweave.runtime import materialize
from snapweave.schema import KEYS

Weights = dict[str, np.ndarray]


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def first_weights(inputs: int, hidden: int, classes: int, seed: int) -> Weights:
    rng = np.random.default_rng(seed)

    def uniform(a: int, b: int) -> np.ndarray:
        return rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))

    # The three gates side by side: update, reset, candidate.
    return {
        "in": uniform(inputs, 3 * hidden),
        "state": np.hstack([np.linalg.qr(rng.normal(size=(hidden, hidden)))[0] for _ in range(3)]),
        "bias": np.zeros(3 * hidden),
        "out": uniform(hidden, classes),
        "out_bias": np.zeros(classes),
    }


def forward(net: Weights, x: np.ndarray, lengths: np.ndarray):
    """Class probabilities and what the way back needs. ``x``: rows, steps, inputs; steps from ``lengths`` on are masked."""
    rows, steps, _ = x.shape
    hidden = net["state"].shape[0]
    h = np.zeros((rows, hidden))
    kept = []
    for t in range(int(lengths.max(initial=0))):
        live = (t < lengths)[:, None]
        a = x[:, t] @ net["in"] + net["bias"]
        u = h @ net["state"][:, : 2 * hidden]
        update, reset = sigmoid(a[:, :hidden] + u[:, :hidden]), sigmoid(a[:, hidden : 2 * hidden] + u[:, hidden:])
        candidate = np.tanh(a[:, 2 * hidden :] + (reset * h) @ net["state"][:, 2 * hidden :])
        kept.append((h, update, reset, candidate, live))
        h = np.where(live, update * h + (1 - update) * candidate, h)
    return softmax(h @ net["out"] + net["out_bias"]), h, kept


def loss_and_gradient(net: Weights, x: np.ndarray, lengths: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, Weights]:
    """Weighted sum of log losses and its gradient, backward through the masked steps."""
    p, h, kept = forward(net, x, lengths)
    hidden = h.shape[1]
    loss = float(-(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum())
    d = p.copy()
    d[np.arange(len(y)), y] -= 1
    d *= w[:, None]
    grad = {k: np.zeros_like(v) for k, v in net.items()}
    grad["out"], grad["out_bias"] = h.T @ d, d.sum(0)
    dh = d @ net["out"].T
    for t in range(len(kept) - 1, -1, -1):
        before, update, reset, candidate, live = kept[t]
        now = np.where(live, dh, 0.0)
        d_candidate = now * (1 - update) * (1 - candidate**2)
        d_update = now * (before - candidate) * update * (1 - update)
        through = d_candidate @ net["state"][:, 2 * hidden :].T
        d_reset = through * before * reset * (1 - reset)
        d_gates = np.hstack([d_update, d_reset, d_candidate])
        grad["in"] += x[:, t].T @ d_gates
        grad["bias"] += d_gates.sum(0)
        grad["state"][:, : 2 * hidden] += before.T @ d_gates[:, : 2 * hidden]
        grad["state"][:, 2 * hidden :] += (reset * before).T @ d_candidate
        dh = np.where(live, now * update + through * reset + d_gates[:, : 2 * hidden] @ net["state"][:, : 2 * hidden].T, dh)
    return loss, grad


def flat(net: Weights) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in sorted(net)])


def shaped(values: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def sequences(batch: pa.RecordBatch, inputs: int) -> np.ndarray:
    """The padded column ``x`` (flattened steps) as rows, steps, inputs."""
    values = np.asarray(batch.column("x").flatten())
    return values.reshape(batch.num_rows, -1, inputs)


@dataclass
class Recurrent:
    net: Weights
    inputs: int
    losses: list[tuple[float, float]] = field(default_factory=list)  # training, validation, per step

    def predict(self, df: DataFrame, sequence: str = "sequence", length: str = "length") -> DataFrame:
        """Add ``probability`` and ``prediction`` for every row of ``df``."""
        shared, inputs = df.sparkSession.sparkContext.broadcast(self.net), self.inputs

        @F.pandas_udf("array<double>")
        def chances(x, n):
            import pandas as pd

            if not len(x):
                return pd.Series([], dtype=object)
            rows = np.stack(x.to_numpy()).reshape(len(x), -1, inputs)
            return pd.Series(list(forward(shared.value, rows, n.to_numpy())[0]))

        return with_prediction(df.withColumn("probability", chances(F.flatten(sequence), F.col(length).cast("long"))))


def _gradient_sums(rows: DataFrame, net: Weights, inputs: int, chunk: int = 512) -> tuple[np.ndarray, float, float, float, float]:
    """Summed gradient, loss and weight of the training rows; loss and weight of the validation rows."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(net)
    size = len(flat(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 4)
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                some = batch.slice(at, chunk)
                x, n = sequences(some, inputs), np.asarray(some.column("n"))
                y, w, held = (np.asarray(some.column(c)) for c in ("y", "w", "held"))
                mine = held == 0
                if mine.any():
                    loss, grad = loss_and_gradient(shared.value, x[mine], n[mine], y[mine], w[mine])
                    total[:size] += flat(grad)
                    total[size : size + 2] += loss, w[mine].sum()
                if not mine.all():
                    p = forward(shared.value, x[~mine], n[~mine])[0]
                    total[size + 2 :] += -(np.log(np.maximum(p[np.arange(len(p)), y[~mine]], 1e-300))).sum(), len(p)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    # One array per task, whatever its rows; the sums are one small vector.
    parts = rows.mapInArrow(run, "sums array<double>").select(array_to_vector("sums").alias("sums"))
    sums = parts.select(Summarizer.sum(F.col("sums")).alias("sums")).first()["sums"].toArray()
    shared.destroy()
    return (sums[:size], *sums[size:].tolist())


def fit_recurrent(
    train: DataFrame,
    inputs: int,
    classes: int,
    held: str | None = None,
    sequence: str = "sequence",
    length: str = "length",
    label: str = "label_index",
    weight: str | None = None,
    hidden: int = 32,
    steps: int = 120,
    rate: float = 0.01,
    patience: int = 15,
    seed: int = 42,
    most_rows: int | None = None,
    keys: Sequence[str] = KEYS,
) -> Recurrent:
    """Fit on the rows where ``held`` (a boolean column: validation users) is not true, and stop by the others."""
    rows = train.filter(F.col(label).isNotNull())
    if most_rows is not None and (n := rows.count()) > most_rows:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("fit"), *keys), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))
    rows = materialize(
        rows.select(
            F.flatten(sequence).alias("x"),
            F.col(length).cast("long").alias("n"),
            F.col(label).cast("int").alias("y"),
            (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
            (F.coalesce(F.col(held), F.lit(False)).cast("int") if held else F.lit(0)).alias("held"),
        ),
        "sequences",
    )
    net = first_weights(inputs, hidden, classes, seed)
    first, second = np.zeros(len(flat(net))), np.zeros(len(flat(net)))
    best, best_net, waited = np.inf, net, 0
    losses = []
    for step in range(1, steps + 1):
        grad, loss, total, held_loss, held_n = _gradient_sums(rows, net, inputs)
        if not total:
            raise ValueError("no labelled rows to fit on")
        judged = held_loss / held_n if held_n else loss / total
        losses.append((loss / total, judged))
        if judged < best - 1e-5:
            best, best_net, waited = judged, net, 0
        else:
            waited += 1
            if waited >= patience:
                break
        grad = grad / total
        grad *= min(1.0, 5.0 / max(float(np.linalg.norm(grad)), 1e-12))
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        net = shaped(flat(net) - move, net)
    return Recurrent(best_net, inputs, losses)
