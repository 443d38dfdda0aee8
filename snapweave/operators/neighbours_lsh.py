"""Approximate k-nearest-neighbour join: random projections put near rows into the same buckets.

A row's bucket in one table is the cell of a few projections on random directions, each cut into steps of one
width; rows meet in any of several tables. The width is calibrated on a bounded sample, whose exact neighbours are
known, until the wanted share of them is met (with margin). Large buckets are cut into bounded blocks on both sides, so
none is dropped and none is one task. The exact join stays in ``neighbours``; ``recall`` measures this one against it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from snapweave.operators import neighbours as exact
from snapweave.operators.splits import draw
from snapweave.runtime import materialize
from snapweave.schema import KEYS

SAMPLE_TEST, SAMPLE_TRAIN = 200, 5_000


@dataclass(frozen=True)
class Projections:
    """``tables`` times ``size`` directions and offsets; ``width`` of a step, infinite for one bucket."""

    directions: np.ndarray  # features by tables * size
    offsets: np.ndarray
    tables: int
    width: float

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """A 64-bit bucket per row and table."""
        if not math.isfinite(self.width):
            return np.zeros((len(x), self.tables), np.int64)
        cells = np.floor(x @ self.directions / self.width + self.offsets).astype(np.int64)
        cells = cells.reshape(len(x), self.tables, -1)
        out = np.zeros(cells.shape[:2], np.uint64)
        for k in range(cells.shape[2]):  # a rolling hash: equal cells give equal buckets
            out = (out ^ cells[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.astype(np.int64)


def _sample(df: DataFrame, name: str, most: int) -> np.ndarray:
    rows = df.orderBy(draw("lsh", name), name).limit(most).select("_v").collect()
    return np.array([r["_v"] for r in rows], float)


def calibrate(test: np.ndarray, train: np.ndarray, k: int, tables: int, size: int, target: float, seed: int) -> Projections:
    """The narrowest width (doubling from half the k-th distance) at which the sample's recall reaches ``target``."""
    rng = np.random.default_rng(seed)
    dim = train.shape[1]
    directions, offsets = rng.normal(size=(dim, tables * size)), rng.random(tables * size)
    d2 = (test**2).sum(1)[:, None] + (train**2).sum(1)[None] - 2 * test @ train.T
    k = min(k, len(train))
    near = np.argsort(d2, axis=1, kind="stable")[:, :k]
    kth = np.sqrt(np.maximum(np.take_along_axis(d2, near, 1)[:, -1], 0))
    width = max(float(np.median(kth)) / 2, 1e-9)
    for _ in range(12):
        tried = Projections(directions, offsets, tables, width)
        a, b = tried.buckets(test), tried.buckets(train)
        met = (a[:, None, :] == b[near]).any(2)
        if met.mean() >= target:
            return tried
        width *= 1.5
    return Projections(directions, offsets, tables, math.inf)


def approximate_neighbours(
    test: DataFrame,
    train: DataFrame,
    features: Sequence[str],
    k: int = 5,
    label: str = "label",
    keys: Sequence[str] = KEYS,
    tables: int = 10,
    size: int = 4,
    target: float = 0.95,
    seed: int = 42,
    train_block: int = exact.TRAIN_BLOCK,
    test_block: int = exact.TEST_BLOCK,
) -> DataFrame:
    """As ``nearest_neighbours``, with about ``target`` of the true neighbours; a test row that meets fewer than k rows has fewer."""
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in keys])
    vector = F.array(*[F.col(c).cast("double") for c in features]).alias("_v")
    train = materialize(train.select(name.alias("_name"), F.col(label).alias("label"), vector), "lsh-train")
    test = materialize(test.select(name.alias("_test"), vector), "lsh-test")
    known = _sample(train, "_name", SAMPLE_TRAIN)
    if not len(known):
        raise ValueError("no train rows")
    asked = _sample(test, "_test", SAMPLE_TEST)
    if not len(asked):
        asked = known[:1]
    found = calibrate(asked, known, k, tables, size, target, seed)
    # A sample is thinner than the whole: its k-th neighbours are farther away, so the whole meets more of its own.
    shared = test.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("array<bigint>")
    def buckets(v: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.buckets(np.stack(v.to_numpy())))) if len(v) else pd.Series([], dtype=object)

    def spread(df: DataFrame) -> DataFrame:
        return df.select("*", F.posexplode(buckets("_v")).alias("table", "bucket"))

    where = ["table", "bucket", "block", "part"]
    sizes = spread(train).groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("n"))
    asked_sizes = spread(test).groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("m"))
    # Only buckets that both sides have; each with its numbers of blocks and parts.
    cuts = materialize(
        sizes.join(asked_sizes, ["table", "bucket"]).select(
            "table", "bucket", F.ceil(F.col("n") / train_block).cast("int").alias("blocks"), F.ceil(F.col("m") / test_block).cast("int").alias("parts")
        ),
        "buckets",
    )
    train_side = (
        spread(train).join(cuts, ["table", "bucket"])
        .withColumn("block", F.pmod(F.xxhash64("_name"), F.col("blocks")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(*where, "_name", "label", "_v")
    )
    cuts = cuts.select(*[F.col(c).alias(c) for c in cuts.columns])
    test_side = (
        spread(test).join(cuts, ["table", "bucket"])
        .withColumn("part", F.pmod(F.xxhash64("_test"), F.col("parts")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*where, "_test", "_v")
    )

    def search(t: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if t.empty or r.empty:
            texts = {c: pd.Series([], dtype=object) for c in ("_test", "_name", "label")}
            return pd.DataFrame(texts | {"distance": pd.Series([], dtype="float64")})
        return exact._nearest_in_block(t, r, k)

    candidates = test_side.groupBy(*where).cogroup(train_side.groupBy(*where)).applyInPandas(
        search, "_test string, _name string, label string, distance double"
    )
    # A pair may meet in several tables.
    once = candidates.groupBy("_test", "_name").agg(F.min("label").alias("label"), F.min("distance").alias("distance"))
    nearest = Window.partitionBy("_test").orderBy("distance", "_name")
    ranked = once.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return ranked.select(F.col("_test").alias("session"), "rank", "distance", F.col("_name").alias("neighbour"), "label")


def recall(approximate: DataFrame, exact_rows: DataFrame) -> DataFrame:
    """One row: ``found``, ``wanted`` and their share; a neighbour as near as the true one of its rank counts."""
    last = exact_rows.groupBy("session").agg(F.max("distance").alias("last"), F.count(F.lit(1)).alias("wanted"))
    hits = approximate.join(last, "session").filter(F.col("distance") <= F.col("last") * (1 + 1e-12)).groupBy("session").agg(F.count(F.lit(1)).alias("hits"))
    both = last.join(hits, "session", "left").agg(F.sum(F.least(F.coalesce("hits", F.lit(0)), F.col("wanted"))).alias("found"), F.sum("wanted").alias("wanted"))
    return both.select("found", "wanted", (F.col("found") / F.col("wanted")).alias("recall"))
