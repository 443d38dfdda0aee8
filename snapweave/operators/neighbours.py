"""Exact k-nearest-neighbour join and vote.

Train rows are assigned to their nearest pivot and cut into blocks of bounded size.
A test row visits only the pivots whose cell can hold one of its k nearest (triangle
inequality and the bisecting plane between pivots), so no pair table is ever built:
each visit leaves at most k rows. Both sides of a block are bounded, so a cell that
holds a third of the train rows is simply more blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from snapweave.operators.splits import draw
from snapweave.runtime import materialize
from snapweave.schema import KEYS

TRAIN_BLOCK = 20_000
TEST_BLOCK = 50_000
_CHUNK = 256


def pivot_count(train_rows: int) -> int:
    """Pivots for so many train rows: a quarter of their root, from 32 to 512."""
    return min(512, max(32, math.isqrt(train_rows) // 4))


def neighbour_count(train_rows: int, wanted: int = 5) -> int:
    return min(wanted, train_rows)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64)


def _distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.column_stack([np.sqrt(((a - p) ** 2).sum(axis=1)) for p in pivots])


def _nearest_in_block(test: pd.DataFrame, train: pd.DataFrame, k: int) -> pd.DataFrame:
    """Up to k nearest train rows for every test row of one bounded block pair.

    A matrix product finds all rows that may be among the k nearest within rounding;
    their distances are then computed exactly.
    """
    b, names, labels = _matrix(train["_v"]), train["_name"].to_numpy(), train["label"].to_numpy()
    b2 = (b**2).sum(axis=1)
    k = min(k, len(b))
    found = []
    all_tests = _matrix(test["_v"])
    ids = test["_test"].to_numpy()
    for start in range(0, len(all_tests), _CHUNK):
        a = all_tests[start : start + _CHUNK]
        a2 = (a**2).sum(axis=1)
        rough = a2[:, None] + b2[None, :] - 2.0 * (a @ b.T)
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * (a2 + b2.max() + 1.0)
        rows, cols = np.nonzero(rough <= (kth + slack)[:, None])
        exact = np.sqrt(((a[rows] - b[cols]) ** 2).sum(axis=1))
        order = np.lexsort((names[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.searchsorted(rows, rows, side="left")
        keep = np.arange(len(rows)) - first < k
        found.append(
            pd.DataFrame(
                {
                    "_test": ids[start + rows[keep]],
                    "_name": names[cols[keep]],
                    "label": labels[cols[keep]],
                    "distance": exact[keep],
                }
            )
        )
    return pd.concat(found, ignore_index=True)


def nearest_neighbours(
    test: DataFrame,
    train: DataFrame,
    features: Sequence[str],
    k: int = 5,
    label: str = "label",
    keys: Sequence[str] = KEYS,
    pivots: int | None = None,
    train_block: int = TRAIN_BLOCK,
    test_block: int = TEST_BLOCK,
) -> DataFrame:
    """The k nearest train rows of each test row: keys, ``rank``, ``distance``, ``label``, ``neighbour``.

    ``features`` hold no missing values; equal distances are ordered by train key.
    """
    keys = list(keys)
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in keys])
    vector = F.array(*[F.col(c).cast("double") for c in features]).alias("_v")
    train = train.select(name.alias("_name"), F.col(label).alias("label"), vector)
    test = test.select(name.alias("_test"), vector)

    # The pivots are the train rows with the smallest hash.
    pivots = pivots or pivot_count(train.count())
    picked = train.orderBy(draw("pivot", "_name"), "_name").limit(pivots).select("_v").collect()
    if not picked:
        raise ValueError("no train rows")
    centre = np.array([r["_v"] for r in picked], dtype=np.float64)
    count = len(centre)

    @F.pandas_udf("struct<cell:int,reach:double>")
    def home(v: pd.Series) -> pd.DataFrame:
        d = _distances(_matrix(v), centre)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "reach": d[np.arange(len(d)), cell]})

    assigned = train.withColumn("_home", home("_v")).select("*", "_home.cell", "_home.reach").drop("_home")
    assigned = materialize(assigned, "cells")
    # One row per pivot, plus its k closest members: at most pivots x k rows.
    cells = {
        r["cell"]: r
        for r in assigned.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("reach").alias("lo"), F.max("reach").alias("hi"))
        .collect()
    }
    closest = Window.partitionBy("cell").orderBy("reach")
    members = (
        assigned.select("cell", "reach", F.row_number().over(closest).alias("r"))
        .filter(F.col("r") <= k)
        .collect()
    )
    near = np.full((count, k), np.inf)
    for m in members:
        near[m["cell"], m["r"] - 1] = m["reach"]
    low = np.array([cells[j]["lo"] if j in cells else np.inf for j in range(count)])
    high = np.array([cells[j]["hi"] if j in cells else -np.inf for j in range(count)])
    blocks = [math.ceil(cells[j]["n"] / train_block) if j in cells else 0 for j in range(count)]
    between = _distances(centre, centre)

    @F.pandas_udf("array<int>")
    def visits(v: pd.Series) -> pd.Series:
        d = _distances(_matrix(v), centre)
        own = d.argmin(axis=1)
        reachable = (d[:, :, None] + near[None, :, :]).reshape(len(d), -1)
        bound = np.partition(reachable, k - 1, axis=1)[:, k - 1]
        bound = bound * (1 + 1e-9) + 1e-9
        floor_ = np.maximum(d - high[None, :], low[None, :] - d)
        gap = between[own]
        plane = np.where(
            gap > 0, (d**2 - (d[np.arange(len(d)), own] ** 2)[:, None]) / np.where(gap > 0, 2 * gap, 1), 0.0
        )
        lower = np.maximum(floor_, plane)
        wanted = (lower <= bound[:, None]) & np.isfinite(low)[None, :]
        return pd.Series([np.nonzero(w)[0].astype("int32") for w in wanted])

    test_parts = max(1, math.ceil(test.count() / test_block))
    block_count = F.array(*[F.lit(b) for b in blocks])
    asked = test.withColumn("part", F.pmod(F.xxhash64("_test"), F.lit(test_parts)).cast("int"))
    asked = materialize(asked.withColumn("_visits", visits("_v")), "visits")
    test_side = (
        asked.withColumn("cell", F.explode("_visits"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), block_count[F.col("cell")] - 1)))
        .select("cell", "block", "part", "_test", "_v")
    )
    # A block of train rows goes only to the parts with a row that visits its cell.
    visited = test_side.select(*[F.col(c).alias(f"_{c}") for c in ("cell", "block", "part")]).distinct()
    train_side = (
        assigned.withColumn("block", F.pmod(F.xxhash64("_name"), block_count[F.col("cell")]).cast("int"))
        .join(visited, (F.col("cell") == F.col("_cell")) & (F.col("block") == F.col("_block")))
        .select("cell", "block", F.col("_part").alias("part"), "_name", "label", "_v")
    )

    def search(t: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if t.empty or r.empty:
            texts = {c: pd.Series([], dtype=object) for c in ("_test", "_name", "label")}
            return pd.DataFrame(texts | {"distance": pd.Series([], dtype="float64")})
        return _nearest_in_block(t, r, k)

    where = ["cell", "block", "part"]
    candidates = (
        test_side.groupBy(*where)
        .cogroup(train_side.groupBy(*where))
        .applyInPandas(search, "_test string, _name string, label string, distance double")
    )
    nearest = Window.partitionBy("_test").orderBy("distance", "_name")
    ranked = candidates.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return ranked.select(
        F.col("_test").alias("session"), "rank", "distance", F.col("_name").alias("neighbour"), "label"
    )


def vote(neighbours: DataFrame) -> DataFrame:
    """Majority label per test row; equal counts go to the alphabetically first label."""
    counts = neighbours.groupBy("session", "label").agg(F.count(F.lit(1)).alias("votes"))
    return counts.groupBy("session").agg(
        F.min_by("label", F.struct((-F.col("votes")).alias("v"), "label")).alias("pred_label"),
        F.max("votes").alias("votes"),
    )
