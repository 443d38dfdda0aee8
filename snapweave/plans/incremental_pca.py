"""Principal components from mergeable parts: the mode for data of which no covariance is kept.

A part is the number of rows, their mean and their ``k`` main directions scaled by spread. Rows are taken in blocks
of ``BLOCK``; a part and a block, or two parts, merge by one small singular value decomposition that also holds the
difference of their means. Tasks return one part each, Spark merges them ``FAN`` at a time, and what the driver gets is
one part of ``k`` rows. Directions beyond ``k`` are dropped at each step, as in any incremental fit; with ``k`` equal to the
width nothing is dropped and the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from snapweave.functions.vectors import clean_embedding
from snapweave.plans.fit_rows import matrix
from snapweave.runtime import materialize

BLOCK = 1_024
FAN = 16
_PART = "part int, n bigint, mean array<double>, spread array<double>, squares double"


@dataclass
class Part:
    n: int
    mean: np.ndarray
    spread: np.ndarray  # directions times singular values, at most k rows
    squares: float  # of all deviations from the mean, dropped directions included

    @classmethod
    def of_rows(cls, x: np.ndarray, k: int) -> Part:
        mean = x.mean(0)
        return cls(len(x), mean, _main(x - mean, k), float(((x - mean) ** 2).sum()))

    def merge(self, other: Part, k: int) -> Part:
        n = self.n + other.n
        apart = self.mean - other.mean
        bridge = np.sqrt(self.n * other.n / n) * apart
        mean = (self.n * self.mean + other.n * other.mean) / n
        rows = np.vstack([self.spread, other.spread, bridge[None]])
        return Part(n, mean, _main(rows, k), self.squares + other.squares + float(bridge @ bridge))


def _main(rows: np.ndarray, k: int) -> np.ndarray:
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return (s[:, None] * v)[:k]


@dataclass
class IncrementalPca:
    mean: np.ndarray
    components: np.ndarray  # k rows; the largest loading of each is positive
    variance: np.ndarray
    total: float
    dim: int

    def shares(self) -> list[float]:
        """Explained share of the variance by component."""
        return (self.variance / self.total).tolist() if self.total > 0 else [0.0] * len(self.variance)

    def apply(self, df: DataFrame, column: str, out: str) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.mean, self.components))  # k + 1 rows

        @F.pandas_udf("array<double>")
        def scores(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            mean, components = shared.value
            return pd.Series(list((np.stack(x.to_numpy()) - mean) @ components.T))

        return df.withColumn(out, scores(clean_embedding(F.col(column), self.dim)))


def _rows_of(parts: list[tuple[int, Part]]) -> pd.DataFrame:
    return pd.DataFrame(
        [(number, p.n, p.mean.tolist(), p.spread.ravel().tolist(), p.squares) for number, p in parts], columns=["part", "n", "mean", "spread", "squares"]
    )


def _merge_rows(rows: pd.DataFrame, k: int) -> Part | None:
    out = None
    for row in rows.sort_values("part").itertuples(index=False):
        mean = np.array(row.mean)
        part = Part(int(row.n), mean, np.array(row.spread).reshape(-1, len(mean)), float(row.squares))
        out = part if out is None else out.merge(part, k)
    return out


def fit_incremental_pca(train: DataFrame, column: str | Column, dim: int, components: int = 16, block: int = BLOCK) -> IncrementalPca | None:
    """None if there are fewer than three rows or no dimension, as for the exact fit."""
    if dim <= 0:
        return None
    source = F.col(column) if isinstance(column, str) else column
    k = min(components, dim)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting = None, np.zeros((0, dim))
        for batch in batches:
            waiting = np.vstack([waiting, matrix(batch.column("x"))]) if batch.num_rows else waiting
            while len(waiting) >= block:
                own, waiting = Part.of_rows(waiting[:block], k), waiting[block:]
                part = own if part is None else part.merge(own, k)
        if len(waiting):
            own = Part.of_rows(waiting, k)
            part = own if part is None else part.merge(own, k)
        if part is not None:
            yield pa.RecordBatch.from_pandas(_rows_of([(TaskContext.get().partitionId(), part)]), preserve_index=False, schema=types)

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _rows_of([(int(key[0]), _merge_rows(rows, k))])

    numbers = pa.list_(pa.float64())
    types = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("mean", numbers), ("spread", numbers), ("squares", pa.float64())])
    parts = materialize(train.select(clean_embedding(source, dim).alias("x")).mapInArrow(blocks, _PART), "parts")
    tasks = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while tasks > FAN:  # at most FAN parts in one group, and then on the driver
        parts = parts.groupBy(F.expr(f"part div {FAN}").alias("group")).applyInPandas(merge, _PART)
        tasks = -(-tasks // FAN)
    whole = _merge_rows(parts.toPandas(), k)
    if whole is None or whole.n < 3:
        return None
    k = min(k, whole.n - 1)
    spread = whole.spread[:k]
    s = np.linalg.norm(spread, axis=1)
    v = spread / np.maximum(s[:, None], 1e-300)
    v *= np.where(v[np.arange(len(v)), np.abs(v).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return IncrementalPca(whole.mean, v, s**2 / (whole.n - 1), whole.squares / (whole.n - 1), dim)
