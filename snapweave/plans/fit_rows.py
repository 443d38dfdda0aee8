"""Rows that models are fitted on: all labelled rows as feature arrays, written once and read by every pass.

Every statistic of a pass is summed per task with numpy and added up by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from snapweave.runtime import materialize
from snapweave.schema import KEYS


def fit_rows(
    train: DataFrame,
    columns: Sequence[str],
    label: str = "label_index",
    weight: str | None = None,
    most: int | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """``x`` (array of doubles), ``y`` (class number), ``w``, ``id``: all rows with a label; about ``most`` of them only where the caller asks for that."""
    rows = train.filter(F.col(label).isNotNull())
    if most is not None and (n := rows.count()) > most:
        drawn = F.pmod(F.xxhash64(F.lit("fit"), *keys), F.lit(1_000_000))
        rows = rows.filter(drawn < int(1_000_000 * most / n))
    return materialize(
        rows.select(
            F.array(*[F.col(c).cast("double") for c in columns]).alias("x"),
            F.col(label).cast("int").alias("y"),
            (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
            F.monotonically_increasing_id().alias("id"),
        ),
        "fit",
    )


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column as rows by values."""
    n = len(column)
    return np.asarray(column.flatten()).reshape(n, -1) if n else np.zeros((0, 0))


def list_column(rows: np.ndarray) -> pa.Array:
    """The reverse of ``matrix``."""
    n, wide = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * wide + 1, max(wide, 1), dtype=np.int32)[: n + 1]), pa.array(np.ascontiguousarray(rows).ravel()))


def read_rows(files: Sequence[str], n: int, columns: int) -> tuple[np.ndarray, ...]:
    """``x``, ``y``, ``w``, ``id`` of all ``n`` fit rows in files of the shared folder, in the order of the list."""
    x, y, w, ids = np.empty((n, columns)), np.empty(n, np.int64), np.empty(n), np.empty(n, np.int64)
    at = 0
    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(16_384, columns=["x", "y", "w", "id"], use_threads=False):
                end = at + batch.num_rows
                if batch.num_rows:
                    x[at:end] = matrix(batch.column("x"))
                    y[at:end], w[at:end], ids[at:end] = (np.asarray(batch.column(c)) for c in ("y", "w", "id"))
                at = end
    if at != n:
        raise RuntimeError(f"{at} fit rows were read, not {n}")
    return x, y, w, ids
