"""Row selection and column roles inside sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from snapweave.operators.ordering import HOT_ROWS, POS, SIZE, number_rows, prompt_order
from snapweave.schema import (
    ID_AND_TIME_COLUMNS,
    KEYS,
    MAX_FEATURES_PER_BLOCK,
    MAX_SNAPSHOTS,
    TEXT_BLOB_COLUMNS,
)


def is_kept_position(pos: Column, n: Column, m: int) -> Column:
    """Is ``pos`` one of the m evenly spaced positions of 0..n-1 (first and last included)?

    Position k/(m-1) of the way is rounded half-even; the last one is exactly n-1.
    """
    if m < 1:
        raise ValueError("at least one row per session must be kept")
    if m == 1:
        return pos == 0
    step = F.greatest(n - 1, F.lit(1)) / F.lit(float(m - 1))
    # Only the two grid points next to pos can round to it.
    near = F.floor(pos / step)

    def hits(k: Column) -> Column:
        target = F.when(k == m - 1, n - 1).otherwise(F.rint(k * step).cast("long"))
        return k.between(0, m - 1) & (target == pos)

    return (n <= m) | hits(near) | hits(near + 1) | hits(near - 1)


def downsample(
    df: DataFrame,
    m: int = MAX_SNAPSHOTS,
    order: Sequence[Column] | None = None,
    keys: Sequence[str] = KEYS,
    hot_rows: int | None = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """At most ``m`` evenly spaced rows per session; ``_pos`` and ``_n`` are those before the cut."""
    numbered = number_rows(df, keys, order or prompt_order(df), hot_rows=hot_rows, counted=counted)
    return numbered.filter(is_kept_position(F.col(POS), F.col(SIZE), m))


def feature_columns(df: DataFrame, ignore: Sequence[str] = ID_AND_TIME_COLUMNS) -> list[str]:
    skip = {*ignore, *TEXT_BLOB_COLUMNS, POS, SIZE}
    scalar = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, scalar)]


def role_ranges(columns: Sequence[str]) -> list[Column]:
    """Aggregates from which :func:`role_names` tells constant from varying columns."""
    return [
        agg(c).alias(f"_{name}_{i}")
        for i, c in enumerate(columns)
        for name, agg in (("lo", F.min), ("hi", F.max))
    ]


def role_names(columns: Sequence[str], cap: int = MAX_FEATURES_PER_BLOCK) -> list[Column]:
    """``session_cols`` (constant) and ``snapshot_cols`` (varying), in column order.

    A column varies if its smallest and largest value differ, which needs no distinct
    count; all-missing columns are in neither list.
    """

    def names(test) -> Column:
        picked = [
            F.when(test(F.col(f"_lo_{i}"), F.col(f"_hi_{i}")), F.lit(c)) for i, c in enumerate(columns)
        ]
        listed = F.array_compact(F.array(*picked)) if picked else F.array().cast("array<string>")
        return F.slice(listed, 1, cap)

    return [
        names(lambda lo, hi: lo == hi).alias("session_cols"),
        names(lambda lo, hi: lo != hi).alias("snapshot_cols"),
    ]


def column_roles(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
    cap: int = MAX_FEATURES_PER_BLOCK,
) -> DataFrame:
    """Names of the constant and of the varying columns of each session."""
    columns = list(columns if columns is not None else feature_columns(df))
    return df.groupBy(*keys).agg(*role_ranges(columns)).select(*keys, *role_names(columns, cap))
