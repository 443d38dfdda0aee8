"""Row filters, joins with checks, and keep-one-row operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from snapweave.schema import KEYS

INDEX_COLUMNS = ["Unnamed: 0", "index"]


class DuplicateKeys(ValueError):
    """A join side that must be unique on its keys is not."""


def drop_index_columns(df: DataFrame) -> DataFrame:
    return df.drop(*INDEX_COLUMNS)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere downstream; NaN would poison averages, maxima and counts."""
    return df.withColumns(
        {
            f.name: F.when(~F.isnan(f.name), F.col(f.name))
            for f in df.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        }
    )


def with_keys(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Drop rows that belong to no session (a missing key)."""
    return df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))


def coerce_timestamps(df: DataFrame, columns: Sequence[str] = ("snapshot_time", "timestamp")) -> DataFrame:
    """Text to timestamp, unreadable text to NULL; absent columns are skipped."""
    return df.withColumns(
        {c: F.try_to_timestamp(F.col(c).cast("string")) for c in columns if c in df.columns}
    )


def coerce_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to double, unreadable text and NaN to NULL; absent columns are skipped."""
    present = [c for c in columns if c in df.columns]
    out = df.withColumns({c: F.col(c).try_cast("double") for c in present})
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in present})


def keep_values(df: DataFrame, column: str, values: Sequence | DataFrame | None) -> DataFrame:
    """Keep rows whose ``column`` is listed; a table of values becomes a semi-join, None keeps all."""
    if values is None:
        return df
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(column)), column, "left_semi")
    return df.filter(F.col(column).isin(list(values)))


def drop_unlabelled(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(F.col(label).isNotNull())


def missing_label_count(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows_seen"),
        F.count_if(F.col(label).isNull()).alias("rows_without_label"),
    )


def check_unique(df: DataFrame, keys: Sequence[str] = KEYS, side: str = "right") -> None:
    """Raise if a key occurs twice: one aggregate that stops at the first repeat."""
    repeat = df.groupBy(*keys).count().filter("count > 1").limit(1).take(1)
    if repeat:
        raise DuplicateKeys(f"{side} side repeats key {tuple(repeat[0])[:-1]}")


def attach(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = KEYS,
    how: str = "left",
    validate: str | None = None,
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Equi-join on ``keys`` with an optional ``m:1`` / ``1:1`` check and suffixes for name clashes.

    No broadcast hint: the session side grows with the data, so its size decides,
    at run time.
    """
    keys = list(keys)
    if validate not in (None, "m:1", "1:1"):
        raise ValueError(f"unknown validation {validate!r}")
    if validate == "1:1":
        check_unique(left, keys, "left")
    if validate:
        check_unique(right, keys, "right")
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return left.join(with_keys(right, keys), keys, how)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First whole row per key. Spark keeps one row per key before the shuffle as well
    (window group limit), so a key with very many copies stays cheap."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rn = 1").drop("_rn")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return keep_first(df, keys, [F.col(c).desc_nulls_last() for c in order])


def first_sessions(df: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of the first ``n`` sessions in key order; ``n`` is the caller's run size."""
    chosen = df.select(*keys).distinct().orderBy(*keys).limit(n)
    return df.join(chosen, list(keys), "left_semi")


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def top_n(df: DataFrame, by: str, n: int, tiebreak: str) -> DataFrame:
    """Top-k report: highest ``by`` first, ties by name."""
    return df.orderBy(F.col(by).desc(), F.col(tiebreak)).limit(n)


def frequency(df: DataFrame, *columns: str, count: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(count)).orderBy(F.col(count).desc(), *columns)
