"""Array columns: embedding clean-up and finite values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def finite_or_null(x: Column) -> Column:
    """NaN and both infinities become missing."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def clean_embedding(x: Column, dim: int) -> Column:
    """Exactly ``dim`` finite doubles: cut or padded with zeros, missing values are zeros."""
    values = F.coalesce(x.cast("array<double>"), F.array().cast("array<double>"))
    finite = F.transform(F.slice(values, 1, dim), lambda v: F.coalesce(finite_or_null(v), F.lit(0.0)))
    gap = F.greatest(F.lit(0), F.lit(dim) - F.size(values))
    return F.concat(finite, F.array_repeat(F.lit(0.0), gap))
