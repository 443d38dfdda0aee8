"""Answer cache and response log: append-only tables, read as their newest rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from snapweave.operators.tables import keep_last
from snapweave.schema import CACHE_SCHEMA, LOG_SCHEMA


def _read_or_empty(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    empty = spark.createDataFrame([], schema)
    if path is None:
        return empty
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty


def read_cache(spark: SparkSession, path: str | None) -> DataFrame:
    """The cache, or an empty table of the same columns if nothing was written yet."""
    return _read_or_empty(spark, path, CACHE_SCHEMA)


def append_cache(rows: DataFrame, path: str) -> None:
    """One append per batch; lookups prune to the (provider, model) folder."""
    rows.write.mode("append").partitionBy("provider", "model").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("model").parquet(path)


def read_log(spark: SparkSession, path: str | None) -> DataFrame:
    return _read_or_empty(spark, path, LOG_SCHEMA)


def current_log(log: DataFrame) -> DataFrame:
    """Last entry per model and session."""
    return keep_last(log, ["model", "session_key"], ["logged_at", "response"])


def log_entries(log: DataFrame, model: str | None = None, session_key: str | None = None) -> DataFrame:
    """Current entries of one or all models and one or all sessions."""
    if model is not None:
        log = log.filter(F.col("model") == model)
    if session_key is not None:
        log = log.filter(F.col("session_key") == session_key)
    return current_log(log)
