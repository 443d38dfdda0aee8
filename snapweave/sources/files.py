"""Snapshot, label, rationale and prediction files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from snapweave.operators.tables import coerce_timestamps, drop_index_columns, nan_to_null
from snapweave.schema import LABEL_SCHEMA, PREDICTION_SCHEMA

# Text columns hold line breaks and doubled quotes, so records span lines.
_CSV = {"header": True, "escape": '"', "quote": '"'}


class MissingColumns(ValueError):
    """A table lacks columns that the job needs."""


def require(df: DataFrame, *columns: str) -> DataFrame:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise MissingColumns(f"missing columns {lacking}; the table has {df.columns[:30]}")
    return df


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    optional: Sequence[str] = (),
    multi_line: bool = True,
    file_column: str | None = None,
) -> DataFrame:
    """CSV with a header, columns taken by name in whatever order the file has them.

    The columns of ``schema`` come typed (a value that does not fit is missing); one that the
    file lacks raises :class:`MissingColumns`, unless it is ``optional`` and then missing
    throughout. Other columns follow as text, and without a schema all columns are text. All
    files of one read must have the same header, else Spark raises an error.

    With ``multi_line`` a record may span lines, and one file is one task; without it large
    files are split. ``file_column`` adds the path of each row's file under that name.
    """
    raw = spark.read.options(**_CSV, multiLine=multi_line, enforceSchema=False).csv(path)
    source = [F.col("_metadata.file_path").alias(file_column)] if file_column else []
    if schema is None:
        return raw.select("*", *source)
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    require(raw, *[f.name for f in fields if f.name not in optional])
    typed = [
        (F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in fields
    ]
    declared = {f.name for f in fields}
    return raw.select(*typed, *[c for c in raw.columns if c not in declared], *source)


def read_parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def read_snapshots(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, optional: Sequence[str] = ()
) -> DataFrame:
    """Snapshots from CSV (with ``schema``) or parquet: index columns dropped, times read, NaN to NULL."""
    df = read_csv(spark, path, schema, optional) if schema is not None else read_parquet(spark, path)
    require(df, "user_id", "exercise_id")
    return nan_to_null(coerce_timestamps(drop_index_columns(df)))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels by name; index and other columns are left out."""
    df = read_csv(spark, path, LABEL_SCHEMA)
    return df.select("user_id", "exercise_id", "label")


def read_session_table(spark: SparkSession, path: str, numeric_share: float = 0.5) -> DataFrame:
    """An extra table of one row per session whose columns are not known beforehand.

    A column counts as a number if at least ``numeric_share`` of its present values are one
    (others are then missing); the rest stays text. One pass decides for all columns.
    """
    df = drop_index_columns(read_csv(spark, path, "user_id string, exercise_id int"))
    others = [c for c in df.columns if c not in ("user_id", "exercise_id")]
    if not others:
        return df
    named = {c: f"`{c.replace('`', '``')}`" for c in others}
    shares = df.agg(
        *[
            F.coalesce(F.count(F.col(n).try_cast("double")) / F.nullif(F.count(F.col(n)), F.lit(0)), F.lit(0.0)).alias(f"s{i}")
            for i, n in enumerate(named.values())
        ]
    ).first()
    numbers = [c for i, c in enumerate(others) if shares[i] >= numeric_share]
    return df.withColumns({c: F.nanvl(F.col(named[c]).try_cast("double"), F.lit(None).cast("double")) for c in numbers})


def model_of_file(name: Column) -> Column:
    """Model part of a prediction file name; the plain name is the model ``default``."""
    # A file of that name, or a folder of that name that holds the parts.
    file = F.regexp_extract(name, r"([^/]+?)(\.csv)?(/part-[^/]*)?$", 1)
    base = F.regexp_replace(file, "%20", " ")
    named = F.regexp_extract(base, r"^llm_profile_predictions_(.+)$", 1)
    return (
        F.when(base == "llm_profile_predictions", F.lit("default"))
        .when(named != "", named)
        .otherwise(base)
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """All prediction files of a folder or glob in one scan, ``model`` taken from the file name.

    Only the keys must be there; a file without labels (a run that stopped early) gives null ones.
    """
    names = T._parse_datatype_string(PREDICTION_SCHEMA).fieldNames()
    extra = [c for c in names if c not in ("user_id", "exercise_id")]
    df = read_csv(spark, path, PREDICTION_SCHEMA, optional=extra, file_column="_file")
    return df.select(*names, "_file").withColumn("model", model_of_file(F.col("_file"))).drop("_file")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    """With ``compression`` (``gzip``) the files get that ending, by which :func:`read_csv` knows it."""
    df.write.mode(mode).options(header=True, quoteAll=True, escape='"', emptyValue="", compression=compression).csv(path)


def write_predictions(df: DataFrame, path: str, mode: str = "append") -> None:
    """Prediction rows, one folder per model."""
    df.write.mode(mode).partitionBy("model").parquet(path)


def write_features(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
