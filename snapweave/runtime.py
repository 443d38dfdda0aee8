"""Where intermediate results are written so that a lost executor cannot change them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_root: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A local session that names none gets a temporary folder; on a cluster a
    machine-local folder would not be seen by the other machines, so the setting
    is required there.
    """
    global _local_root
    configured = spark.conf.get(_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
        raise RuntimeError(f"set {_SETTING} to a folder that every executor can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="snapweave-")
    return _local_root


def scratch_path(spark: SparkSession, name: str = "stage") -> str:
    return f"{shared_folder(spark)}/snapweave/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage", compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``compression`` other than the session's for long texts.

    Cuts the lineage: everything after it sees the same rows even where the rows
    came from a step that a retry could repeat differently (sampled range bounds,
    a paid model call).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
