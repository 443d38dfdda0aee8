"""The answer cache as a bucketed table: a lookup shuffles its prompts only and reads only what may hold their keys.

Rows are kept by buckets of one key (the md5 of the four cache columns), sorted, with a Parquet bloom
filter on it. A join on the key takes the cache as it lies; few keys are sent as a filter, so that
Spark opens their buckets alone. Appends add files; ``compact`` writes the newest row of each key anew as the next version.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapweave.operators.tables import keep_last
from snapweave.plans.scoring import CACHE_KEY

KEY = "cache_key"
FEW_KEYS = 1_000  # looked up by a filter on the buckets


def with_cache_key(rows: DataFrame) -> DataFrame:
    """Add the key; null parts count as such and differ from empty ones."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in CACHE_KEY]
    return rows.withColumn(KEY, F.md5(F.concat(*parts).cast("binary")))


class BucketedCache:
    """A cache under ``folder``; ``name`` is its table in the session's catalog. One writer at a time."""

    def __init__(self, spark: SparkSession, name: str, folder: str, buckets: int = 64):
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"{name!r} is no table name")
        self.spark, self.name, self.folder, self.buckets = spark, name, folder.rstrip("/"), buckets
        self.version = 0

    def _table(self, version: int) -> str:
        return f"{self.name}_v{version}"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self._table(self.version))

    def table(self) -> DataFrame:
        return self.spark.table(self._table(self.version))

    def _write(self, rows: DataFrame, version: int) -> None:
        dealt = rows.repartition(self.buckets, KEY)
        writer = dealt.write.format("parquet").mode("append").bucketBy(self.buckets, KEY).sortBy(KEY)
        writer = writer.option(f"parquet.bloom.filter.enabled#{KEY}", "true").option("path", f"{self.folder}/v{version}")
        writer.saveAsTable(self._table(version))

    def append(self, rows: DataFrame) -> None:
        """Add cache rows (the cache columns, answer and ``added_at``)."""
        self._write(with_cache_key(rows), self.version)

    def newest(self) -> DataFrame:
        """The newest row of each key; buckets hold whole keys, so nothing is shuffled."""
        return keep_last(self.table(), [KEY], ["added_at", "label", "rationale", "raw"])

    def compact(self) -> None:
        """Only the newest rows, one file per bucket, as the next version. The former one stays until it is dropped."""
        self._write(self.newest(), self.version + 1)
        self.version += 1

    def drop_before(self) -> None:
        """Take the table of the version before out of the catalog; its files stay in the folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(self.version - 1)}")

    def lookup(self, prompts: DataFrame, columns: Sequence[str] = ("label", "rationale", "key_evidence", "raw")) -> DataFrame:
        """``prompts`` (with the cache columns) and, where the cache holds them, their newest answers; ``cached`` says which."""
        keyed = with_cache_key(prompts)
        cache = self.newest()
        few = [row[0] for row in keyed.select(KEY).distinct().limit(FEW_KEYS + 1).collect()]
        if len(few) <= FEW_KEYS:
            cache = keep_last(self.table().filter(F.col(KEY).isin(few)), [KEY], ["added_at", "label", "rationale", "raw"])
        found = cache.select(KEY, *columns, F.lit(True).alias("cached"))
        return keyed.join(found, KEY, "left").withColumn("cached", F.coalesce("cached", F.lit(False))).drop(KEY)
