"""A stream of prompts scored once each: what was seen is kept in the state store and expires.

The state holds the keys of one watermark span, not the cache: a repeat within the span is dropped before
anything is read. Prompts that come back later may be answered from a bucketed cache, which opens the
buckets of the batch's keys only. State and progress lie under the checkpoint, so a restart goes on where the stream stopped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from snapweave.plans.scoring import ScorerConfig, ScorerFactory, cache_rows, call_scorer, parse_scored, prediction_rows, with_model
from snapweave.runtime import materialize
from snapweave.sources.bucketed_cache import BucketedCache

SEEN = ["session_key", "prompt_hash"]


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    """What an earlier try of the same batch has written whole."""
    try:
        done = spark.read.format("binaryFile").load(f"{path}/_SUCCESS")
        return spark.read.parquet(path) if not done.select("path").isEmpty() else None
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def score_stream_once(
    prompts: DataFrame,
    make_scorer: ScorerFactory,
    config: ScorerConfig,
    out: str,
    checkpoint: str,
    arrived: str = "arrived_at",
    delay: str = "1 hour",
    cache: BucketedCache | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Score the first arrival of each (session, prompt) within ``delay``; rows later than the watermark are dropped.

    Answers of micro-batch n are written to ``out/answers/batch=n`` before its predictions, and read back if the
    batch is run again after a failure, so the model is not called twice for it.
    """
    first = prompts.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(SEEN)

    def one_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = f"{out}/answers/batch={number}"
        results = _written(spark, path)
        if results is None:
            rows = with_model(batch, config)
            if cache is not None and cache.exists():
                rows = materialize(cache.lookup(rows), "looked_up")
                known = rows.filter("cached").withColumns({"response": F.col("raw"), "error": F.lit(None).cast("string")})
                known = known.withColumn("key_evidence", F.coalesce(F.from_json("key_evidence", "array<string>"), F.array().cast("array<string>")))
                rows = rows.filter("NOT cached").drop("label", "rationale", "key_evidence", "raw", "cached")
                fresh = parse_scored(materialize(call_scorer(rows, make_scorer, config), "answers"))
                fresh.unionByName(known).write.mode("overwrite").parquet(path)
            else:
                parse_scored(call_scorer(rows, make_scorer, config)).write.mode("overwrite").parquet(path)
            results = spark.read.parquet(path)
            if cache is not None:
                cache.append(cache_rows(results, F.current_timestamp()))
        prediction_rows(results).write.mode("overwrite").parquet(f"{out}/predictions/batch={number}")

    stream = first.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()
