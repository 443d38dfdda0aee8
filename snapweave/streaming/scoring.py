"""Scoring of sessions as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from snapweave.plans.scoring import (
    ScorerConfig,
    ScorerFactory,
    cache_rows,
    log_rows,
    prediction_rows,
    score_sessions,
)
from snapweave.runtime import materialize
from snapweave.sources.answers import append_cache, append_log, read_cache
from snapweave.sources.files import write_predictions


def score_stream(
    prompts: DataFrame,
    make_scorer: ScorerFactory,
    config: ScorerConfig,
    out: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Score a stream of prompts into ``out``/cache, log and predictions.

    The cache is written first: if a micro-batch is run again after a failure, its
    prompts are found there and the model is not called twice. Predictions go to one
    folder per micro-batch, which the repeat overwrites; the log is appended and read by
    its newest entry per session.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cache = read_cache(spark, f"{out}/cache")
        # One row per prompt also when the source delivers it twice.
        unique = batch.dropDuplicates(["session_key", "prompt_hash"])
        results = materialize(score_sessions(unique, cache, make_scorer, config), "results")
        now = F.current_timestamp()
        append_cache(cache_rows(results, now), f"{out}/cache")
        append_log(log_rows(results, now), f"{out}/log")
        write_predictions(prediction_rows(results), f"{out}/predictions/batch={number}", "overwrite")

    stream = prompts.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()
