"""Bucketed cache, stateful stream, sketches kept per day, incremental components and workbooks as a data source."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F, types as T

from catalog.inputs import rationale, snapshots, table, with_tables
from catalog.model_queries import IN_TEST, train_of
from catalog.profile_queries import AT, CONFIG, PLAIN, plain_prompts, stub_scorer, workbook_bytes
from catalog.registry import query, r, sr
from snapweave.operators import aggregates as agg
from snapweave.operators import sketches as sk
from snapweave.operators import splits
from snapweave.plans import scoring as sc
from snapweave.plans import training
from snapweave.plans.incremental_pca import fit_incremental_pca
from snapweave.runtime import materialize, scratch_path
from snapweave.schema import KEYS, RATIONALE_SCHEMA
from snapweave.sources.bucketed_cache import BucketedCache
from snapweave.sources.workbooks import WorkbookSource
from snapweave.streaming.once import score_stream_once

# --- cache in buckets ------------------------------------------------------------------------------------------

_EARLIER = "('0x' || substr(prompt_hash, 1, 4))::BIGINT % 3 < 2"


@query(
    "io12_b7_bucketed_cache",
    with_tables(
        f"""SELECT session_key, prompt_hash, {_EARLIER} AS cached,
              CASE WHEN ('0x' || substr(prompt_hash, 1, 4))::BIGINT % 3 = 0 THEN 'second' WHEN {_EARLIER} THEN 'first' END AS label FROM plain""",
        "sess", extra=PLAIN,
    ),
)
def io12_bucketed(spark, sf):
    """Two appends, the second over a part of the first, compacted, and every prompt looked up."""
    prompts = materialize(sc.with_model(plain_prompts(spark, sf), CONFIG), "prompts")
    third = F.pmod(F.conv(F.substring("prompt_hash", 1, 4), 16, 10).cast("long"), F.lit(3))
    path = scratch_path(spark, "bucketed")
    cache = BucketedCache(spark, path.rsplit("/", 1)[1].replace("-", "_"), path)

    def rows(which, label, days):
        answer = {"label": F.lit(label), "rationale": F.lit(""), "key_evidence": F.lit("[]"), "raw": F.lit("{}")}
        added = (F.lit(AT) - F.make_dt_interval(F.lit(days))).cast("timestamp")
        return which.select(*sc.CACHE_KEY, *[v.alias(c) for c, v in answer.items()], added.alias("added_at"))

    cache.append(rows(prompts.filter(third < 2), "first", 2))
    cache.append(rows(prompts.filter(third == 0), "second", 1))
    cache.compact()
    cache.drop_before()
    found = materialize(cache.lookup(prompts).select("session_key", "prompt_hash", "cached", "label"), "found")
    spark.sql(f"DROP TABLE {cache._table(cache.version)}")
    return found


# --- a stream with state -----------------------------------------------------------------------------------------


@query(
    "b10_stateful_stream",
    with_tables("SELECT session_key, user_id, exercise_id, prompt_hash, label FROM plain_scored", "sess", extra=PLAIN),
)
def b10_stateful(spark, sf):
    """Every prompt arrives three times within the span, the third time after a restart; each is scored once."""
    root = scratch_path(spark, "stateful")
    prompts = materialize(plain_prompts(spark, sf), "prompts")

    def arrive(name, minutes):
        at = F.lit(AT) + F.make_dt_interval(mins=F.lit(minutes))
        prompts.withColumn("arrived_at", at.cast("timestamp")).write.parquet(f"{root}/in/{name}")

    def run():
        arriving = spark.readStream.schema(T.StructType([*prompts.schema.fields, T.StructField("arrived_at", T.TimestampType())])).option("maxFilesPerTrigger", 4).parquet(f"{root}/in/*")
        score_stream_once(arriving, stub_scorer, CONFIG, f"{root}/out", f"{root}/state", delay="1 hour").awaitTermination()

    arrive("first", 0)
    arrive("second", 10)
    run()
    arrive("third", 20)
    run()
    return spark.read.parquet(f"{root}/out/predictions").select("session_key", *KEYS, "prompt_hash", "label")


# --- sketches -----------------------------------------------------------------------------------------------------

POINTS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query(
    "a6_a17_a21_sketches",
    """SELECT event_type, count(*) AS rows, count(value) AS counted, TRUE AS ranks_within_error, TRUE AS distinct_within_error FROM events GROUP BY event_type""",
)
def daily_sketches(spark, sf):
    """One row of sketches per day and type, written, then merged over all days; held against exact ranks and counts."""
    events = table(spark, sf, "events")
    daily = materialize(sk.sketch_rows(events.withColumn("day", F.to_date("ts")), ["day", "event_type"], ["value"], ["user_id"]), "sketches")
    merged = sk.merged_sketches(daily, ["event_type"])
    found = materialize(sk.quantiles_of(merged, "value", POINTS, ["event_type"]), "quantiles")  # types times points
    ranks = _true_ranks(events, found)
    fair = ranks.groupBy("event_type").agg(
        F.bool_and((F.col("low") - sk.RANK_ERROR <= F.col("point")) & (F.col("point") <= F.col("high") + sk.RANK_ERROR)).alias("ranks_within_error")
    )
    counted = found.groupBy("event_type").agg(F.max("counted").alias("counted"))
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"))
    near = F.abs(sk.distinct_of(merged, "user_id") - F.col("exact")) <= 0.05 * F.col("exact")
    out = merged.join(exact, "event_type").select("event_type", "rows", near.alias("distinct_within_error"))
    return out.join(counted, "event_type").join(fair, "event_type")


def _true_ranks(events, found):
    """Share of a type's values below, and up to, each estimated quantile."""
    each = events.select("event_type", F.col("value").alias("v")).filter("v IS NOT NULL").join(F.broadcast(found), "event_type")
    return each.groupBy("event_type", "point").agg(F.avg((F.col("v") < F.col("value")).cast("int")).alias("low"), F.avg((F.col("v") <= F.col("value")).cast("int")).alias("high"))


@query("a6_a17_sketch_values")
def sketch_values(spark, sf):
    """The estimates themselves: quantiles and distinct users per event type, merged from daily sketches."""
    events = table(spark, sf, "events")
    daily = sk.sketch_rows(events.withColumn("day", F.to_date("ts")), ["day", "event_type"], ["value"], ["user_id"])
    merged = materialize(sk.merged_sketches(daily, ["event_type"]), "merged")
    values = sk.quantiles_of(merged, "value", POINTS, ["event_type"])
    return values.join(merged.select("event_type", sk.distinct_of(merged, "user_id").alias("users")), "event_type")


# --- incremental components --------------------------------------------------------------------------------------------

EMBEDDINGS = ["code_embedding", "task_embedding"]


def embedding_rows(spark, sf):
    return splits.split_by_user(snapshots(spark, sf, chars=False, embeddings=True))


def component_shares(spark, sf):
    """Per embedding: the incremental model, and the shares that the exact one explains."""
    train = materialize(train_of(embedding_rows(spark, sf)), "embedded")
    for column in EMBEDDINGS:
        dim = agg.embedding_dim(train, column, ["event_id"]).first()["dim"]
        exact = training.fit_embedding_pca(train, column, dim).stages[-1].explainedVariance.toArray().tolist()
        yield column, fit_incremental_pca(train, column, dim), exact


def _total_sql(column: str) -> str:
    return f"""SELECT '{column}' AS embedding, {sr('sum(v)', 'total', 6)}, TRUE AS near_exact FROM
        (SELECT i, var_samp(coalesce({column}[i], 0)) AS v FROM embedded, range(1, 65) d(i) WHERE NOT ({IN_TEST}) GROUP BY i)"""


@query("f14_incremental_pca", with_tables(" UNION ALL ".join(_total_sql(c) for c in EMBEDDINGS), "embedded"))
def f14_incremental(spark, sf):
    """Variance that the merged parts hold in all, and whether each component explains what the exact one does."""
    rows = [
        (column, float(model.total), all(abs(a - b) < 0.01 for a, b in zip(model.shares(), exact)))
        for column, model, exact in component_shares(spark, sf)
    ]
    found = spark.createDataFrame(rows, "embedding string, total double, near_exact boolean")
    return found.withColumn("total", r("total", 6))


@query("f14_incremental_scores")
def f14_scores(spark, sf):
    """Both embeddings of every snapshot on their 16 incremental components."""
    rows = embedding_rows(spark, sf)
    for column in EMBEDDINGS:
        dim = agg.embedding_dim(train_of(rows), column, ["event_id"]).first()["dim"]
        model = fit_incremental_pca(train_of(rows), column, dim)
        rows = model.apply(rows, column, f"{column}_pca")
    return rows.select("event_id", *KEYS, *[f"{c}_pca" for c in EMBEDDINGS])


# --- workbooks as a data source ------------------------------------------------------------------------------------------


@query("io3_workbook_source", with_tables("SELECT user_id, exercise_id, rationale, sess_stats, evidence FROM rationale", "rationale"))
def io3_source(spark, sf):
    """The notes written as workbooks, a few hundred rows each, and read back by ``format("workbooks")``."""
    folder = scratch_path(spark, "books")

    def write(batches):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            for at in range(0, len(batch), 300):
                name = f"{inner}/{uuid.uuid4().hex}"
                with system.open_output_stream(f"{name}.part") as out:
                    out.write(workbook_bytes(batch.iloc[at : at + 300]))
                yield pd.DataFrame({"name": [name]})

    # Only books that a finished task has named are read: a task that was run twice leaves the others as parts.
    books = materialize(rationale(spark, sf).mapInPandas(write, "name string"), "books")

    def publish(batches):
        from pyarrow import fs

        system = fs.FileSystem.from_uri(folder)[0] if "://" in folder else fs.LocalFileSystem()
        for batch in batches:
            for name in batch["name"]:
                if system.get_file_info(f"{name}.xlsx").type == fs.FileType.NotFound:
                    system.move(f"{name}.part", f"{name}.xlsx")
            yield batch

    materialize(books.mapInPandas(publish, "name string"), "published")
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbooks").schema(RATIONALE_SCHEMA).load(folder)
