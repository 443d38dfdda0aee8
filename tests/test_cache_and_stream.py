"""Bucketed cache, calls under a policy, the stateful stream, sketches and incremental components."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapweave.functions.text import short_hash
from snapweave.operators import sketches as sk
from snapweave.plans import scoring as sc
from snapweave.plans.calls import Caller, CallPolicy, TokenBucket
from snapweave.plans.incremental_pca import Part, fit_incremental_pca
from snapweave.sources.bucketed_cache import KEY, BucketedCache, with_cache_key
from snapweave.streaming.once import score_stream_once

CONFIG = sc.ScorerConfig("stub", "m", parallel_calls=2)
ANSWER = '{"label":"strategy_shifter"}'


# --- calls ---


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def test_bucket_keeps_the_rate():
    clock = Clock()
    bucket, times = TokenBucket(2.0, 3, clock, clock.sleep), []
    for _ in range(9):
        bucket.take()
        times.append(clock.now)
    assert times[:3] == [0.0] * 3 and np.allclose(np.diff(times[2:]), 0.5)
    clock.now += 100
    bucket.take(), bucket.take(), bucket.take()
    assert clock.now == times[-1] + 100  # a rest allows a burst again, not more
    bucket.take()
    assert clock.now == pytest.approx(times[-1] + 100.5)


def test_share_of_a_task():
    clock = Clock()
    list(Caller(lambda p: p, CallPolicy(per_second=10), 5, clock, clock.sleep).answers(["x"] * 11))
    assert clock.now == pytest.approx(5.0)


def test_repeats_with_growing_pauses():
    clock, calls = Clock(), []

    def score(prompt):
        calls.append(prompt)
        if prompt == "bad" or len(calls) < 3:
            raise ValueError("down")
        return prompt.upper()

    caller = Caller(score, CallPolicy(retries=3, pause=1.0), 1, clock, clock.sleep)
    assert list(caller.answers(["a", "bad"])) == [("A", None), (None, "down")]
    assert clock.slept == [1.0, 2.0, 1.0, 2.0, 4.0] and len(calls) == 7


def test_several_prompts_at_once():
    sizes = []

    def score(prompts):
        sizes.append(len(prompts))
        if "bad" in prompts:
            raise ValueError("no")
        return [None if p == "none" else p * 2 for p in prompts]

    got = list(Caller(score, CallPolicy(together=3), 1).answers(["a", "b", "none", "bad", "c"]))
    assert got == [("aa", None), ("bb", None), (None, "the scorer returned no text"), (None, "no"), ("cc", None)]
    assert sizes == [3, 2, 1, 1]
    short = Caller(lambda prompts: ["x"], CallPolicy(together=2), 1)
    assert [e for _, e in short.answers(["a", "b"])] == [None, None]  # one by one after the list did not fit


def prompt_rows(spark, names):
    rows = [(f"{n}|1", n, 1, f"prompt {n}") for n in names]
    df = spark.createDataFrame(rows, "session_key string, user_id string, exercise_id int, prompt string")
    return df.withColumn("prompt_hash", short_hash(F.col("prompt")))


def test_rate_needs_a_number_of_tasks(spark):
    with pytest.raises(ValueError):
        sc.call_scorer(prompt_rows(spark, "a"), lambda c: str, sc.ScorerConfig("p", "m", calls=CallPolicy(per_second=1)))


def test_list_scorer_through_spark(spark):
    config = sc.ScorerConfig("p", "m", parallel_calls=2, calls=CallPolicy(per_second=1000, together=4))
    rows = sc.score_sessions(prompt_rows(spark, "abcdefg").withColumn("session_key", F.when(F.col("user_id") != "a", F.col("session_key"))), sc_cache(spark), lambda c: (lambda prompts: [ANSWER] * len(prompts)), config)
    assert rows.count() == 7 and rows.filter("label = 'strategy_shifter' AND NOT cached").count() == 7


def sc_cache(spark):
    from snapweave.sources.answers import read_cache

    return read_cache(spark, None)


# --- bucketed cache ---


def cache_answers(spark, names, label, day):
    rows = sc.with_model(prompt_rows(spark, names), CONFIG)
    return rows.select(*sc.CACHE_KEY, F.lit(label).alias("label"), F.lit("why").alias("rationale"), F.lit("[]").alias("key_evidence"), F.lit("{}").alias("raw"), F.lit(dt.datetime(2024, 1, day)).alias("added_at"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def cache(spark, tmp_path):
    made = BucketedCache(spark, f"cache_{tmp_path.name.lower()}".replace("-", "_"), str(tmp_path / "cache"), buckets=8)
    yield made
    for version in range(made.version + 1):
        spark.sql(f"DROP TABLE IF EXISTS {made._table(version)}")


def test_lookup_gives_newest_answers(spark, cache):
    assert not cache.exists()
    cache.append(cache_answers(spark, "abcd", "old", 1))
    cache.append(cache_answers(spark, "bc", "new", 2))
    prompts = sc.with_model(prompt_rows(spark, "abz"), CONFIG)
    got = {r["user_id"]: (r["cached"], r["label"]) for r in cache.lookup(prompts).collect()}
    assert got == {"a": (True, "old"), "b": (True, "new"), "z": (False, None)}
    cache.compact()
    assert cache.table().count() == 4
    cache.drop_before()
    assert {r["user_id"]: r["label"] for r in cache.lookup(prompts).collect()} == {"a": "old", "b": "new", "z": None}


def test_the_cache_side_is_not_shuffled(spark, cache, monkeypatch):
    cache.append(cache_answers(spark, "abcdefghij", "x", 1))
    monkeypatch.setattr("snapweave.sources.bucketed_cache.FEW_KEYS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = cache.lookup(sc.with_model(prompt_rows(spark, "abc"), CONFIG))
        plan = plan_of(joined)
        assert plan.count("Exchange hashpartitioning") == 1  # of the prompts
        assert joined.filter("cached").count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def scanned_rows(df):
    """Rows that the scans of a collected DataFrame have given out."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_few_keys_open_few_buckets(spark, cache):
    names = [f"n{i}" for i in range(400)]
    cache.append(cache_answers(spark, names, "x", 1))
    one = with_cache_key(sc.with_model(prompt_rows(spark, ["n7"]), CONFIG)).first()[KEY]
    read = cache.table().filter(F.col(KEY).isin([one]))
    assert len(read.collect()) == 1 and 0 < scanned_rows(read) < 120  # of 400 in 8 buckets
    assert cache.lookup(sc.with_model(prompt_rows(spark, ["n7"]), CONFIG)).filter("cached").count() == 1


def test_keys_of_null_and_empty_parts_differ(spark):
    rows = spark.createDataFrame([(None, "h", "p", "m"), ("", "h", "p", "m"), ("h", None, "p", "m"), ("1:h", "", "p", "m")], "session_key string, prompt_hash string, provider string, model string")
    assert with_cache_key(rows).select(KEY).distinct().count() == 4


# --- stateful stream ---

ARRIVING = "session_key string, user_id string, exercise_id int, prompt string, prompt_hash string, arrived_at timestamp"


def arrive(spark, folder, number, rows):
    df = prompt_rows(spark, [n for n, _ in rows])
    times = spark.createDataFrame([(n, dt.datetime(2024, 1, 1, 10, m)) for n, m in rows], "user_id string, arrived_at timestamp")
    df.join(times, "user_id").select(*[c.split()[0] for c in ARRIVING.split(", ")]).coalesce(1).write.parquet(f"{folder}/f{number}")


@pytest.mark.parametrize("with_cache", [False, True])
def test_each_prompt_is_scored_once(spark, tmp_path, cache, with_cache):
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        scorer = lambda config: (lambda prompt: ANSWER)
        score_stream_once(stream, scorer, CONFIG, out, checkpoint, delay="25 minutes", cache=cache if with_cache else None).awaitTermination()
        return sorted(r["user_id"] for r in spark.read.parquet(f"{out}/predictions").collect())

    arrive(spark, source, 1, [("a", 0), ("b", 1)])
    arrive(spark, source, 2, [("a", 5), ("c", 6)])
    assert run() == ["a", "b", "c"]
    # After a restart the state still knows b; d is new.
    arrive(spark, source, 3, [("b", 20), ("d", 21)])
    assert run() == ["a", "b", "c", "d"]
    # A row behind the watermark is dropped, a repeat after the span is scored again or answered from the cache.
    arrive(spark, source, 4, [("e", 59)])
    assert run() == ["a", "b", "c", "d", "e"]
    arrive(spark, source, 5, [("late", 0), ("a", 59)])
    assert run() == ["a", "a", "b", "c", "d", "e"]
    found = spark.read.parquet(f"{out}/answers").filter("user_id = 'a'")
    assert found.filter("cached").count() == (1 if with_cache else 0)


# --- sketches ---


def test_merged_sketches_stay_within_their_error(spark):
    rng = np.random.default_rng(3)
    rows = [(int(d), "ab"[int(d) % 2], float(v), f"u{u}") for d, v, u in zip(rng.integers(0, 12, 30_000), rng.exponential(size=30_000), rng.integers(0, 4000, 30_000))]
    df = spark.createDataFrame(rows + [(0, "a", None, None)], "day int, kind string, v double, u string").repartition(5)
    daily = sk.sketch_rows(df, ["day", "kind"], ["v"], ["u"])
    merged = sk.merged_sketches(daily, ["kind"])
    got = sk.quantiles_of(merged, "v", [0.1, 0.5, 0.95], ["kind"]).collect()
    for kind in "ab":
        values = np.sort([r[2] for r in rows if r[1] == kind])
        for r in got:
            if r["kind"] == kind:
                assert abs(np.searchsorted(values, r["value"]) / len(values) - r["point"]) < sk.RANK_ERROR and r["counted"] == len(values)
    users = {r["kind"]: r["n"] for r in merged.select("kind", sk.distinct_of(merged, "u").alias("n")).collect()}
    for kind in "ab":
        exact = len({r[3] for r in rows if r[1] == kind})
        assert abs(users[kind] - exact) < 0.05 * exact
    assert {r["kind"]: r["rows"] for r in merged.collect()} == {k: sum(r[1] == k for r in rows) + (k == "a") for k in "ab"}


# --- incremental components ---


def test_parts_merge_exactly_when_nothing_is_dropped():
    x = np.random.default_rng(0).normal(size=(90, 5)) @ np.diag([5, 3, 2, 1, 0.5]) + 7
    merged = Part.of_rows(x[:40], 5).merge(Part.of_rows(x[40:], 5), 5)
    whole = Part.of_rows(x, 5)
    assert merged.n == 90 and np.allclose(merged.mean, whole.mean) and merged.squares == pytest.approx(whole.squares)
    assert np.allclose(np.linalg.norm(merged.spread, axis=1), np.linalg.norm(whole.spread, axis=1))


@pytest.mark.parametrize("tasks, block", [(3, 64), (40, 16)])
def test_incremental_components_come_near_the_exact_ones(spark, tasks, block):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 12)) * np.array([9, 6, 4, 2] + [0.3] * 8) + 3
    df = spark.createDataFrame([(v.tolist(),) for v in x], "e array<double>").repartition(tasks)
    model = fit_incremental_pca(df, "e", 12, 4, block)
    centred = x - x.mean(0)
    exact = np.linalg.svd(centred, full_matrices=False)[1][:4] ** 2 / 899
    assert np.allclose(model.variance, exact, rtol=0.02) and np.allclose(model.mean, x.mean(0))
    assert model.total == pytest.approx((centred**2).sum() / 899)
    scores = np.array([r["s"] for r in model.apply(df, "e", "s").collect()])
    assert np.allclose(scores.mean(0), 0, atol=1e-6) and np.allclose(scores.var(0, ddof=1), model.variance, rtol=0.02)


def test_too_few_rows_have_no_components(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([2.0, 1.0],)], "e array<double>")
    assert fit_incremental_pca(df, "e", 2) is None and fit_incremental_pca(df.limit(0), "e", 2) is None and fit_incremental_pca(df, "e", 0) is None
