"""Formatting, prompts, answers, scoring through the cache, log and stream."""

import datetime as dt
import random
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from catalog.profile_queries import workbook_bytes
from snapweave.functions.answers import with_parsed_answer
from snapweave.functions.text import format_number, format_text, short_hash
from snapweave.functions.vectors import clean_embedding, finite_or_null
from snapweave.plans import scoring as sc
from snapweave.plans.prompts import COMPACT, LONG, build_prompts, snapshot_blocks, template_for
from snapweave.sources import answers, files, workbooks
from snapweave.streaming.scoring import score_stream

AT = dt.datetime(2024, 1, 1)

# Workers cannot import this file; the scorers below travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_numbers_print_like_python(spark):
    rng = random.Random(2)
    values = [rng.randrange(10**11) / 1e6 for _ in range(3000)]
    values += [(2 * rng.randrange(10**9) + 1) / 20000 for _ in range(3000)]
    values += [k / 32 for k in range(200)] + [2.00005, -2.00005, 0.0, -1e-9, 1e15, 100.0]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = [r[0] for r in df.select(format_number(F.col("x"))).collect()]
    assert got == [f"{v:.4f}".rstrip("0").rstrip(".") for v in values]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert {r[0] for r in odd.select(format_number(F.col("x"))).collect()} == {"NA"}
    text = spark.createDataFrame([("ä" * 301,), ("b" * 300,), (None,)], "x string")
    assert [r[0] for r in text.select(format_text(F.col("x"))).collect()] == ["ä" * 300 + "...", "b" * 300, "NA"]


CASES = [
    ('{"label":"tinkerer_explorer"}', "tinkerer_explorer"),
    ('{"label":"strategy_shifter",}', "strategy_shifter"),
    ('Well, {"label":"strategy_shifter"} it is', "strategy_shifter"),
    ('```json\n{"label":"ai_guided_integrator"}\n```', "ai_guided_integrator"),
    ('{"label":"incremental_builder"', "incremental_builder"),
    ('{"label":"incremental_bu', "other_or_uncertain"),
    ('{"label":"tinkerer"}', "tinkerer_explorer"),
    ('{"label":"the strategy_shifter type"}', "strategy_shifter"),
    ('{"label":"e"}', "incremental_builder"),
    ('{"label":"banana"}', "other_or_uncertain"),
    ('{"label":null}', "other_or_uncertain"),
    ('{"label":"strategy_shifter"} thanks', "strategy_shifter"),
    ("{'label': 'strategy_shifter'}", "strategy_shifter"),
    ('  {"label":" strategy_shifter "}\n', "strategy_shifter"),
    ('{"rationale":"no label"}', "other_or_uncertain"),
    ("[1]", "error"),
    ("", "other_or_uncertain"),
    (None, "error"),
]


def test_answers(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, response string")
    got = [r["label"] for r in with_parsed_answer(df).orderBy("i").collect()]
    assert got == [label for _, label in CASES]


def test_evidence_and_caps(spark):
    import json

    many = {"label": "strategy_shifter", "rationale": "r" * 3000, "key_evidence": ["x" * 400] + list("abcdefgh")}
    rows = [json.dumps(many), '{"label":"x","key_evidence":"one"}', '{"label":"x","key_evidence":[1,null]}', '{"label":"x"}', '{"label":"x","key_evidence":null}']
    df = spark.createDataFrame(list(enumerate(rows)), "i int, response string")
    got = with_parsed_answer(df).orderBy("i").collect()
    assert [len(e) for e in got[0]["key_evidence"]] == [300, 1, 1, 1, 1, 1] and len(got[0]["rationale"]) == 2000
    assert [r["key_evidence"] for r in got[1:]] == [["one"], ["1", "None"], [], ["None"]]


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, nan, inf, 4.0]), (1, [1.0]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "i int, e array<double>").orderBy("i")
    got = [r[0] for r in df.select(clean_embedding(F.col("e"), 3)).collect()]
    assert got == [[1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0] * 3, [0.0] * 3]
    values = spark.createDataFrame([(nan,), (inf,), (1.0,), (None,)], "v double")
    assert [r[0] for r in values.select(finite_or_null(F.col("v"))).collect()] == [None, None, 1.0, None]


@pytest.fixture(scope="module")
def snapshots(spark):
    rows = [("u1", 1, float(i), i, f"code {i}", 60, "note" if i == 0 else None) for i in range(30)]
    rows += [("u2", 1, 0.5, 0, None, 60, None)]
    return spark.createDataFrame(
        rows, "user_id string, exercise_id int, seconds_from_start double, event_id int, code_snapshot string, flat int, rationale string"
    )


def test_prompts(snapshots):
    assert template_for("x-gemini-3-pro-preview") is COMPACT and template_for("other") is LONG and template_for(None) is LONG
    blocks = {r["user_id"]: r for r in snapshot_blocks(snapshots).collect()}
    assert blocks["u1"]["snapshots_kept"] == 20 and blocks["u1"]["snapshots_seen"] == 30
    assert blocks["u1"]["session_cols"] == ["flat"] and blocks["u1"]["snapshot_cols"] == ["seconds_from_start"]
    text = blocks["u1"]["snapshots_text"]
    assert text.startswith("### Snapshot 1, second 0\nChanging values: seconds_from_start: 0\n~~~\ncode 0\n~~~\n")
    assert "code 29" in text and "Changing values: none" in blocks["u2"]["snapshots_text"]
    prompts = {r["user_id"]: r for r in build_prompts(snapshots, "any").collect()}
    assert prompts["u1"]["session_key"] == "u1|1" and "Rationale: note\n" in prompts["u1"]["prompt"]
    assert "Rationale: NA\n" in prompts["u2"]["prompt"]
    import hashlib

    assert prompts["u1"]["prompt_hash"] == hashlib.sha256(prompts["u1"]["prompt"].encode()).hexdigest()[:16]
    split = {r["user_id"]: r["prompt_hash"] for r in build_prompts(snapshots, "any", hot_rows=5).collect()}
    assert split == {u: p["prompt_hash"] for u, p in prompts.items()}
    assert len(build_prompts(snapshots, "gemini-3-pro").filter("user_id = 'u1'").first()["prompt"]) < len(prompts["u1"]["prompt"])


CONFIG = sc.ScorerConfig("stub", "m", parallel_calls=2)


def good(config):
    return lambda prompt: None if "none" in prompt else '{"label":"strategy_shifter"}'


def forbidden(config):
    def score(prompt):
        raise AssertionError("scorer was called")

    return score


@pytest.fixture(scope="module")
def prompts(spark):
    rows = [(f"u{i}|1", f"u{i}", 1, f"prompt {'none' if i == 3 else i}") for i in range(8)]
    df = spark.createDataFrame(rows, "session_key string, user_id string, exercise_id int, prompt string")
    return df.withColumn("prompt_hash", short_hash(F.col("prompt")))


def test_cache_replay_calls_no_scorer(spark, prompts, tmp_path):
    path = str(tmp_path / "cache")
    cache = answers.read_cache(spark, path)
    assert cache.count() == 0
    first = sc.score_sessions(prompts, cache, good, CONFIG)
    assert {r["label"]: r["count"] for r in first.groupBy("label").count().collect()} == {"strategy_shifter": 7, "error": 1}
    failed = first.filter("label = 'error'").first()
    assert failed["error"] == "the scorer returned no text" and failed["key_evidence"] == [] and not failed["cached"]
    answers.append_cache(sc.cache_rows(first, AT), path)
    again = sc.score_sessions(prompts, answers.read_cache(spark, path), forbidden, CONFIG)
    # Only the failed prompt is tried again; a call would show as that error.
    assert {r["session_key"] for r in again.filter("NOT cached").collect()} == {"u3|1"}
    assert again.filter("cached AND label = 'strategy_shifter' AND response = raw").count() == 7
    assert sc.cache_misses(prompts, answers.read_cache(spark, path), CONFIG).count() == 1
    other = sc.ScorerConfig("stub", "other")
    assert sc.cache_misses(prompts, answers.read_cache(spark, path), other).count() == 8


def test_log_keeps_the_last_entry(spark, prompts, tmp_path):
    path = str(tmp_path / "log")
    results = sc.score_sessions(prompts, answers.read_cache(spark, None), good, CONFIG)
    for day, cut in ((1, '{"label":"x"'), (2, '{"label":"y"')):
        answers.append_log(sc.log_rows(results.withColumn("response", F.lit(cut)), dt.datetime(2024, 1, day)), path)
    log = answers.log_entries(answers.read_log(spark, path))
    assert log.count() == 8 and {r["response"] for r in log.collect()} == {'{"label":"y"'}
    assert answers.log_entries(answers.read_log(spark, path), "m", "u1|1").count() == 1
    report = sc.run_report(log).first()
    assert (report["fresh"], report["cached"], report["errors"], report["truncated"]) == (8, 0, 1, 8)
    assert report["first_truncated"] == "u0|1" and report["truncated_example"] == '{"label":"y"'


def test_stream_scores_each_session_once(spark, prompts, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    prompts.repartition(2).write.parquet(source)

    def run(scorer, checkpoint):
        stream = spark.readStream.schema(prompts.schema).option("maxFilesPerTrigger", 1).parquet(source)
        score_stream(stream, scorer, CONFIG, out, checkpoint).awaitTermination()

    run(good, mark)
    assert spark.read.parquet(f"{out}/predictions").count() == 8
    run(forbidden, mark)  # nothing new
    prompts.filter("user_id <> 'u3'").write.mode("append").parquet(source)
    run(forbidden, mark)  # known prompts come from the cache
    assert spark.read.parquet(f"{out}/predictions").filter("label = 'error'").count() == 1
    assert answers.log_entries(answers.read_log(spark, f"{out}/log")).count() == 8


def test_csv_keeps_text(spark, tmp_path):
    rows = [("u", 1, 'say "hi",\nthen\tgo\\n'), ("v", 2, ""), ("w", 3, None)]
    df = spark.createDataFrame(rows, "user_id string, exercise_id int, code_snapshot string")
    files.write_csv(df, str(tmp_path / "s"))
    back = files.read_snapshots(spark, str(tmp_path / "s"), df.schema).orderBy("user_id").collect()
    assert back[0]["code_snapshot"] == rows[0][2] and back[1]["code_snapshot"] in ("", None)
    with pytest.raises(files.MissingColumns):
        files.require(df, "label")


def test_prediction_file_names(spark, tmp_path):
    for name in ("llm_profile_predictions.csv", "llm_profile_predictions_gpt5.2.csv", "llm_profile_predictions_a-b.csv"):
        (tmp_path / name).write_text("session_key,user_id,exercise_id\nu|1,u,1\n")
    read = files.read_predictions(spark, str(tmp_path / "llm_profile_predictions*.csv"))
    assert {r["model"] for r in read.collect()} == {"default", "gpt5.2", "a-b"}


def test_workbooks(spark, tmp_path):
    for i in range(2):
        rows = pd.DataFrame({"user_id": [f"u{i}", "ü<&>"], "exercise_id": [i, 3.0], "rationale": ["a", None], "other": ["x", "y"]})
        (tmp_path / f"book{i}.xlsx").write_bytes(workbook_bytes(rows))
    got = {tuple(r) for r in workbooks.read_workbooks(spark, str(tmp_path)).collect()}
    assert got == {("u0", 0, "a", None, None), ("u1", 1, "a", None, None), ("ü<&>", 3, None, None, None)}


def folders_with_texts(spark):
    """Written intermediate results that hold a prompt column."""
    from pathlib import Path

    import pyarrow.parquet as pq

    from snapweave.runtime import shared_folder

    names = (next(f.glob("*.parquet"), None) for f in Path(shared_folder(spark), "snapweave").iterdir())
    return {n.parent for n in names if n is not None and "prompt" in pq.read_schema(n).names}


def test_prompt_texts_are_written_once_and_never_shuffled(spark, prompts):
    before = folders_with_texts(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        config = sc.ScorerConfig("stub", "m")
        cache = sc.cache_rows(sc.score_sessions(prompts.limit(2), answers.read_cache(spark, None), good, config), dt.datetime(2024, 1, 1))
        rows = sc.score_sessions(sc.written_prompts(prompts), cache, good, config, keep_prompt=False)
        assert "prompt" not in rows.columns and sc.log_rows(rows, dt.datetime(2024, 1, 1)).filter("prompt IS NULL").count() == 8
        assert rows.filter("cached").count() == 2 and rows.filter("error IS NOT NULL").count() == 1
        assert len(folders_with_texts(spark) - before) == 3  # two prompts and their answers for the cache, all prompts once
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_code_is_cut_and_packed_before_it_moves(spark):
    from snapweave.plans.prompts import pack_code

    codes = ["é" * 9000, "", None, "line\n" * 400]
    rows = [("u1", 1, float(i), i, c) for i, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "user_id string, exercise_id int, seconds_from_start double, event_id int, code_snapshot string")
    packed = pack_code(df)
    assert dict(packed.dtypes)["code_snapshot"] == "binary"
    assert max(len(r[0]) for r in packed.select("code_snapshot").collect()) < 300
    text = snapshot_blocks(packed).first()["snapshots_text"]
    assert text == snapshot_blocks(df).first()["snapshots_text"]
    assert "é" * 2500 + "\n[the rest" in text and "é" * 2501 not in text and "line\n" * 400 in text
