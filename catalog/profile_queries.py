"""Label text, value formatting, prompts, answer parsing, scoring, cache, log and streaming."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from catalog.inputs import labels, predictions, rationale, session_table, sessions, snapshots, table, with_tables
from catalog.registry import query
from catalog.session_queries import KEPT
from snapweave.functions.answers import close_object, is_truncated, with_parsed_answer
from snapweave.functions.labels import predicted_label, true_label
from snapweave.functions.text import cut_code, format_number, format_text, format_value, label_options, short_hash
from snapweave.operators import tables as tab
from snapweave.plans import prompts as pr
from snapweave.plans import scoring as sc
from snapweave.runtime import materialize, scratch_path
from snapweave.schema import HUMAN_NAMES, KEYS, LABEL_NAMES, RATIONALE_SCHEMA, SNAPSHOT_FEATURES, label_rows, label_table
from snapweave.sources import answers, workbooks
from snapweave.streaming.scoring import score_stream

EVENT = ["event_id", *KEYS]
AT = dt.datetime(2024, 2, 1, 12, 0, 0)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- formatting ---------------------------------------------------------------------------------------


def number_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'NA' ELSE rtrim(rtrim(printf('%.4f', CAST({c} AS DOUBLE)), '0'), '.') END"


@query(
    "s1_s2_format_numbers",
    with_tables(
        f"""SELECT event_id, {number_sql('seconds_from_start')} AS seconds, {number_sql('task_code_cosine')} AS cosine,
              {number_sql('sparse_metric')} AS sparse, CAST(k AS VARCHAR) AS whole FROM snaps JOIN (SELECT event_id, k FROM base) USING (event_id)""",
        "snaps",
    ),
)
def s1(spark, sf):
    df = snapshots(spark, sf, chars=False).withColumn("k", F.col("keystrokes_before_snapshot") - F.floor(F.col("seconds_from_start") / 4))
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        "event_id",
        format_value("seconds_from_start", types["seconds_from_start"]).alias("seconds"),
        format_number(F.col("task_code_cosine")).alias("cosine"),
        format_number(F.col("sparse_metric")).alias("sparse"),
        format_value("k", types["k"]).alias("whole"),
    )


@query("s3_format_flags", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END AS flag FROM events")
def s3(spark, sf):
    df = table(spark, sf, "events").select("event_id", (F.col("event_type") == "error").alias("flag"))
    return df.select("event_id", format_value("flag", df.schema["flag"].dataType).alias("flag"))


@query(
    "s4_format_long_text",
    "SELECT doc_id, md5(CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END) AS shown FROM documents",
)
def s4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(format_text(F.col("text"))).alias("shown"))


CUT = "CASE WHEN length({c}) > 2500 THEN substr({c}, 1, 2500) || chr(10) || '[the rest of this snapshot is left out]' ELSE coalesce({c}, '') END"


@query("s5_cut_code", f"SELECT doc_id, md5(c) AS code, length(c) AS chars FROM (SELECT doc_id, {CUT.format(c='text')} AS c FROM documents)")
def s5(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", cut_code(F.col("text")).alias("c"))
    return df.select("doc_id", F.md5("c").alias("code"), F.length("c").cast("long").alias("chars"))


LABEL_VALUES = ", ".join(f"({i}, {quoted(n)}, {quoted(h)}, {quoted(t)})" for i, n, h, t in label_rows())


@query(
    "s8_label_options",
    with_tables(
        f"""SELECT p.user_id, p.exercise_id, p.model, string_agg('- ' || l.name || ': ' || l.description, chr(10) ORDER BY ord) AS labels_text,
              count(*) FILTER (WHERE l.human_name = p.label OR l.name = p.label) AS named
            FROM preds p, (VALUES {LABEL_VALUES}) l(ord, name, human_name, description) GROUP BY ALL""",
        "preds",
    ),
)
def s8(spark, sf):
    known = label_table(spark)
    text = label_options(known).scalar()
    names = F.array(*[F.lit(n) for n in (*LABEL_NAMES, *HUMAN_NAMES)])
    df = predictions(spark, sf)
    return df.select(*KEYS, "model", text.alias("labels_text"), F.array_contains(names, F.col("label")).cast("long").alias("named"))


@query(
    "s9_prompt_hash",
    "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents",
)
def s9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", short_hash(F.col("text")).alias("hash"))


TRUE_CASES = " ".join(f"WHEN {quoted(h)} THEN '{n}'" for h, n in zip(HUMAN_NAMES, LABEL_NAMES))


@query(
    "s10_true_label_names",
    with_tables(
        f"""SELECT user_id, exercise_id, model, CASE trim(raw) {TRUE_CASES} ELSE '' END AS y FROM
              (SELECT *, CASE model WHEN 'm1' THEN '  ' || label || ' ' WHEN 'm2' THEN label ELSE upper(label) END AS raw FROM preds)""",
        "preds",
    ),
)
def s10(spark, sf):
    raw = (
        F.when(F.col("model") == "m1", F.concat(F.lit("  "), "label", F.lit(" ")))
        .when(F.col("model") == "m2", F.col("label"))
        .otherwise(F.upper("label"))
    )
    return predictions(spark, sf).select(*KEYS, "model", true_label(raw).alias("y"))


_CLEAN = "trim(regexp_replace(regexp_replace(lower(trim(raw)), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_')"
_NAMES = ", ".join(f"'{n}'" for n in LABEL_NAMES)


@query(
    "s11_predicted_label_names",
    with_tables(
        f"""SELECT user_id, exercise_id, model, CASE WHEN {_CLEAN} IN ({_NAMES}) THEN {_CLEAN}
              WHEN {_CLEAN} = 'aiguided_integrator' THEN 'ai_guided_integrator'
              WHEN {_CLEAN} = 'debuggercentric_fixer' THEN 'debugger_centric_fixer'
              WHEN {_CLEAN} = 'planthenburst_implementer' THEN 'plan_then_burst_implementer' ELSE '' END AS y FROM
              (SELECT *, CASE model WHEN 'm1' THEN '<<' || upper(replace(label, '_', ' - ')) || '!>>' WHEN 'm2' THEN replace(label, '-', '')
                 ELSE ' ' || replace(label, '_', '__') END AS raw FROM preds)""",
        "preds",
    ),
)
def s11(spark, sf):
    raw = (
        F.when(F.col("model") == "m1", F.concat(F.lit("<<"), F.upper(F.replace("label", F.lit("_"), F.lit(" - "))), F.lit("!>>")))
        .when(F.col("model") == "m2", F.replace("label", F.lit("-"), F.lit("")))
        .otherwise(F.concat(F.lit(" "), F.replace("label", F.lit("_"), F.lit("__"))))
    )
    return predictions(spark, sf).select(*KEYS, "model", predicted_label(raw).alias("y"))


# --- answers ----------------------------------------------------------------------------------------------

ANSWER_FORMS = [
    '{"label":"@","rationale":" small steps ","key_evidence":["a","b"]}',
    '{"label": "@",}',
    'Here it is: {"label":"@","key_evidence":"one"} I hope this helps',
    '```json\n{"label":"@"}\n```',
    '{"label":"@"',
    '{"label":"the @ type"}',
    '{"label":"banana"}',
    '{"label":"@"} thanks',
    "[1]",
    "",
    '{"label":"e"}',
    None,
]


def _form(index, name):
    cases = None
    for i, form in enumerate(ANSWER_FORMS):
        text = F.lit(None).cast("string") if form is None else F.replace(F.lit(form), F.lit("@"), name)
        cases = F.when(index == i, text) if cases is None else cases.when(index == i, text)
    return cases


def raw_answers(spark, sf):
    df = labels(spark, sf).select(*KEYS, F.regexp_extract("user_id", "([0-9]+)", 1).cast("long").alias("u"), "label")
    name = F.element_at(F.array(*[F.lit(n) for n in LABEL_NAMES]), F.array_position(F.array(*[F.lit(h) for h in HUMAN_NAMES]), F.col("label")).cast("int"))
    return df.select(*KEYS, _form((F.col("u") + F.col("exercise_id")) % len(ANSWER_FORMS), name).alias("response"))


ANSWERS = {
    "named": f"SELECT user_id, exercise_id, CAST(regexp_extract(user_id, '([0-9]+)', 1) AS BIGINT) AS u, CASE label {TRUE_CASES} END AS name FROM true_labels",
    "answers": "SELECT user_id, exercise_id, CASE (u + exercise_id) % " + str(len(ANSWER_FORMS)) + " "
    + " ".join(
        f"WHEN {i} THEN " + ("NULL" if f is None else f"replace({quoted(f)}, '@', name)") for i, f in enumerate(ANSWER_FORMS)
    )
    + " END AS response FROM named",
    "found": """SELECT *, regexp_extract(response, '"label"\\s*:\\s*"([^"]+)"', 1) AS said FROM answers""",
    "parsed": "SELECT user_id, exercise_id, response, CASE WHEN response IS NULL OR response = '[1]' THEN 'error' WHEN coalesce(said, '') = '' THEN 'other_or_uncertain' "
    + f"WHEN said IN ({_NAMES}) THEN said "
    + " ".join(f"WHEN contains('{n}', said) THEN '{n}'" for n in LABEL_NAMES)
    + " "
    + " ".join(f"WHEN contains(said, '{n}') THEN '{n}'" for n in LABEL_NAMES)
    + """ ELSE 'other_or_uncertain' END AS label,
        CASE WHEN response IS NULL THEN 'scoring failed: no answer text' WHEN response = '[1]' THEN 'scoring failed: answer is not an object'
             ELSE trim(regexp_extract(response, '"rationale":"([^"]*)"', 1)) END AS rationale,
        CASE WHEN contains(response, '["a","b"]') THEN 'a;b' WHEN contains(response, ':"one"') THEN 'one' ELSE '' END AS evidence,
        CASE WHEN response = '[1]' THEN '' ELSE coalesce(response, '') END AS raw FROM found""",
}


@query(
    "s12_truncated_answers",
    with_tables(
        """SELECT user_id, exercise_id, coalesce(response LIKE '{%' AND response NOT LIKE '%}', false) AS truncated,
             CASE WHEN response LIKE '{%' AND response NOT LIKE '%}' THEN response || '}' ELSE response END AS closed FROM answers""",
        "true_labels", extra=ANSWERS,
    ),
)
def s12(spark, sf):
    df = raw_answers(spark, sf)
    return df.select(*KEYS, is_truncated(F.col("response")).alias("truncated"), close_object(F.col("response")).alias("closed"))


@query(
    "s13_b4_parse_answers",
    with_tables("SELECT user_id, exercise_id, label, rationale, evidence, raw FROM parsed", "true_labels", extra=ANSWERS),
)
def s13(spark, sf):
    parsed = with_parsed_answer(raw_answers(spark, sf))
    return parsed.select(*KEYS, "label", "rationale", F.array_join("key_evidence", ";").alias("evidence"), "raw")


# --- prompts ---------------------------------------------------------------------------------------------------

WHOLE = [c for c in SNAPSHOT_FEATURES if c not in ("seconds_from_start", "task_code_cosine", "task_code_distance")]


def prompt_input(spark, sf):
    """Snapshots joined with the notes and the session features, as a profiling run loads them."""
    rows = snapshots(spark, sf, code=True).select(*EVENT, "snapshot_time", "exercise_type", *SNAPSHOT_FEATURES, "code_snapshot")
    rows = pr.pack_code(rows)
    extra = tab.keep_first(session_table(spark, sf), KEYS, ["row_no"]).select(*KEYS, "n_events", "level")
    return tab.attach(tab.attach(rows, extra), rationale(spark, sf))


PROMPT_COLUMNS = ["exercise_type", *SNAPSHOT_FEATURES, "n_events", "level"]


def prompt_ctes(template: pr.Template) -> dict[str, str]:
    def shown(c: str) -> str:
        if c in ("exercise_type", "level"):
            return f"coalesce({c}, 'NA')"
        return f"coalesce(CAST({c} AS VARCHAR), 'NA')" if c in (*WHOLE, "n_events") else number_sql(c)

    lines = ", ".join(f"CASE WHEN v_{c} THEN '{c}: ' || {shown(c)} END" for c in PROMPT_COLUMNS)
    titles = template.note_titles
    return {
        "first_table": "SELECT * FROM session_table WHERE row_no = 1",
        "loaded": """SELECT c.*, t.n_events, t.level, r.rationale, r.sess_stats, r.evidence FROM code c
            LEFT JOIN first_table t ON t.user_id = c.user_id AND t.exercise_id = c.exercise_id
            LEFT JOIN rationale r ON r.user_id = c.user_id AND r.exercise_id = c.exercise_id""",
        "kept": KEPT.format(source="loaded", m=template.max_snapshots),
        "roles": "SELECT user_id, exercise_id, " + ", ".join(f"count(DISTINCT {c}) > 1 AS v_{c}" for c in PROMPT_COLUMNS) + " FROM kept GROUP BY ALL",
        "placed": """SELECT k.*, r.* EXCLUDE (user_id, exercise_id), row_number() OVER (PARTITION BY k.user_id, k.exercise_id ORDER BY pos) AS i
            FROM kept k JOIN roles r ON r.user_id = k.user_id AND r.exercise_id = k.exercise_id""",
        "blocks": f"""SELECT user_id, exercise_id, pos, rationale, sess_stats, evidence,
              '### Snapshot ' || i || ', second ' || {number_sql('seconds_from_start')} || chr(10) || 'Changing values: '
                || coalesce(nullif(concat_ws('; ', {lines}), ''), 'none') || chr(10) || '~~~' || chr(10)
                || {CUT.format(c='code_snapshot')} || chr(10) || '~~~' || chr(10) AS block
            FROM placed""",
        "texts": """SELECT user_id, exercise_id, string_agg(block, chr(10) ORDER BY pos) AS snapshots_text, count(*) AS snapshots_kept,
              coalesce(any_value(rationale), 'NA') AS rationale, coalesce(any_value(sess_stats), 'NA') AS sess_stats,
              coalesce(any_value(evidence), 'NA') AS evidence FROM blocks GROUP BY ALL""",
        "prompts": f"""SELECT user_id || '|' || exercise_id AS session_key, user_id, exercise_id,
              {quoted(template.opening)} || 'User: ' || user_id || chr(10) || 'Exercise: ' || exercise_id || chr(10) || chr(10)
              || '=== NOTES ===' || chr(10) || {quoted(titles[0] + ': ')} || rationale || chr(10) || {quoted(titles[1] + ': ')} || sess_stats
              || chr(10) || {quoted(titles[2] + ': ')} || evidence || chr(10) || chr(10) || '=== CODE SNAPSHOTS ===' || chr(10) || snapshots_text
              || chr(10) || chr(10) || '=== LABELS ===' || chr(10) || {quoted(pr.label_options_text(label_rows(), template.with_descriptions))}
              || {quoted(template.closing)} AS prompt FROM texts""",
        "hashed": "SELECT *, substr(sha256(prompt), 1, 16) AS prompt_hash FROM prompts",
    }


PROMPT_TABLES = ("code", "session_table", "rationale")


@query(
    "s6_snapshot_blocks",
    with_tables(
        "SELECT user_id, exercise_id, snapshots_kept, md5(snapshots_text) AS text_md5, length(snapshots_text) AS chars FROM texts",
        *PROMPT_TABLES, extra=prompt_ctes(pr.LONG),
    ),
)
def s6(spark, sf):
    blocks = pr.snapshot_blocks(prompt_input(spark, sf))
    return blocks.select(
        *KEYS, F.col("snapshots_kept").cast("long").alias("snapshots_kept"), F.md5("snapshots_text").alias("text_md5"),
        F.length("snapshots_text").cast("long").alias("chars"),
    )


for _name, _template, _model in (("b1_s7_prompts_long", pr.LONG, "some-model"), ("b1_s7_prompts_compact", pr.COMPACT, "gemini-3-pro-preview")):

    @query(
        _name,
        with_tables("SELECT session_key, user_id, exercise_id, prompt_hash, length(prompt) AS chars FROM hashed", *PROMPT_TABLES, extra=prompt_ctes(_template)),
    )
    def prompt_query(spark, sf, model=_model):
        built = pr.build_prompts(prompt_input(spark, sf), model, counted=snapshots(spark, sf, chars=False))
        return built.select("session_key", *KEYS, "prompt_hash", F.length("prompt").cast("long").alias("chars"))


# --- scoring -------------------------------------------------------------------------------------------------------

CONFIG = sc.ScorerConfig(provider="stub", model="stub-1")


def stub_scorer(config):
    """Deterministic stand-in for a text model: the prompt's hash picks the answer; some prompts fail."""
    import hashlib

    def score(prompt: str) -> str:
        digest = hashlib.sha256(prompt.encode("utf-8")).hexdigest()
        if digest[0] == "0":
            raise RuntimeError("stub refused")
        end = "" if digest[0] == "1" else "}"
        return '{"label":"' + LABEL_NAMES[int(digest[1], 16) % 7] + '"' + end

    return score


def stub_prompts(spark, sf):
    return pr.build_prompts(prompt_input(spark, sf), CONFIG.model, counted=snapshots(spark, sf, chars=False))


def stub_cache(prompts):
    """An earlier run: a third of the sessions by hash, each with an old and a newer row, and another model's rows."""
    picked = prompts.filter(F.pmod(F.conv(F.substring("prompt_hash", 1, 4), 16, 10).cast("long"), F.lit(3)) == 0)
    copies = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(v).alias("v")) for m, v in (("stub-1", 0), ("stub-1", 1), ("other", 2))]))
    rows = picked.select("session_key", "prompt_hash", copies.alias("c"))
    names = F.array(*[F.lit(n) for n in LABEL_NAMES])
    return rows.select(
        "session_key", "prompt_hash", F.lit("stub").alias("provider"), "c.model",
        F.element_at(names, F.col("c.v") + 1).alias("label"),
        F.lit("").alias("rationale"), F.lit('["seen"]').alias("key_evidence"), F.lit("{}").alias("raw"),
        (F.lit(AT) - F.make_dt_interval(F.lit(10) - F.col("c.v"))).cast("timestamp").alias("added_at"),
    )


def scored(spark, sf, keep_prompt=False):
    # The earlier run's cache is derived from the same prompts, so they are written once.
    prompts = sc.written_prompts(stub_prompts(spark, sf))
    return sc.score_sessions(prompts, stub_cache(prompts), stub_scorer, CONFIG, keep_prompt)


_HEX = "(strpos('0123456789abcdef', substr(prompt_hash, {i}, 1)) - 1)"
_IN_CACHE = "('0x' || substr(prompt_hash, 1, 4))::BIGINT % 3 = 0"
SCORED = prompt_ctes(pr.LONG) | {
    "results": f"""SELECT *, {_IN_CACHE} AS cached,
        CASE WHEN {_IN_CACHE} THEN NULL WHEN {_HEX.format(i=1)} = 0 THEN 'stub refused' END AS error,
        CASE WHEN {_IN_CACHE} THEN '{LABEL_NAMES[1]}' WHEN {_HEX.format(i=1)} = 0 THEN 'error'
             ELSE ([{_NAMES}])[{_HEX.format(i=2)} % 7 + 1] END AS label FROM hashed""",
    "answered": """SELECT *, CASE WHEN cached THEN '{}' WHEN error IS NOT NULL THEN 'ERROR: stub refused'
        ELSE '{"label":"' || label || '"' || CASE WHEN substr(prompt_hash, 1, 1) = '1' THEN '' ELSE '}' END END AS response FROM results""",
}


def score_query(name, body):
    return query(name, with_tables(body, *PROMPT_TABLES, extra=SCORED))


@score_query("b2_j8_cache_hits_and_misses", "SELECT session_key, prompt_hash, CASE WHEN cached THEN label END AS label, cached FROM results")
def b2(spark, sf):
    # Keys alone are looked up, so the texts are not written.
    prompts = materialize(stub_prompts(spark, sf).drop("prompt"), "prompt-keys")
    cache = stub_cache(prompts)
    hits = sc.cached_answers(prompts, cache, CONFIG).select("session_key", "prompt_hash", "label", "cached")
    misses = sc.cache_misses(prompts, cache, CONFIG).select("session_key", "prompt_hash", F.lit(None).cast("string").alias("label"), F.lit(False).alias("cached"))
    return hits.unionByName(misses)


@score_query(
    "b3_b5_b6_scored_sessions",
    "SELECT session_key, user_id, exercise_id, 'stub' AS provider, 'stub-1' AS model, label, prompt_hash, cached, error, response, "
    "CASE WHEN cached THEN 'seen' ELSE '' END AS evidence FROM answered",
)
def b3(spark, sf):
    columns = ["session_key", *KEYS, "provider", "model", "label", "prompt_hash", "cached", "error", "response"]
    return scored(spark, sf).select(*columns, F.array_join("key_evidence", ";").alias("evidence"))


@score_query(
    "b6_prediction_rows",
    """SELECT session_key, user_id, exercise_id, 'NA' AS session_id, ex.exercise_type, label, prompt_hash,
         CASE WHEN cached THEN '["seen"]' ELSE '[]' END AS key_evidence
       FROM results JOIN (SELECT DISTINCT user_id, exercise_id, exercise_type FROM snaps) ex USING (user_id, exercise_id)""",
)
def b6(spark, sf):
    types = snapshots(spark, sf, chars=False).groupBy(*KEYS).agg(F.min_by("exercise_type", "event_id").alias("exercise_type"))
    rows = sc.prediction_rows(scored(spark, sf), types)
    return rows.select("session_key", *KEYS, "session_id", "exercise_type", "label", "prompt_hash", "key_evidence")


@score_query("b7_cache_update", "SELECT session_key, prompt_hash, label, response AS raw FROM answered WHERE NOT cached AND error IS NULL")
def b7(spark, sf):
    return sc.cache_rows(scored(spark, sf), AT).select("session_key", "prompt_hash", "label", "raw")


@score_query(
    "b8_log_rows",
    """SELECT session_key, 'stub-1' AS model, md5(prompt) AS prompt_md5, response, label, cached, error,
         CASE WHEN NOT cached AND error IS NULL THEN prompt_hash END AS prompt_hash FROM answered""",
)
def b8(spark, sf):
    log = sc.log_rows(scored(spark, sf, keep_prompt=True), AT)
    return log.select(
        "session_key", "model", F.md5("prompt").alias("prompt_md5"), "response", "parsed_output.label",
        "metadata.cached", "metadata.error", "metadata.prompt_hash",
    )


@score_query(
    "b9_run_report",
    """SELECT 'stub-1' AS model, count(*) AS sessions, count(*) FILTER (WHERE NOT cached) AS fresh, count(*) FILTER (WHERE cached) AS cached,
         count(error) AS errors, count(*) FILTER (WHERE response LIKE '{%' AND response NOT LIKE '%}') AS truncated,
         min(session_key) FILTER (WHERE response LIKE '{%' AND response NOT LIKE '%}') AS first_truncated FROM answered""",
)
def b9(spark, sf):
    return sc.run_report(sc.log_rows(scored(spark, sf), AT)).drop("truncated_example")


@score_query("b9_label_report", "SELECT 'stub-1' AS model, label, count(*) AS n FROM answered GROUP BY label")
def b9_labels(spark, sf):
    return sc.label_report(sc.log_rows(scored(spark, sf), AT))


# --- cache and log files ----------------------------------------------------------------------------------------------


def plain_prompts(spark, sf):
    """One short prompt per session, for the file and stream queries."""
    rows = sessions(spark, sf).select(
        F.concat(F.lit("Student_"), F.col("u").cast("string")).alias("user_id"), F.col("x").cast("int").alias("exercise_id"),
        F.concat_ws(" ", F.lit("session"), F.col("u").cast("string"), F.col("x").cast("string"), F.col("n_events").cast("string")).alias("prompt"),
    )
    return rows.select(F.concat_ws("|", "user_id", F.col("exercise_id").cast("string")).alias("session_key"), *KEYS, "prompt").withColumn(
        "prompt_hash", short_hash(F.col("prompt"))
    )


PLAIN = {
    "plain": """SELECT *, substr(sha256(prompt), 1, 16) AS prompt_hash FROM
        (SELECT 'Student_' || u || '|' || x AS session_key, 'Student_' || u AS user_id, CAST(x AS INTEGER) AS exercise_id,
           'session ' || u || ' ' || x || ' ' || n_events AS prompt FROM sess)""",
    "plain_scored": f"""SELECT *, CASE WHEN {_HEX.format(i=1)} = 0 THEN 'error' ELSE ([{_NAMES}])[{_HEX.format(i=2)} % 7 + 1] END AS label FROM plain""",
}


@query(
    "io11_io12_cache_files",
    with_tables("SELECT session_key, prompt_hash, 'stub' AS provider, 'stub-1' AS model, label FROM plain_scored WHERE label <> 'error'", "sess", extra=PLAIN),
)
def io11(spark, sf):
    path = scratch_path(spark, "cache")
    prompts = plain_prompts(spark, sf)
    before = answers.read_cache(spark, path)
    answers.append_cache(sc.cache_rows(sc.score_sessions(prompts, before, stub_scorer, CONFIG), F.lit(AT)), path)
    cache = answers.read_cache(spark, path)
    return sc.current_cache(cache).select("session_key", "prompt_hash", "provider", "model", "label")


@query(
    "io13_io14_response_log",
    with_tables("SELECT session_key, 'stub-1' AS model, label, 'second' AS run FROM plain_scored", "sess", extra=PLAIN),
)
def io13(spark, sf):
    path = scratch_path(spark, "log")
    results = sc.score_sessions(plain_prompts(spark, sf), answers.read_cache(spark, None), stub_scorer, CONFIG)
    for run, day in (("first", 1), ("second", 2)):
        rows = sc.log_rows(results.withColumn("response", F.lit(run)), F.lit(dt.datetime(2024, 2, day)))
        answers.append_log(rows, path)
    log = answers.log_entries(answers.read_log(spark, path), model="stub-1")
    return log.select("session_key", "model", "parsed_output.label", F.col("response").alias("run"))


@query(
    "b10_stream_scoring",
    with_tables("SELECT session_key, user_id, exercise_id, prompt_hash, label FROM plain_scored", "sess", extra=PLAIN),
)
def b10(spark, sf):
    root = scratch_path(spark, "stream")
    prompts = plain_prompts(spark, sf)
    prompts.repartition(3).write.parquet(f"{root}/in")
    arriving = spark.readStream.schema(prompts.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    score_stream(arriving, stub_scorer, CONFIG, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{root}/out/predictions")
    return found.select("session_key", *KEYS, "prompt_hash", "label")


# --- workbooks -------------------------------------------------------------------------------------------------------------


def workbook_bytes(rows: pd.DataFrame) -> bytes:
    """A minimal workbook with inline texts, for the reader's check."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(value) -> str:
        if value is None or pd.isna(value):
            return "<c/>"
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        return f"<c><v>{value}</v></c>"

    lines = [rows.columns.tolist(), *rows.itertuples(index=False)]
    sheet = "".join("<row>" + "".join(cell(v) for v in line) + "</row>" for line in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()


@query("io3_workbooks", with_tables("SELECT user_id, exercise_id, rationale, sess_stats, evidence FROM rationale", "rationale"))
def io3(spark, sf):
    def pack(batches):
        for batch in batches:
            yield pd.DataFrame({"content": [workbook_bytes(batch)]})

    books = rationale(spark, sf).mapInPandas(pack, "content binary")
    return workbooks.unpack_workbooks(books, RATIONALE_SCHEMA)
