"""Scans, filters, joins, ordering, windows and per-session aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import labels, predictions, rationale, session_table, snapshots, table, with_tables
from catalog.registry import query, r, rounded, sr
from snapweave.functions.text import sequence_key, session_key
from snapweave.operators import aggregates as agg
from snapweave.operators import tables as tab
from snapweave.operators.ordering import POS, SIZE, model_order, number_rows, previous, prompt_order
from snapweave.operators.prep import global_mean_fill
from snapweave.operators.sessions import column_roles, downsample
from snapweave.operators.splits import lost_classes, split_by_user, with_validation
from snapweave.runtime import scratch_path
from snapweave.schema import KEYS, SNAPSHOT_FEATURES
from snapweave.sources import files

EVENT = ["event_id", *KEYS]


# --- scans and sinks -------------------------------------------------------------------------


@query(
    "io1_csv_snapshots",
    with_tables(
        f"""SELECT event_id, user_id, exercise_id, md5(code_snapshot) AS code_md5,
                   length(code_snapshot) AS code_chars, {sr('seconds_from_start', 'seconds_from_start')}
            FROM code""",
        "code",
    ),
)
def io1(spark, sf):
    source = snapshots(spark, sf, code=True).select(*EVENT, "code_snapshot", "seconds_from_start")
    path = scratch_path(spark, "csv")
    # Columns in another order and the row numbers that a spreadsheet program puts first.
    turned = source.select(F.col("event_id").alias("Unnamed: 0"), *reversed(source.columns))
    files.write_csv(turned, path, compression="gzip")  # each snapshot repeats its whole text
    back = files.read_snapshots(spark, path, source.schema)
    return back.select(
        *EVENT,
        F.md5("code_snapshot").alias("code_md5"),
        F.length("code_snapshot").cast("long").alias("code_chars"),
        r("seconds_from_start").alias("seconds_from_start"),
    )


@query("io2_parquet_scan", "SELECT event_id, user_id, value FROM events WHERE event_type = 'click'")
def io2(spark, sf):
    df = files.read_parquet(spark, f"{sf}/events.parquet", ["event_id", "user_id", "value", "event_type"])
    return df.filter("event_type = 'click'").drop("event_type")


@query(
    "io4_drop_index_columns",
    with_tables("SELECT user_id, exercise_id, level FROM session_table WHERE row_no = 1", "session_table"),
)
def io4(spark, sf):
    df = session_table(spark, sf).filter("row_no = 1").select(*KEYS, "level")
    path = scratch_path(spark, "indexed")
    files.write_csv(df.select(F.lit(1).alias("Unnamed: 0"), "level", F.lit(2).alias("index"), *KEYS), path)
    return files.read_session_table(spark, path)


@query(
    "io5_coerce_timestamps",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN epoch_us(ts) END AS micros FROM events""",
)
def io5(spark, sf):
    text = F.when(F.col("event_type") == "error", F.lit("not a time")).otherwise(F.col("ts").cast("string"))
    df = table(spark, sf, "events").select("event_id", text.alias("timestamp"))
    return tab.coerce_timestamps(df).select("event_id", F.unix_micros("timestamp").alias("micros"))


@query(
    "io6_coerce_numbers",
    f"""SELECT event_id, CASE WHEN event_type = 'click' OR event_type = 'view' THEN NULL
               ELSE {sr('value')} END AS value FROM events""",
)
def io6(spark, sf):
    text = (
        F.when(F.col("event_type") == "click", F.lit("n/a"))
        .when(F.col("event_type") == "view", F.lit("NaN"))
        .otherwise(F.col("value").cast("string"))
    )
    df = table(spark, sf, "events").select("event_id", text.alias("value"))
    return rounded(tab.coerce_numbers(df, ["value", "absent"]))


@query(
    "io7_prediction_files",
    with_tables("SELECT user_id, exercise_id, model, label FROM preds", "preds"),
)
def io7(spark, sf):
    root = scratch_path(spark, "predictions")
    rows = predictions(spark, sf)
    empty = [F.lit(None).cast("string").alias(c) for c in ("session_key",)]
    for m in ("m1", "m2", "m3"):
        part = rows.filter(F.col("model") == m).select(
            *empty, *KEYS, *[F.lit("NA").alias(c) for c in ("session_id", "exercise_type", "provider")],
            F.lit("from the file name").alias("model"), "label",
            *[F.lit("").alias(c) for c in ("rationale", "key_evidence", "prompt_hash")],
        )
        files.write_csv(part.select(*reversed(part.columns)), f"{root}/llm_profile_predictions_{m}.csv")
    return files.read_predictions(spark, f"{root}/llm_profile_predictions*.csv").select(*KEYS, "model", "label")


@query(
    "io8_prediction_sink",
    with_tables("SELECT user_id, exercise_id, model, label FROM preds", "preds"),
)
def io8(spark, sf):
    path = scratch_path(spark, "sink")
    files.write_predictions(predictions(spark, sf), path)
    return spark.read.parquet(path).select(*KEYS, "model", "label")


@query(
    "io9_feature_sink",
    with_tables(
        f"""SELECT user_id, exercise_id, count(*) AS sequence_length,
                   {sr('avg(executes_before_snapshot)', 'executes_before_snapshot_mean')}
            FROM snaps GROUP BY ALL""",
        "snaps",
    ),
)
def io9(spark, sf):
    path = scratch_path(spark, "features")
    files.write_features(agg.session_features(snapshots(spark, sf, chars=False), ["executes_before_snapshot"]), path)
    return rounded(spark.read.parquet(path).select(*KEYS, "sequence_length", "executes_before_snapshot_mean"))


# --- filters -----------------------------------------------------------------------------------


@query(
    "p1_keep_users",
    with_tables(
        "SELECT event_id, user_id, exercise_id FROM snaps "
        "WHERE user_id IN ('Student_10', 'Student_8', 'Student_13', 'Student_11')",
        "snaps",
    ),
)
def p1(spark, sf):
    users = ["Student_10", "Student_8", "Student_13", "Student_11"]
    return tab.keep_values(snapshots(spark, sf, chars=False), "user_id", users).select(*EVENT)


@query(
    "p1_keep_users_of_table",
    with_tables(
        "SELECT event_id, user_id, exercise_id FROM snaps "
        "WHERE user_id IN (SELECT user_id FROM true_labels WHERE label = 'Strategy Shifter')",
        "snaps",
        "true_labels",
    ),
)
def p1_table(spark, sf):
    users = labels(spark, sf).filter("label = 'Strategy Shifter'").select("user_id")
    return tab.keep_values(snapshots(spark, sf, chars=False), "user_id", users).select(*EVENT)


@query("p2_keep_exercises", with_tables("SELECT event_id, user_id, exercise_id FROM snaps WHERE x IN (1, 3)", "snaps"))
def p2(spark, sf):
    return tab.keep_values(snapshots(spark, sf, chars=False), "exercise_id", [1, 3]).select(*EVENT)


@query(
    "p3_session_keys",
    with_tables(
        """SELECT DISTINCT user_id || '|' || exercise_id AS short_key,
                  user_id || '|' || exercise_id || '|' || session_id AS long_key,
                  user_id || '_' || exercise_id AS sequence_key FROM snaps""",
        "snaps",
    ),
)
def p3(spark, sf):
    return (
        snapshots(spark, sf, chars=False)
        .select(
            session_key().alias("short_key"),
            session_key(session="session_id").alias("long_key"),
            sequence_key().alias("sequence_key"),
        )
        .distinct()
    )


def labelled(spark, sf, **options):
    return tab.attach(snapshots(spark, sf, **options), labels(spark, sf))


LABELLED = "SELECT s.*, l.label FROM snaps s LEFT JOIN true_labels l USING (user_id, exercise_id)"


@query(
    "p4_drop_unlabelled",
    with_tables(
        "SELECT event_id, user_id, exercise_id, label FROM labelled WHERE label IS NOT NULL",
        "snaps", "true_labels", extra={"labelled": LABELLED},
    ),
)
def p4(spark, sf):
    return tab.drop_unlabelled(labelled(spark, sf, chars=False)).select(*EVENT, "label")


@query(
    "p4_missing_label_count",
    with_tables(
        "SELECT count(*) AS rows_seen, count(*) FILTER (WHERE label IS NULL) AS rows_without_label FROM labelled",
        "snaps", "true_labels", extra={"labelled": LABELLED},
    ),
)
def p4_count(spark, sf):
    return tab.missing_label_count(labelled(spark, sf, chars=False))


ROLE_COLUMNS = [
    "exercise_type", "submits_before_snapshot", "executes_before_snapshot", "total_snapshots_in_session",
    "min_interval_seconds", "task_code_cosine", "sparse_metric",
]
KEPT = """
  SELECT * FROM (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id, exercise_id) AS n
                 FROM {source} WINDOW w AS (PARTITION BY user_id, exercise_id ORDER BY seconds_from_start, event_id))
  WHERE n <= {m} OR EXISTS (SELECT 1 FROM range({m}) g(k) WHERE pos =
        CASE WHEN k = {m} - 1 THEN n - 1 ELSE CAST(round_even(k * ((n - 1) / ({m} - 1.0::DOUBLE)), 0) AS BIGINT) END)"""


@query(
    "p6_column_roles",
    with_tables(
        "SELECT user_id, exercise_id, "
        + "concat_ws(',', " + ", ".join(f"CASE WHEN count(DISTINCT {c}) = 1 THEN '{c}' END" for c in ROLE_COLUMNS) + ") AS session_cols, "
        + "concat_ws(',', " + ", ".join(f"CASE WHEN count(DISTINCT {c}) > 1 THEN '{c}' END" for c in ROLE_COLUMNS) + ") AS snapshot_cols "
        + "FROM kept GROUP BY user_id, exercise_id",
        "snaps", extra={"kept": KEPT.format(source="snaps", m=8)},
    ),
)
def p6(spark, sf):
    roles = column_roles(downsample(snapshots(spark, sf, chars=False), 8), ROLE_COLUMNS)
    return roles.select(*KEYS, *[F.concat_ws(",", c).alias(c) for c in ("session_cols", "snapshot_cols")])


# --- joins -----------------------------------------------------------------------------------------


@query(
    "j1_join_session_features",
    with_tables(
        f"""SELECT event_id, s.user_id, s.exercise_id, row_no, n_events, {sr('sum_value', 'sum_value')}, many
            FROM snaps s LEFT JOIN session_table t USING (user_id, exercise_id)""",
        "snaps", "session_table",
    ),
)
def j1(spark, sf):
    joined = tab.attach(snapshots(spark, sf, chars=False), session_table(spark, sf))
    return rounded(joined.select(*EVENT, "row_no", "n_events", "sum_value", "many"))


@query(
    "j2_join_rationale",
    with_tables(
        """SELECT event_id, s.user_id, s.exercise_id, rationale, sess_stats, evidence
           FROM snaps s LEFT JOIN rationale USING (user_id, exercise_id)""",
        "snaps", "rationale",
    ),
)
def j2(spark, sf):
    joined = tab.attach(snapshots(spark, sf, chars=False), rationale(spark, sf))
    return joined.select(*EVENT, "rationale", "sess_stats", "evidence")


@query(
    "j3_join_labels",
    with_tables("SELECT event_id, user_id, exercise_id, label FROM labelled", "snaps", "true_labels", extra={"labelled": LABELLED}),
)
def j3(spark, sf):
    return labelled(spark, sf, chars=False).select(*EVENT, "label")


@query(
    "j4_join_many_to_one",
    with_tables(
        """SELECT event_id, s.user_id, s.exercise_id, level FROM snaps s
           LEFT JOIN (SELECT * FROM session_table WHERE row_no = 1) t USING (user_id, exercise_id)""",
        "snaps", "session_table",
    ),
)
def j4(spark, sf):
    unique = tab.keep_first(session_table(spark, sf), KEYS, ["row_no"])
    joined = tab.attach(snapshots(spark, sf, chars=False), unique, validate="m:1")
    return joined.select(*EVENT, "level")


@query(
    "j5_join_one_to_one",
    with_tables(
        """SELECT a.user_id, a.exercise_id, a.rows_seen, t.level
           FROM (SELECT user_id, exercise_id, count(*) AS rows_seen FROM snaps GROUP BY ALL) a
           LEFT JOIN (SELECT * FROM session_table WHERE row_no = 1) t USING (user_id, exercise_id)""",
        "snaps", "session_table",
    ),
)
def j5(spark, sf):
    counts = snapshots(spark, sf, chars=False).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows_seen"))
    unique = tab.keep_first(session_table(spark, sf), KEYS, ["row_no"])
    return tab.attach(counts, unique, validate="1:1").select(*KEYS, "rows_seen", "level")


@query(
    "j6_join_with_suffixes",
    with_tables(
        """SELECT user_id, exercise_id, model, t.label AS label_true, p.label AS label_pred
           FROM true_labels t JOIN preds p USING (user_id, exercise_id)""",
        "true_labels", "preds",
    ),
)
def j6(spark, sf):
    return tab.attach(labels(spark, sf), predictions(spark, sf), how="inner", suffixes=("_true", "_pred"))


@query(
    "j7_sessions_of_test_users",
    with_tables(
        """SELECT user_id, exercise_id FROM sessions JOIN
             (SELECT user_id FROM sessions GROUP BY 1 HAVING substr(md5('42:' || user_id), 1, 8) < '33333333') USING (user_id)""",
        "true_labels", extra={"sessions": "SELECT user_id, exercise_id FROM true_labels"},
    ),
)
def j7(spark, sf):
    sessions = labels(spark, sf).select(*KEYS)
    users = split_by_user(sessions.select("user_id").distinct()).filter("split = 'test'")
    return sessions.join(users.select("user_id"), "user_id", "left_semi")


@query(
    "j9_unmatched_sessions",
    with_tables(
        """SELECT 'true_only' AS side, user_id, exercise_id FROM true_labels
             WHERE (user_id, exercise_id) NOT IN (SELECT (user_id, exercise_id) FROM preds)
           UNION ALL SELECT DISTINCT 'pred_only', user_id, exercise_id FROM preds
             WHERE (user_id, exercise_id) NOT IN (SELECT (user_id, exercise_id) FROM true_labels)""",
        "true_labels", "preds",
    ),
)
def j9(spark, sf):
    truth, pred = labels(spark, sf), predictions(spark, sf)
    sides = (("true_only", truth, pred), ("pred_only", pred.select(*KEYS).distinct(), truth))
    parts = [tab.unmatched(a, b).select(F.lit(name).alias("side"), *KEYS) for name, a, b in sides]
    return parts[0].unionByName(parts[1])


# --- order, dedup, row choice ---------------------------------------------------------------------


@query("d1_keep_first", with_tables(f"SELECT user_id, exercise_id, row_no, {sr('sum_value', 'sum_value')} FROM session_table WHERE row_no = 1", "session_table"))
def d1(spark, sf):
    first = tab.keep_first(session_table(spark, sf), KEYS, ["row_no"])
    return rounded(first.select(*KEYS, "row_no", "sum_value"))


@query(
    "d2_keep_last",
    with_tables(
        f"""SELECT user_id, exercise_id, row_no, {sr('sum_value', 'sum_value')} FROM session_table
            QUALIFY row_number() OVER (PARTITION BY user_id, exercise_id ORDER BY row_no DESC) = 1""",
        "session_table",
    ),
)
def d2(spark, sf):
    return rounded(tab.keep_last(session_table(spark, sf), KEYS, ["row_no"]).select(*KEYS, "row_no", "sum_value"))


@query(
    "d3_session_order",
    with_tables(
        """SELECT event_id, user_id, exercise_id,
             row_number() OVER (PARTITION BY user_id, exercise_id ORDER BY snapshot_sequence_num, event_id) AS model_place,
             row_number() OVER (PARTITION BY user_id, exercise_id ORDER BY seconds_from_start, event_id) AS prompt_place
           FROM snaps""",
        "snaps",
    ),
)
def d3(spark, sf):
    df = snapshots(spark, sf, chars=False)
    by_model = number_rows(df, order=model_order(df)).withColumnRenamed(POS, "model_place").drop(SIZE)
    by_clock = number_rows(by_model, order=prompt_order(df))
    places = [(F.col("model_place") + 1).alias("model_place"), (F.col(POS) + 1).alias("prompt_place")]
    return by_clock.select(*EVENT, *places)


for _m in (20, 8):

    @query(
        f"d4_downsample_{_m}",
        with_tables("SELECT event_id, user_id, exercise_id, pos, n FROM kept", "snaps", extra={"kept": KEPT.format(source="snaps", m=_m)}),
    )
    def d4(spark, sf, m=_m):
        kept = downsample(snapshots(spark, sf, chars=False), m)
        return kept.select(*EVENT, F.col(POS).alias("pos"), F.col(SIZE).alias("n"))


@query(
    "d5_first_sessions",
    with_tables(
        """SELECT event_id, user_id, exercise_id FROM snaps JOIN
             (SELECT DISTINCT user_id, exercise_id FROM snaps ORDER BY 1, 2 LIMIT 25) USING (user_id, exercise_id)""",
        "snaps",
    ),
)
def d5(spark, sf):
    return tab.first_sessions(snapshots(spark, sf, chars=False), 25).select(*EVENT)


@query(
    "d6_first_row_values",
    with_tables(
        f"""SELECT user_id, exercise_id, session_id, exercise_type, {sr('task_code_cosine', 'task_code_cosine')}
            FROM snaps QUALIFY row_number() OVER (PARTITION BY user_id, exercise_id ORDER BY snapshot_sequence_num) = 1""",
        "snaps",
    ),
)
def d6(spark, sf):
    columns = ["session_id", "exercise_type", "task_code_cosine"]
    return rounded(agg.session_meta(snapshots(spark, sf, chars=False), ["snapshot_sequence_num"], columns).drop("seq_len"))


@query(
    "d7_first_present_values",
    with_tables(
        f"""SELECT user_id, exercise_id,
              {sr('min_by(task_code_cosine, event_id) FILTER (WHERE task_code_cosine IS NOT NULL)', 'task_code_cosine')},
              {sr('min_by(sparse_metric, event_id) FILTER (WHERE sparse_metric IS NOT NULL)', 'sparse_metric')}
            FROM snaps GROUP BY ALL""",
        "snaps",
    ),
)
def d7(spark, sf):
    columns = ["task_code_cosine", "sparse_metric"]
    return rounded(agg.first_present(snapshots(spark, sf, chars=False), columns, ["event_id"]))


@query(
    "d10_label_frequency",
    with_tables("SELECT model, label, count(*) AS n FROM preds GROUP BY ALL", "preds"),
)
def d10(spark, sf):
    return tab.frequency(predictions(spark, sf), "model", "label")


# --- per-session statistics -----------------------------------------------------------------------------

FILLED = (
    "SELECT event_id, user_id, exercise_id, seconds_from_start AS clock, snapshot_sequence_num AS seq, "
    + ", ".join(
        f"coalesce(CAST({f} AS DOUBLE), avg({f}) OVER (PARTITION BY user_id, exercise_id)) AS {f}"
        for f in SNAPSHOT_FEATURES
    )
    + " FROM code"
)
NUMBERED = (
    "SELECT *, row_number() OVER w - 1 AS pos, clock - lag(clock) OVER w AS step, "
    + ", ".join(f"{f} - lag({f}) OVER w AS d_{f}" for f in SNAPSHOT_FEATURES)
    + " FROM filled WINDOW w AS (PARTITION BY user_id, exercise_id ORDER BY seq, event_id)"
)
STATISTICS = {
    "mean": "avg({f})",
    "std": "stddev_pop({f})",
    "min": "min({f})",
    "max": "max({f})",
    "median": "quantile_cont({f}, 0.5)",
    "q1": "quantile_cont({f}, 0.25)",
    "q3": "quantile_cont({f}, 0.75)",
    "diff_mean": "avg(d_{f})",
    "diff_std": "stddev_pop(d_{f})",
    "diff_max": "max(abs(d_{f}))",
    "trend": "regr_slope({f}, pos)",
}
DURATIONS = {
    "total_duration": "arg_max(clock, pos) - arg_min(clock, pos)",
    "avg_time_between": "CASE WHEN count(*) = 1 THEN 0 ELSE (arg_max(clock, pos) - arg_min(clock, pos)) / (count(*) - 1) END",
    "time_std": "CASE WHEN count(*) <= 2 THEN 0 ELSE stddev_pop(step) END",
    "final_snapshot_num": "arg_max(seq, pos)",
    "avg_chars_per_snapshot": "coalesce(avg(chars_in_snapshot), 0)",
    "total_keystrokes": "coalesce(max(keystrokes_before_snapshot), 0)",
    "total_saves": "coalesce(max(saves_before_snapshot), 0)",
}


def features_sql(selected: dict[str, str]) -> str:
    listed = ", ".join(sr(text, name) for name, text in selected.items())
    return with_tables(
        f"SELECT user_id, exercise_id, count(*) AS sequence_length, {listed} FROM numbered GROUP BY user_id, exercise_id",
        "code",
        extra={"filled": FILLED, "numbered": NUMBERED},
    )


def _statistic(*names: str) -> dict[str, str]:
    return {f"{f}_{n}": STATISTICS[n].format(f=f) for f in SNAPSHOT_FEATURES for n in names}


FEATURE_QUERIES = {
    "a1_a2_length_and_mean": _statistic("mean"),
    "a3_std": _statistic("std"),
    "a4_min_max": _statistic("min", "max"),
    "a5_median": _statistic("median"),
    "a6_quartiles": _statistic("q1", "q3"),
    "a7_diff_mean": _statistic("diff_mean"),
    "a8_diff_std": _statistic("diff_std"),
    "a9_diff_max": _statistic("diff_max"),
    "a10_trend": _statistic("trend"),
    "a11_a13_durations": {n: DURATIONS[n] for n in ("total_duration", "avg_time_between", "time_std")},
    "a14_final_snapshot": {"final_snapshot_num": DURATIONS["final_snapshot_num"]},
    "a15_copies": {n: DURATIONS[n] for n in ("avg_chars_per_snapshot", "total_keystrokes", "total_saves")},
    "session_features": _statistic(*STATISTICS) | DURATIONS,
}

for _name, _selected in FEATURE_QUERIES.items():

    @query(_name, features_sql(_selected))
    def feature_query(spark, sf, columns=tuple(_selected)):
        wide = agg.session_features(snapshots(spark, sf), counted=snapshots(spark, sf, chars=False))
        return rounded(wide.select(*KEYS, "sequence_length", *columns))


@query(
    "a16_filled_with_session_mean",
    with_tables(
        "SELECT event_id, user_id, exercise_id, "
        + ", ".join(
            sr(f"coalesce({c}, avg({c}) OVER (PARTITION BY user_id, exercise_id))", c)
            for c in ("task_code_cosine", "sparse_metric")
        )
        + " FROM snaps",
        "snaps",
    ),
)
def a16(spark, sf):
    columns = ["task_code_cosine", "sparse_metric"]
    filled = number_rows(snapshots(spark, sf, chars=False), fill=columns)
    return rounded(filled.select(*EVENT, *columns))


@query(
    "a17_population_counts",
    with_tables(
        "SELECT count(*) AS snapshots, count(DISTINCT (user_id, exercise_id)) AS sessions, count(DISTINCT user_id) AS users FROM snaps",
        "snaps",
    ),
)
def a17(spark, sf):
    return agg.population_counts(snapshots(spark, sf, chars=False))


@query(
    "a18_session_meta",
    with_tables(
        "SELECT user_id, exercise_id, count(*) AS seq_len, min(label) AS label FROM labelled GROUP BY user_id, exercise_id",
        "snaps", "true_labels", extra={"labelled": LABELLED},
    ),
)
def a18(spark, sf):
    return agg.session_meta(labelled(spark, sf, chars=False), ["snapshot_sequence_num"])


@query(
    "a23_label_distribution",
    with_tables(
        f"""SELECT model, label, count(*) AS n, {sr('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY model)', 'percent')}
            FROM preds GROUP BY model, label""",
        "preds",
    ),
)
def a23(spark, sf):
    return rounded(agg.label_distribution(predictions(spark, sf), ["model"]))


@query(
    "a24_session_summary",
    with_tables(
        "SELECT count(*) AS sessions, "
        + ", ".join(
            sr(f"{f}({c})", f"{f}_{c}") for c in ("sequence_length", "total_duration") for f in ("avg", "min", "max")
        )
        + """ FROM (SELECT count(*) AS sequence_length, max(seconds_from_start) - min(seconds_from_start) AS total_duration
                   FROM snaps GROUP BY user_id, exercise_id)""",
        "snaps",
    ),
)
def a24(spark, sf):
    wide = agg.session_features(snapshots(spark, sf, chars=False), ["seconds_from_start"])
    summary = agg.session_summary(wide)
    return rounded(summary.select("sessions", *[F.col(c).cast("double").alias(c) for c in summary.columns[1:]]))


@query(
    "a25_class_weights",
    with_tables(
        f"""SELECT label, count(*) AS n, {sr('sum(count(*)) OVER () / (count(*) OVER () * count(*))', 'weight')}
            FROM true_labels GROUP BY label""",
        "true_labels",
    ),
)
def a25(spark, sf):
    return rounded(agg.class_weights(labels(spark, sf)))


@query(
    "a27_intake_report",
    with_tables(
        """SELECT CAST(sum(n) AS BIGINT) AS rows_seen, CAST(0 AS BIGINT) AS rows_without_key,
                  CAST(sum(n - labelled) AS BIGINT) AS rows_without_label,
                  count(*) AS sessions_seen, count(*) FILTER (WHERE labelled > 0) AS sessions_aggregated
           FROM (SELECT count(*) AS n, count(label) AS labelled FROM labelled GROUP BY user_id, exercise_id)""",
        "snaps", "true_labels", extra={"labelled": LABELLED},
    ),
)
def a27(spark, sf):
    return agg.intake_report(labelled(spark, sf, chars=False))


# --- windows and sets --------------------------------------------------------------------------------------


@query(
    "w1_successive_difference",
    with_tables(
        f"""SELECT event_id, user_id, exercise_id,
              {sr('seconds_from_start - lag(seconds_from_start) OVER w', 'step')},
              keystrokes_before_snapshot - lag(keystrokes_before_snapshot) OVER w AS typed
            FROM snaps WINDOW w AS (PARTITION BY user_id, exercise_id ORDER BY snapshot_sequence_num)""",
        "snaps",
    ),
)
def w1(spark, sf):
    columns = ["seconds_from_start", "keystrokes_before_snapshot"]
    out = number_rows(snapshots(spark, sf, chars=False), lags=columns)
    step, typed = [F.col(c) - F.col(previous(c)) for c in columns]
    return rounded(out.select(*EVENT, step.alias("step"), typed.alias("typed")))


@query(
    "w2_w3_index_and_size",
    with_tables(
        """SELECT event_id, user_id, exercise_id,
             row_number() OVER (PARTITION BY user_id, exercise_id ORDER BY snapshot_sequence_num) - 1 AS pos,
             count(*) OVER (PARTITION BY user_id, exercise_id) AS n FROM snaps""",
        "snaps",
    ),
)
def w2(spark, sf):
    out = number_rows(snapshots(spark, sf, chars=False))
    return out.select(*EVENT, F.col(POS).alias("pos"), F.col(SIZE).alias("n"))


@query(
    "w5_last_and_first_by_order",
    with_tables(
        f"""SELECT user_id, exercise_id, arg_min(event_type, event_id) AS first_type,
                   arg_max(event_type, event_id) AS last_type FROM snaps GROUP BY user_id, exercise_id""",
        "snaps",
    ),
)
def w5(spark, sf):
    out = snapshots(spark, sf, chars=False)
    return out.groupBy(*KEYS).agg(
        F.min_by("event_type", "event_id").alias("first_type"), F.max_by("event_type", "event_id").alias("last_type")
    )


@query(
    "w6_global_mean_fill",
    with_tables(
        "SELECT event_id, user_id, exercise_id, "
        + ", ".join(sr(f"coalesce({c}, (SELECT avg({c}) FROM snaps))", c) for c in ("task_code_cosine", "sparse_metric"))
        + " FROM snaps",
        "snaps",
    ),
)
def w6(spark, sf):
    columns = ["task_code_cosine", "sparse_metric"]
    return rounded(global_mean_fill(snapshots(spark, sf, chars=False), columns).select(*EVENT, *columns))


@query(
    "u1_append",
    with_tables(
        """SELECT user_id, exercise_id, label FROM true_labels
           UNION ALL SELECT user_id, exercise_id, label FROM preds""",
        "true_labels", "preds",
    ),
)
def u1(spark, sf):
    return labels(spark, sf).unionByName(predictions(spark, sf).drop("model"))


@query("u2_distinct_users", with_tables("SELECT DISTINCT user_id FROM snaps", "snaps"))
def u2(spark, sf):
    return snapshots(spark, sf, chars=False).select("user_id").distinct()


@query(
    "u3_lost_classes",
    with_tables(
        """SELECT many FROM split GROUP BY many
           HAVING count(*) FILTER (WHERE split = 'train') = 0 AND count(*) FILTER (WHERE split = 'validation') > 0""",
        "session_table",
        extra={
            "split": """SELECT many, CASE WHEN substr(md5('42:' || user_id), 1, 8) < '33333333' THEN 'test'
                          WHEN substr(md5('42:val:' || user_id), 1, 8) < '33333333' THEN 'validation'
                          ELSE 'train' END AS split FROM session_table"""
        },
    ),
)
def u3(spark, sf):
    return lost_classes(with_validation(split_by_user(session_table(spark, sf))), "many")


# --- the same operators where sessions are cut into slices -----------------------------------

# A third of the rows in one session, missing order values and keys, and a counter that is nearly always 0.
_HOT = "event_id % 3 = 0"
SLICED = 40
AWKWARD_SQL = f"""SELECT * REPLACE (
      CASE WHEN event_id % 101 = 7 THEN NULL WHEN {_HOT} THEN 'hot' ELSE user_id END AS user_id,
      CASE WHEN {_HOT} THEN 1 ELSE exercise_id END AS exercise_id,
      CASE WHEN event_id % 17 <> 3 THEN snapshot_sequence_num END AS snapshot_sequence_num,
      CASE WHEN event_id % 20 = 1 THEN saves_before_snapshot ELSE 0 END AS saves_before_snapshot)
    FROM {{source}}"""


def awkward_snapshots(spark, sf, chars=True):
    hot = F.expr(_HOT)
    return snapshots(spark, sf, chars=chars).withColumns(
        {
            "user_id": F.when(F.col("event_id") % 101 != 7, F.when(hot, "hot").otherwise(F.col("user_id"))),
            "exercise_id": F.when(hot, 1).otherwise(F.col("exercise_id")),
            "snapshot_sequence_num": F.when(F.col("event_id") % 17 != 3, F.col("snapshot_sequence_num")),
            "saves_before_snapshot": F.when(F.col("event_id") % 20 == 1, F.col("saves_before_snapshot")).otherwise(0),
        }
    )


def _sliced_features_sql(selected: dict[str, str]) -> str:
    listed = ", ".join(sr(text.replace("arg_max(seq", "arg_max_null(seq"), name) for name, text in selected.items())
    return with_tables(
        f"SELECT user_id, exercise_id, count(*) AS sequence_length, {listed} FROM numbered GROUP BY user_id, exercise_id",
        "code",
        extra={
            "awkward": AWKWARD_SQL.format(source="code"),
            "filled": FILLED.replace("FROM code", "FROM awkward WHERE user_id IS NOT NULL"),
            "numbered": NUMBERED,
        },
    )


for _name in ("session_features", "a5_median"):

    @query(f"{_name}_sliced", _sliced_features_sql(FEATURE_QUERIES[_name]))
    def sliced_feature_query(spark, sf, columns=tuple(FEATURE_QUERIES[_name])):
        wide = agg.session_features(awkward_snapshots(spark, sf), hot_rows=SLICED, counted=awkward_snapshots(spark, sf, chars=False))
        return rounded(wide.select(*KEYS, "sequence_length", *columns))


@query(
    "d4_downsample_20_sliced",
    with_tables(
        "SELECT event_id, user_id, exercise_id, pos, n FROM kept",
        "snaps",
        extra={
            "awkward": AWKWARD_SQL.format(source="snaps"),
            "present": "SELECT * FROM awkward WHERE user_id IS NOT NULL",
            "kept": KEPT.format(source="present", m=20),
        },
    ),
)
def d4_sliced(spark, sf):
    kept = downsample(awkward_snapshots(spark, sf, chars=False), 20, hot_rows=SLICED)
    return kept.select(*EVENT, F.col(POS).alias("pos"), F.col(SIZE).alias("n"))


@query(
    "w1_successive_difference_sliced",
    with_tables(
        f"""SELECT event_id, user_id, exercise_id, pos, {sr('seq', 'seq')},
              {sr('seq - lag(seq) OVER w', 'step')}, saves - lag(saves) OVER w AS saved
            FROM (SELECT event_id, user_id, exercise_id, snapshot_sequence_num AS raw, saves_before_snapshot AS saves,
                coalesce(snapshot_sequence_num, avg(snapshot_sequence_num) OVER (PARTITION BY user_id, exercise_id)) AS seq,
                row_number() OVER (PARTITION BY user_id, exercise_id ORDER BY snapshot_sequence_num, event_id) - 1 AS pos
              FROM awkward WHERE user_id IS NOT NULL)
            WINDOW w AS (PARTITION BY user_id, exercise_id ORDER BY pos)""",
        "snaps",
        extra={"awkward": AWKWARD_SQL.format(source="snaps")},
    ),
)
def w1_sliced(spark, sf):
    rows = awkward_snapshots(spark, sf, chars=False).withColumn("snapshot_sequence_num", F.col("snapshot_sequence_num").cast("double"))
    names = {"snapshot_sequence_num": "step", "saves_before_snapshot": "saved"}
    out = number_rows(rows, lags=list(names), fill=["snapshot_sequence_num"], hot_rows=SLICED)
    differences = [(F.col(c) - F.col(previous(c))).alias(new) for c, new in names.items()]
    return rounded(out.select(*EVENT, F.col(POS).alias("pos"), F.col("snapshot_sequence_num").alias("seq"), *differences))
