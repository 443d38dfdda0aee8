"""Session tables derived from the given tables, once with DataFrames and once in SQL.

Every event is one snapshot; every derived value is a row-wise function of the event,
so deriving adds no shuffle beyond the joins with ``documents`` and ``embeddings``.
Users whose id is a multiple of 5 get one exercise per day, which makes many sessions
of one or two rows; the others get one exercise per six days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from snapweave.operators.ordering import BROADCAST_KEYS
from snapweave.runtime import materialize
from snapweave.schema import HUMAN_NAMES, LABEL_NAMES

DAY_US = 86_400_000_000
START_US = 1_704_067_200_000_000  # 2024-01-01 UTC


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _base(spark: SparkSession, sf: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(START_US)
    day = F.floor(micros / F.lit(DAY_US))
    daily = F.col("u") % 5 == 0
    return (
        table(spark, sf, "events")
        .select(
            "event_id",
            F.col("ts").alias("snapshot_time"),
            F.col("user_id").alias("u"),
            "event_type",
            "value",
            F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"),
            micros.alias("micros"),
            day.alias("day"),
        )
        .withColumns(
            {
                "x": F.when(daily, F.col("day") + 100).otherwise(F.floor(F.col("day") / 6)).cast("long"),
                "seconds": (
                    F.col("micros")
                    - F.when(daily, F.col("day")).otherwise(F.floor(F.col("day") / 6) * 6) * F.lit(DAY_US)
                )
                / F.lit(1e6),
            }
        )
    )


def _keys() -> list[Column]:
    return [
        F.concat(F.lit("Student_"), F.col("u").cast("string")).alias("user_id"),
        F.col("x").cast("int").alias("exercise_id"),
    ]


def snapshots(
    spark: SparkSession, sf: str, chars: bool = True, code: bool = False, embeddings: bool = False
) -> DataFrame:
    cosine = F.when(F.col("event_id") % 10 != 0, F.col("value") / 100)
    df = _base(spark, sf).select(
        "event_id",
        "u",
        "x",
        *_keys(),
        F.concat(F.lit("S"), F.col("u").cast("string"), F.lit("-"), F.col("x").cast("string")).alias("session_id"),
        F.element_at(F.array(F.lit("loops"), F.lit("lists"), F.lit("classes")), (F.col("x") % 3 + 1).cast("int")).alias(
            "exercise_type"
        ),
        "snapshot_time",
        "event_type",
        F.col("seconds").alias("seconds_from_start"),
        F.floor(F.col("seconds") / 60).alias("saves_before_snapshot"),
        (F.floor(F.col("seconds") / 4) + F.col("k")).alias("keystrokes_before_snapshot"),
        (F.col("k") % 7).alias("ai_feedback_before_snapshot"),
        (F.col("event_type") == "signup").cast("long").alias("submits_before_snapshot"),
        F.floor("value").alias("executes_before_snapshot"),
        (F.col("event_id") + 1).alias("snapshot_sequence_num"),
        ((F.col("u") + F.col("x")) % 20 + 10).alias("total_snapshots_in_session"),
        ((F.col("u") + F.col("x")) % 10 + 5).alias("thinned_snapshots_in_session"),
        F.lit(60).cast("long").alias("min_interval_seconds"),
        cosine.alias("task_code_cosine"),
        (1 - cosine).alias("task_code_distance"),
        F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("sparse_metric"),
    )
    if chars or code:
        documents = table(spark, sf, "documents")
        n_docs = documents.agg(F.count(F.lit(1))).scalar()
        wanted = [F.col("doc_id"), F.col("n_chars").alias("chars_in_snapshot")]
        if code:
            wanted.append(F.col("text").alias("code_snapshot"))
        df = df.withColumn("doc_id", F.col("event_id") % n_docs).join(documents.select(*wanted), "doc_id").drop("doc_id")
    if embeddings:
        df = with_embeddings(spark, sf, df)
    return df


def with_embeddings(spark: SparkSession, sf: str, df: DataFrame) -> DataFrame:
    """Snapshots (with ``event_id`` and ``x``) and their two embeddings, which become doubles after they were moved.

    A few exercises hold most snapshots, so a join by exercise would sort all rows of one in one task: the embeddings
    of the exercises that occur are found first and, if they are few, broadcast.
    """
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    n_vec = vectors.agg(F.count(F.lit(1))).scalar()
    asked = vectors.select(F.col("vec_id").alias("x"), F.col("e").alias("task_embedding")).join(df.select("x").distinct(), "x", "left_semi")
    asked = materialize(asked, "asked")
    if asked.count() <= BROADCAST_KEYS:
        asked = F.broadcast(asked)
    df = (
        df.withColumn("vec_id", F.col("event_id") % n_vec)
        .join(vectors, "vec_id")
        .withColumn(
            "code_embedding",
            F.when(F.col("event_id") % 23 == 0, F.lit(None))
            .when(F.col("event_id") % 17 == 0, F.slice("e", 1, 60))
            .otherwise(F.col("e")),
        )
        .drop("vec_id", "e")
        .join(asked, "x", "left")
    )
    return df.withColumns({c: F.col(c).cast("array<double>") for c in ("code_embedding", "task_embedding")})


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _base(spark, sf).groupBy("u", "x").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("sum_value"), F.max("value").alias("max_value")
    )


def session_table(spark: SparkSession, sf: str) -> DataFrame:
    """Extra session features; some sessions absent, some present twice (``row_no`` is the file order)."""
    s = F.col("u") + F.col("x")
    copies = F.when(s % 19 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        sessions(spark, sf)
        .filter(s % 13 != 0)
        .withColumn("row_no", F.explode(copies))
        .select(
            *_keys(),
            "row_no",
            "n_events",
            (F.col("sum_value") + F.col("row_no") - 1).alias("sum_value"),
            "max_value",
            F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("x") % 3 + 1).cast("int")).alias("level"),
            F.lit("same").alias("only_one"),
            F.concat(F.lit("m"), (F.col("u") % 97).cast("string")).alias("many"),
        )
    )


def rationale(spark: SparkSession, sf: str) -> DataFrame:
    s = (F.col("u") + F.col("x")).cast("string")
    return (
        sessions(spark, sf)
        .filter((F.col("u") + F.col("x")) % 7 != 0)
        .select(
            *_keys(),
            F.concat(F.lit("notes on session "), s).alias("rationale"),
            F.concat(F.lit("{'total_snapshots': "), F.col("n_events").cast("string"), F.lit("}")).alias("sess_stats"),
            F.concat(F.lit("['step "), s, F.lit("']")).alias("evidence"),
        )
    )


def _label_index() -> Column:
    return (7 * F.col("u") + 3 * F.col("x") + F.floor(F.col("u") / 10)) % 7


def _named(names: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return (
        sessions(spark, sf)
        .filter((F.col("u") + F.col("x")) % 11 != 0)
        .select(*_keys(), _named(HUMAN_NAMES, _label_index()).alias("label"))
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Three models: right, neighbouring, human-spelled, uncertain and failed answers."""
    m = F.col("m")
    c = (31 * F.col("u") + 17 * F.col("x") + m) % 10
    answer = (
        F.when(c <= 5, _named(LABEL_NAMES, _label_index()))
        .when(c == 6, _named(LABEL_NAMES, (_label_index() + 1) % 7))
        .when(c == 7, _named(HUMAN_NAMES, _label_index()))
        .when(c == 8, F.lit("other_or_uncertain"))
        .otherwise(F.lit("error"))
    )
    return (
        sessions(spark, sf)
        .withColumn("m", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
        .filter((F.col("u") + 2 * F.col("x") + m) % 29 != 0)
        .select(*_keys(), F.concat(F.lit("m"), m.cast("string")).alias("model"), answer.alias("label"))
    )


# --- the same tables in SQL -----------------------------------------------------------------

_HUMAN = "[" + ", ".join(f"'{n}'" for n in HUMAN_NAMES) + "]"
_NAMES = "[" + ", ".join(f"'{n}'" for n in LABEL_NAMES) + "]"
_LABEL_INDEX = "(7*u + 3*x + u//10) % 7"
_KEYS = "'Student_' || u AS user_id, CAST(x AS INTEGER) AS exercise_id"

CTES = {
    "base": f"""
      SELECT *, CASE WHEN u % 5 = 0 THEN day + 100 ELSE day // 6 END AS x,
        (micros - (CASE WHEN u % 5 = 0 THEN day ELSE (day // 6) * 6 END) * {DAY_US}) / 1e6 AS seconds
      FROM (SELECT event_id, ts AS snapshot_time, user_id AS u, event_type, value,
              CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
              epoch_us(ts) - {START_US} AS micros,
              (epoch_us(ts) - {START_US}) // {DAY_US} AS day
            FROM events)""",
    "snaps": f"""
      SELECT event_id, u, x, {_KEYS}, 'S' || u || '-' || x AS session_id,
        (['loops','lists','classes'])[x % 3 + 1] AS exercise_type,
        snapshot_time, event_type, seconds AS seconds_from_start,
        CAST(floor(seconds / 60) AS BIGINT) AS saves_before_snapshot,
        CAST(floor(seconds / 4) AS BIGINT) + k AS keystrokes_before_snapshot,
        k % 7 AS ai_feedback_before_snapshot,
        CAST(event_type = 'signup' AS BIGINT) AS submits_before_snapshot,
        CAST(floor(value) AS BIGINT) AS executes_before_snapshot,
        event_id + 1 AS snapshot_sequence_num,
        (u + x) % 20 + 10 AS total_snapshots_in_session,
        (u + x) % 10 + 5 AS thinned_snapshots_in_session,
        CAST(60 AS BIGINT) AS min_interval_seconds,
        CASE WHEN event_id % 10 <> 0 THEN value / 100 END AS task_code_cosine,
        1 - CASE WHEN event_id % 10 <> 0 THEN value / 100 END AS task_code_distance,
        CASE WHEN event_id % 2 = 0 THEN value END AS sparse_metric
      FROM base""",
    "code": """
      SELECT s.*, d.n_chars AS chars_in_snapshot, d.text AS code_snapshot
      FROM snaps s JOIN documents d ON d.doc_id = s.event_id % (SELECT count(*) FROM documents)""",
    "embedded": """
      SELECT s.*, CASE WHEN s.event_id % 23 = 0 THEN NULL
                       WHEN s.event_id % 17 = 0 THEN v.embedding[1:60]
                       ELSE v.embedding END AS code_embedding, t.embedding AS task_embedding
      FROM snaps s JOIN embeddings v ON v.vec_id = s.event_id % (SELECT count(*) FROM embeddings)
      LEFT JOIN embeddings t ON t.vec_id = s.x""",
    "sess": """
      SELECT u, x, count(*) AS n_events, sum(value) AS sum_value, max(value) AS max_value
      FROM base GROUP BY u, x""",
    "session_table": f"""
      SELECT {_KEYS}, row_no, n_events, sum_value + row_no - 1 AS sum_value, max_value,
        (['easy','medium','hard'])[x % 3 + 1] AS level, 'same' AS only_one, 'm' || (u % 97) AS many
      FROM (SELECT *, unnest(CASE WHEN (u + x) % 19 = 0 THEN [1, 2] ELSE [1] END) AS row_no
            FROM sess WHERE (u + x) % 13 <> 0)""",
    "rationale": f"""
      SELECT {_KEYS}, 'notes on session ' || (u + x) AS rationale,
        '{{''total_snapshots'': ' || n_events || '}}' AS sess_stats, '[''step ' || (u + x) || ''']' AS evidence
      FROM sess WHERE (u + x) % 7 <> 0""",
    "true_labels": f"""
      SELECT {_KEYS}, ({_HUMAN})[{_LABEL_INDEX} + 1] AS label FROM sess WHERE (u + x) % 11 <> 0""",
    "preds": f"""
      SELECT {_KEYS}, 'm' || m AS model,
        CASE WHEN c <= 5 THEN ({_NAMES})[{_LABEL_INDEX} + 1]
             WHEN c = 6 THEN ({_NAMES})[({_LABEL_INDEX} + 1) % 7 + 1]
             WHEN c = 7 THEN ({_HUMAN})[{_LABEL_INDEX} + 1]
             WHEN c = 8 THEN 'other_or_uncertain' ELSE 'error' END AS label
      FROM (SELECT *, (31*u + 17*x + m) % 10 AS c FROM (SELECT *, unnest([1, 2, 3]) AS m FROM sess))
      WHERE (u + 2*x + m) % 29 <> 0""",
}

_NEEDS = {
    "base": [],
    "snaps": ["base"],
    "code": ["base", "snaps"],
    "embedded": ["base", "snaps"],
    "sess": ["base"],
    "session_table": ["base", "sess"],
    "rationale": ["base", "sess"],
    "true_labels": ["base", "sess"],
    "preds": ["base", "sess"],
}


def with_tables(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``body`` after the CTEs it needs; ``extra`` adds named steps of the query itself."""
    wanted = [n for n in CTES if n in names or any(n in _NEEDS[m] for m in names)]
    steps = {n: CTES[n] for n in wanted} | (extra or {})
    listed = ",\n".join(f"{n} AS ({text})" for n, text in steps.items())
    return f"WITH {listed}\n{body}" if steps else body
