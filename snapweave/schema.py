"""Table schemas, the label table and the limits shared by every job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

KEYS = ["user_id", "exercise_id"]

# The numeric snapshot columns that are aggregated per session.
SNAPSHOT_FEATURES = [
    "seconds_from_start",
    "chars_in_snapshot",
    "saves_before_snapshot",
    "keystrokes_before_snapshot",
    "ai_feedback_before_snapshot",
    "submits_before_snapshot",
    "executes_before_snapshot",
    "snapshot_sequence_num",
    "total_snapshots_in_session",
    "thinned_snapshots_in_session",
    "min_interval_seconds",
    "task_code_cosine",
    "task_code_distance",
]

# Label names and their human-readable names, in label order.
LABEL_NAMES = [
    "incremental_builder",
    "plan_then_burst_implementer",
    "tinkerer_explorer",
    "debugger_centric_fixer",
    "strategy_shifter",
    "ai_guided_integrator",
    "low_validation_completer",
]
HUMAN_NAMES = [
    "Incremental Builder",
    "Plan-Then-Burst Implementer",
    "Tinkerer / Explorer",
    "Debugger-Centric Fixer",
    "Strategy Shifter",
    "AI-Guided Integrator",
    "Low-Validation Completer",
]
FALLBACK_LABEL = "other_or_uncertain"
ERROR_LABEL = "error"

# Predicted spellings that are repaired although the general rule misses them.
SPECIAL_SPELLINGS = {
    "aiguided_integrator": "ai_guided_integrator",
    "debuggercentric_fixer": "debugger_centric_fixer",
    "planthenburst_implementer": "plan_then_burst_implementer",
    "tinkerer__explorer": "tinkerer_explorer",
}

LABEL_DESCRIPTIONS = [
    "grows the solution in small steady edits with few errors and little outside help",
    "pauses to plan, then writes large coherent blocks in few snapshots",
    "tries many edits and runs, learning by experiment more than by plan",
    "relies on running the code and repairs one fault after the other",
    "drops the current approach and rewrites large parts in another way",
    "asks for AI feedback, applies it to specific places and checks the result",
    "stops early with little checking, often accepting AI output as it is",
]

# Prompt and answer limits.
MAX_SNAPSHOTS = 20
MAX_SNAPSHOTS_COMPACT = 8
MAX_CODE_CHARS = 2500
MAX_FEATURES_PER_BLOCK = 50
MAX_VALUE_CHARS = 300
MAX_EVIDENCE_ITEMS = 6
MAX_EVIDENCE_CHARS = 300
MAX_RATIONALE_CHARS = 2000
MAX_RAW_CHARS = 8000

# Users held out by the evaluator unless the caller names others.
DEFAULT_TEST_USERS = ["Student_10", "Student_8", "Student_13", "Student_11"]

# Columns that never count as features of a session or snapshot.
ID_AND_TIME_COLUMNS = ["user_id", "exercise_id", "session_id", "snapshot_time", "timestamp"]
TEXT_BLOB_COLUMNS = ["code_snapshot", "inserted_text", "deleted_text", "raw_log", "full_text"]

SNAPSHOT_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("exercise_id", T.IntegerType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("exercise_type", T.StringType()),
        T.StructField("snapshot_time", T.TimestampType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("code_snapshot", T.StringType()),
    ]
    + [T.StructField(name, T.DoubleType()) for name in SNAPSHOT_FEATURES]
)

RATIONALE_SCHEMA = "user_id string, exercise_id int, rationale string, sess_stats string, evidence string"
LABEL_SCHEMA = "user_id string, exercise_id int, label string"
PREDICTION_SCHEMA = (
    "session_key string, user_id string, exercise_id int, session_id string, exercise_type string, "
    "provider string, model string, label string, rationale string, key_evidence string, prompt_hash string"
)
CACHE_SCHEMA = (
    "session_key string, prompt_hash string, provider string, model string, label string, "
    "rationale string, key_evidence string, raw string, added_at timestamp"
)
LOG_SCHEMA = (
    "logged_at timestamp, session_key string, model string, prompt string, response string, "
    "parsed_output struct<label:string,rationale:string,key_evidence:array<string>,raw:string>, "
    "metadata struct<provider:string,model:string,cached:boolean,timestamp:timestamp,"
    "prompt_hash:string,error:string>"
)


def label_rows() -> list[tuple[int, str, str, str]]:
    return [
        (i, name, human, text)
        for i, (name, human, text) in enumerate(zip(LABEL_NAMES, HUMAN_NAMES, LABEL_DESCRIPTIONS))
    ]


def label_table(spark: SparkSession, rows=None) -> DataFrame:
    """The label set as a table: ord, name, human_name, description."""
    structs = [
        F.struct(
            F.lit(ord_).alias("ord"),
            F.lit(name).alias("name"),
            F.lit(human).alias("human_name"),
            F.lit(text).alias("description"),
        )
        for ord_, name, human, text in (rows or label_rows())
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))

# Numbers of columns that the model searches choose from.
SEARCHED_COLUMN_COUNTS = (20, 40, 60, 80, 120)
