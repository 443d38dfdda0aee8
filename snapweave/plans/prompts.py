"""One prompt per session: ordered, downsampled, formatted and hashed on the executors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from snapweave.functions.text import (
    MISSING,
    cut_code,
    format_number,
    format_value,
    label_options_text,
    session_key,
    short_hash,
    snapshot_block,
)
from snapweave.operators.ordering import HOT_ROWS, POS, SIZE, prompt_order
from snapweave.operators.sessions import downsample, feature_columns, role_names, role_ranges
from snapweave.schema import ID_AND_TIME_COLUMNS, KEYS, MAX_SNAPSHOTS, MAX_SNAPSHOTS_COMPACT, label_rows

NOTES = ["rationale", "sess_stats", "evidence"]
COMPACT_MODEL = "gemini-3-pro"


@dataclass(frozen=True)
class Template:
    """Prompt text around the session data; ``{...}`` names the part that is put in."""

    opening: str
    note_titles: tuple[str, str, str]
    closing: str
    with_descriptions: bool = True
    max_snapshots: int = MAX_SNAPSHOTS


LONG = Template(
    opening=(
        "You study how people work on programming exercises over time.\n\n"
        "Read the notes and the code snapshots of one session and pick the single label that fits best.\n"
        "The notes were written by another model; weigh them against the snapshots.\n"
        "Answer with JSON only.\n\n"
    ),
    note_titles=("Rationale", "Session statistics", "Evidence"),
    closing='\n\nAnswer format:\n{"label": "<one of the names above>"}\nUse a name exactly as it is listed.',
)
COMPACT = Template(
    opening="Pick one label for this programming session. Answer with JSON only: {\"label\": \"<name>\"}.\n\n",
    note_titles=("Rationale", "Statistics", "Evidence"),
    closing="",
    with_descriptions=False,
    max_snapshots=MAX_SNAPSHOTS_COMPACT,
)


def template_for(model: str | None) -> Template:
    return COMPACT if COMPACT_MODEL in (model or "").lower() else LONG


def _packed(text: pd.Series) -> pd.Series:
    """Four bytes of length, then the compressed text."""
    codec = pa.Codec("zstd")

    def packed(data: bytes) -> bytes:
        return len(data).to_bytes(4, "little") + codec.compress(data, asbytes=True)

    return text.map(lambda t: packed(t.encode("utf-8")))


def _unpacked(packed: list[bytes]) -> list[str]:
    codec = pa.Codec("zstd")
    return [codec.decompress(bytes(t[4:]), int.from_bytes(t[:4], "little"), asbytes=True).decode("utf-8") for t in packed]


def pack_code(df: DataFrame) -> DataFrame:
    """``code_snapshot`` cut and compressed: for the shuffles and sorts up to :func:`snapshot_blocks`, which unpacks it.

    Call it before session tables are joined, so that those joins do not move whole texts.
    """
    if dict(df.dtypes).get("code_snapshot") != "string":
        return df
    pack = F.pandas_udf(_packed, "binary")
    return df.withColumn("code_snapshot", pack(cut_code(F.col("code_snapshot"))))


def snapshot_blocks(
    df: DataFrame,
    max_snapshots: int = MAX_SNAPSHOTS,
    order: Sequence[Column] | None = None,
    keys: Sequence[str] = KEYS,
    hot_rows: int | None = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Per session: the text of its kept snapshots, first-row notes and column roles.

    Code is cut and packed before rows are gathered (here, if not by the caller) and at most ``max_snapshots``
    rows are gathered, so the largest group is ``max_snapshots`` blocks.
    """
    keys = list(keys)
    df = pack_code(df)
    columns = feature_columns(df, ignore=[*ID_AND_TIME_COLUMNS, "event_id", *NOTES])
    types = {f.name: f.dataType for f in df.schema.fields}
    notes = [n for n in NOTES if n in df.columns]
    packed = "code_snapshot" in df.columns
    code = F.col("code_snapshot") if packed else F.lit("")
    order = list(order or prompt_order(df))
    sorting = [c for c in ("seconds_from_start", "snapshot_time", "event_id") if c in df.columns]
    slim = df.select(*dict.fromkeys([*keys, *columns, *notes, *sorting]), code.alias("_code"))
    kept = downsample(slim, max_snapshots, order, keys, hot_rows, counted)

    values = F.struct(*[format_value(c, types[c]).alias(c) for c in columns]) if columns else None
    clock = F.lit(MISSING)
    if "seconds_from_start" in df.columns:
        clock = format_number(F.col("seconds_from_start").cast("double"))
    row = F.struct(
        F.col(POS).alias("pos"),
        clock.alias("clock"),
        *([values.alias("values")] if columns else []),
        F.col("_code").alias("code"),
    )
    first = [
        F.coalesce(F.min_by(n, POS), F.lit(MISSING)).alias(n) if n in notes else F.lit(MISSING).alias(n)
        for n in NOTES
    ]
    gathered = kept.groupBy(*keys).agg(
        F.array_sort(F.collect_list(row)).alias("_rows"),
        F.max(SIZE).alias("snapshots_seen"),
        *first,
        *role_ranges(columns),
    )
    gathered = gathered.select(*keys, *NOTES, "_rows", "snapshots_seen", *role_names(columns))
    # Unpacked only here: a session's rows do not move any more.
    codes = F.transform("_rows", lambda r: r["code"])
    if packed:
        # Not by Arrow, whose batches hold thousands of sessions: only some hundred are in Python at a time.
        codes = F.udf(_unpacked, "array<string>", useArrow=False)(codes)
    gathered = gathered.withColumn("_codes", codes)

    def block(r: Column, i: Column) -> Column:
        lines = (
            F.array_compact(
                F.array(
                    *[
                        F.when(
                            F.array_contains("snapshot_cols", c), F.concat(F.lit(f"{c}: "), r["values"][c])
                        )
                        for c in columns
                    ]
                )
            )
            if columns
            else F.array().cast("array<string>")
        )
        return snapshot_block((i + 1).cast("string"), r["clock"], lines, F.col("_codes")[i])

    return gathered.select(
        *keys,
        *NOTES,
        "snapshots_seen",
        F.size("_rows").alias("snapshots_kept"),
        "session_cols",
        "snapshot_cols",
        F.array_join(F.transform("_rows", block), "\n").alias("snapshots_text"),
    )


def prompt_text(template: Template, labels_text: str) -> Column:
    titles = template.note_titles
    return F.concat(
        F.lit(template.opening),
        F.lit("User: "), F.col("user_id").cast("string"),
        F.lit("\nExercise: "), F.col("exercise_id").cast("string"),
        F.lit("\n\n=== NOTES ===\n"),
        *[part for t, n in zip(titles, NOTES) for part in (F.lit(f"{t}: "), F.col(n), F.lit("\n"))],
        F.lit("\n=== CODE SNAPSHOTS ===\n"), F.col("snapshots_text"),
        F.lit("\n\n=== LABELS ===\n"), F.lit(labels_text), F.lit(template.closing),
    )


def build_prompts(
    df: DataFrame,
    model: str | None = None,
    template: Template | None = None,
    labels=None,
    order: Sequence[Column] | None = None,
    hot_rows: int | None = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """session_key, keys, prompt and prompt_hash, one row per session.

    ``counted``: the snapshot table before any join, to look for huge sessions in (see ``hot_sessions``).
    """
    template = template or template_for(model)
    labels_text = label_options_text(labels or label_rows(), template.with_descriptions)
    blocks = snapshot_blocks(df, template.max_snapshots, order, KEYS, hot_rows, counted)
    prompts = blocks.select(session_key().alias("session_key"), *KEYS, prompt_text(template, labels_text).alias("prompt"))
    return prompts.withColumn("prompt_hash", short_hash(F.col("prompt")))
