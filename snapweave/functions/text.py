"""Keys, value formatting and prompt text as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from snapweave.schema import MAX_CODE_CHARS, MAX_VALUE_CHARS

MISSING = "NA"
NOTHING_CHANGES = "none"
CUT_MARK = "\n[the rest of this snapshot is left out]"


def session_key(user: str = "user_id", exercise: str = "exercise_id", session: str | None = None) -> Column:
    """``user|exercise``, or ``user|exercise|session`` where the session id is present."""
    parts = [F.col(user).cast("string"), F.col(exercise).cast("string")]
    if session:
        parts.append(F.col(session).cast("string"))
    return F.concat_ws("|", *parts)


def sequence_key(user: str = "user_id", exercise: str = "exercise_id") -> Column:
    """``user_exercise``. Output only: two sessions can share this text, so never group by it."""
    return F.concat_ws("_", F.col(user).cast("string"), F.col(exercise).cast("string"))


def _settle_tie(x: Column) -> Column:
    """Move a value that prints half-way between two 4-digit decimals to the right one of them.

    ``format_string`` rounds the shortest decimal text of a double, so such values always
    go up; the stored binary value is usually a little above or below. 20000 * x is
    compared with the odd whole number next to it without rounding error, by splitting x
    into two parts of at most 27 bits. A true tie goes to the even digit.
    """
    size = F.abs(x)
    whole = F.rint(size * 20000.0)
    high = size * 134217729.0 - (size * 134217729.0 - size)
    excess = (high * 20000.0 - whole) + (size - high) * 20000.0
    up = (excess > 0) | ((excess == 0) & (F.pmod((whole + 1) / 2, F.lit(2.0)) == 0))
    settled = F.when(up, (whole + 1) / 2).otherwise((whole - 1) / 2) / 10000.0
    tie = (size < 1e11) & (F.pmod(whole, F.lit(2.0)) == 1) & (
        F.abs(size * 20000.0 - whole) <= F.greatest(F.lit(1.0), whole) * 1e-15
    )
    return F.when(tie, F.signum(x) * settled).otherwise(x)


def format_number(x: Column) -> Column:
    """Four decimals without trailing zeros; missing and non-finite values give ``NA``."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    trimmed = F.regexp_replace(F.format_string("%.4f", _settle_tie(x)), r"\.?0+$", "")
    return F.when(finite, trimmed).otherwise(F.lit(MISSING))


def format_text(x: Column, limit: int = MAX_VALUE_CHARS) -> Column:
    cut = F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit), F.lit("..."))).otherwise(x)
    return F.coalesce(cut, F.lit(MISSING))


def format_value(name: str, data_type: T.DataType) -> Column:
    """Readable text of a column of any scalar type."""
    x = F.col(name)
    if isinstance(data_type, (T.DoubleType, T.FloatType, T.DecimalType)):
        return format_number(x.cast("double"))
    return format_text(x.cast("string"))


def cut_code(x: Column, limit: int = MAX_CODE_CHARS) -> Column:
    """Code text cut at ``limit`` characters with a mark; missing code is empty."""
    cut = F.concat(F.substring(x, 1, limit), F.lit(CUT_MARK))
    return F.coalesce(F.when(F.length(x) > limit, cut).otherwise(x), F.lit(""))


def short_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256 of the UTF-8 text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def label_options(labels: DataFrame, with_description: bool = True) -> DataFrame:
    """The label set as prompt lines, one row with column ``labels_text``."""
    line = F.concat(F.lit("- "), F.col("name"))
    if with_description:
        line = F.concat(line, F.lit(": "), F.col("description"))
    lines = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    return labels.agg(F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("labels_text"))


def label_options_text(rows: Sequence[tuple[int, str, str, str]], with_description: bool = True) -> str:
    """The same lines as a literal, for building prompts without a join."""
    return "\n".join(
        f"- {name}: {text}" if with_description else f"- {name}" for _, name, _, text in sorted(rows)
    )


def snapshot_block(
    number: Column, time_text: Column, feature_lines: Column, code: Column
) -> Column:
    """One snapshot of the prompt: title with its clock, changing values, the code in a fence."""
    values = F.when(F.size(feature_lines) > 0, F.array_join(feature_lines, "; ")).otherwise(F.lit(NOTHING_CHANGES))
    return F.concat(
        F.lit("### Snapshot "), number, F.lit(", second "), time_text, F.lit("\nChanging values: "), values,
        F.lit("\n~~~\n"), code, F.lit("\n~~~\n"),
    )
