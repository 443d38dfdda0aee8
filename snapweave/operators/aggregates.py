"""Per-session aggregates and the summaries built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from snapweave.operators.ordering import (
    HOT_ROWS,
    POS,
    SIZE,
    cumulate_by_slices,
    fill_with_group_mean,
    filled,
    group_mean,
    model_order,
    number_by_window,
    number_huge,
    previous,
    split_hot,
    with_keys_present,
)
from snapweave.runtime import materialize
from snapweave.schema import KEYS, SNAPSHOT_FEATURES

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
_CLOCK, _SEQ = "_clock", "_seq"


def _plain_statistics(f: str) -> list[Column]:
    """Everything about one feature that merges from partial results.

    Written with as few buffers as possible: a session row carries its mean, and row
    numbers have a known mean and spread, so deviation and slope are single sums.
    """
    diff = f"(`{f}` - `{previous(f)}`)"
    deviation = f"(`{f}` - `{group_mean(f)}`)"
    size = f"max(`{SIZE}`)"
    formulas = {
        "mean": f"max(`{group_mean(f)}`)",
        "std": f"sqrt(avg({deviation} * {deviation}))",
        "min": f"min(`{f}`)",
        "max": f"max(`{f}`)",
        "diff_mean": f"avg({diff})",
        "diff_std": f"stddev_pop({diff})",
        "diff_max": f"max(abs({diff}))",
        "trend": f"sum((`{POS}` - (`{SIZE}` - 1) / 2D) * `{f}`) / nullif({size} * ({size} * {size} - 1) / 12D, 0D)",
    }
    return [F.expr(text).alias(f"{f}_{name}") for name, text in formulas.items()]


def _sorted_values(f: str) -> Column:
    return F.expr(f"sort_array(collect_list(`{f}`))").alias(f"_{f}_sorted")


def _at_share(f: str, p: float) -> Column:
    """Linear interpolation in the sorted values of a session (at most ``hot_rows`` of them)."""
    values = f"`_{f}_sorted`"
    rank = f"({p}D * (size({values}) - 1))"
    low = f"int(floor({rank}))"
    below = f"get({values}, {low})"
    above = f"coalesce(get({values}, {low} + 1), {below})"
    return F.expr(f"{below} + ({above} - {below}) * ({rank} - {low})")


def _session_totals() -> list[Column]:
    n, step = F.max(SIZE), F.col(_CLOCK) - F.col(previous(_CLOCK))
    duration = F.when(n == 1, F.lit(0.0)).otherwise(F.max_by(_CLOCK, POS) - F.min_by(_CLOCK, POS))
    return [
        n.alias("sequence_length"),
        duration.alias("total_duration"),
        F.when(n == 1, F.lit(0.0)).otherwise(duration / (n - 1)).alias("avg_time_between"),
        F.when(n <= 2, F.lit(0.0))
        .when(F.count(step) == n - 1, F.stddev_pop(step))
        .alias("time_std"),
        F.max_by(_SEQ, POS).alias("final_snapshot_num"),
    ]


def exact_group_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    points: dict[str, float],
    slices: int | None = None,
) -> DataFrame:
    """Linear-interpolation percentiles of groups too large to sit in one task.

    Equal values are counted first, combined before the shuffle, so a value that most rows
    share is one row. The distinct values are added up in slices, and only those around
    each wanted rank are kept.
    """
    keys = list(keys)
    long = df.unpivot(keys, list(columns), "_feature", "_value").filter("_value IS NOT NULL")
    counts = long.groupBy(*keys, "_feature", "_value").agg(F.count(F.lit(1)).alias("_rows"))
    ranked = cumulate_by_slices(counts, [*keys, "_feature"], "_value", "_rows", slices)

    def at(p: float) -> Column:
        rank = F.lit(p) * (F.col("_total") - 1)
        low = F.floor(rank)

        def holds(n: Column) -> Column:
            return (n >= F.col("_before")) & (n < F.col("_before") + F.col("_rows"))

        share = F.when(holds(low), 1 - (rank - low)).otherwise(0.0) + F.when(holds(low + 1), rank - low).otherwise(0.0)
        return F.sum(share * F.col("_value"))

    per_feature = ranked.groupBy(*keys, "_feature").agg(*[at(p).alias(name) for name, p in points.items()])
    return per_feature.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_feature") == c, F.col(name))).alias(f"{c}_{name}")
            for c in columns
            for name in points
        ]
    )


def session_features(
    df: DataFrame,
    features: Sequence[str] | None = None,
    order: Sequence[Column] | None = None,
    keys: Sequence[str] = KEYS,
    carry: Sequence[str] = (),
    hot_rows: int | None = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """One wide row per session: 11 statistics per feature, durations and copies.

    A value missing inside a session is replaced by the session mean before every
    statistic, never in the order; durations use the raw clock. Rows without a key are left out. ``carry`` columns are constant per session
    (the label, say) and are taken from the session's first row. ``counted`` is the table before joins that repeat no
    row: huge sessions are then found without running the joins.
    """
    keys = list(keys)
    features = [f for f in (features or SNAPSHOT_FEATURES) if f in df.columns]
    usual_order = not order
    order = list(order or model_order(df))
    clock = "seconds_from_start" if "seconds_from_start" in df.columns else None
    seq = "snapshot_sequence_num" if "snapshot_sequence_num" in df.columns else None
    work = df.withColumns(
        {f: F.col(f).cast("double") for f in features}
        | {
            _CLOCK: F.col(clock).cast("double") if clock else F.lit(None).cast("double"),
            _SEQ: F.col(seq).cast("double") if seq else F.lit(None).cast("double"),
        }
    )
    counted = None if counted is None else with_keys_present(counted, keys)
    if usual_order:  # else it is not known what the order rests on
        needed = {*keys, *features, *carry, _CLOCK, _SEQ, "snapshot_sequence_num", "seconds_from_start", "event_id"}
        work = work.select(*[c for c in work.columns if c in needed])
    usual, huge, hot = split_hot(with_keys_present(work, keys), keys, hot_rows, counted)
    lags = [*features, _CLOCK]
    carried = [F.min_by(c, POS).alias(c) for c in carry]
    merged = [a for f in features for a in _plain_statistics(f)] + _session_totals() + carried

    numbered = number_by_window(usual, keys, order, lags=lags, fill=features)
    wide = numbered.groupBy(*keys).agg(*merged, *[_sorted_values(f) for f in features])
    wide = wide.withColumns(
        {f"{f}_{name}": _at_share(f, p) for f in features for name, p in QUARTILES.items()}
    ).drop(*[f"_{f}_sorted" for f in features])

    if huge is not None:
        huge = materialize(huge, "huge")  # four steps below read it, and it may be a join
        big = number_huge(huge, keys, order, hot.slices, lags, features, hot.few).groupBy(*keys).agg(*merged)
        ready = fill_with_group_mean(huge, keys, features, hot.few)
        values = ready.select(*keys, *[F.col(filled(f)).alias(f) for f in features])
        ranks = exact_group_percentiles(values, keys, features, QUARTILES, hot.slices * len(features))
        wide = wide.unionByName(big.join(ranks, keys, "left"))

    def copy_of(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0.0)) if column in wide.columns else F.lit(0.0)

    wide = wide.withColumns(
        {
            "avg_chars_per_snapshot": copy_of("chars_in_snapshot_mean"),
            "total_keystrokes": copy_of("keystrokes_before_snapshot_max"),
            "total_saves": copy_of("saves_before_snapshot_max"),
        }
    )
    absent = ([] if clock else ["total_duration", "avg_time_between", "time_std"]) + (
        [] if seq else ["final_snapshot_num"]
    )
    return wide.drop(*absent)


def population_counts(df: DataFrame, keys: Sequence[str] = KEYS, user: str = "user_id") -> DataFrame:
    """Rows, sessions and users; sessions are counted first, so users need no second expansion."""
    sessions = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return sessions.agg(
        F.sum("_rows").alias("snapshots"),
        F.count(F.lit(1)).alias("sessions"),
        F.count_distinct(user).alias("users"),
    )


def session_meta(
    df: DataFrame,
    order: Sequence[str],
    columns: Sequence[str] = ("label",),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Length and first-row values per session (the first row's value, also when missing)."""
    ranked = F.struct(*order)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seq_len"),
        *[F.min_by(c, ranked).alias(c) for c in columns],
    )


def first_present(
    df: DataFrame, columns: Sequence[str], order: Sequence[str], keys: Sequence[str] = KEYS
) -> DataFrame:
    """First value per session that is not missing, column by column."""
    ranked = F.struct(*order)
    return df.groupBy(*keys).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), ranked)).alias(c) for c in columns]
    )


def embedding_dim(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Length of the first non-empty array of the table, 0 if there is none."""
    size = F.size(column)
    first = F.min_by(size, F.when(size > 0, F.struct(*order)))
    return df.agg(F.coalesce(first, F.lit(0)).cast("int").alias("dim"))


def column_profile(
    df: DataFrame,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
) -> DataFrame:
    """Missing rate for every column, sample variance for numbers, distinct values for texts.

    Rates and variances of all columns come from one aggregate; distinct counts from one
    unpivoted pair count, combined before the shuffle.
    """
    columns = [*numeric, *categorical]
    if not columns:
        raise ValueError("no columns to profile")
    stats = df.agg(
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"m_{i}") for i, c in enumerate(columns)],
        *[F.var_samp(c).alias(f"v_{i}") for i, c in enumerate(numeric)],
    )
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit("numeric" if i < len(numeric) else "categorical").alias("kind"),
            F.col(f"m_{i}").alias("missing_rate"),
            (F.col(f"v_{i}") if i < len(numeric) else F.lit(None).cast("double")).alias("variance"),
        )
        for i, c in enumerate(columns)
    ]
    profile = stats.select(F.inline(F.array(*entries)))
    if not categorical:
        return profile.withColumn("n_distinct", F.lit(None).cast("long"))
    pairs = (
        df.select(*[F.col(c).cast("string") for c in categorical])
        .unpivot([], list(categorical), "feature", "_value")
        .filter("_value IS NOT NULL")
        .distinct()
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n_distinct"))
    )
    joined = profile.join(pairs, "feature", "left")
    return joined.withColumn(
        "n_distinct",
        F.when(F.col("kind") == "categorical", F.coalesce("n_distinct", F.lit(0).cast("long"))),
    )


def length_percentile(sessions: DataFrame, p: float, length: str = "seq_len", at_least: int = 2) -> DataFrame:
    """Padding length: floored percentile of session lengths, never below ``at_least``.

    Exact: distinct lengths are few (their sum is at most the row count, so there are at
    most about sqrt(2 x rows) of them), which bounds the percentile's buffer.
    """
    cut = F.floor(F.percentile(F.col(length), F.lit(p)))
    return sessions.agg(F.greatest(F.lit(at_least), F.coalesce(cut, F.lit(at_least))).cast("int").alias("maxlen"))


def label_distribution(df: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    """Count and percent per label within each ``by`` group (a split, a model)."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    return counts.join(totals, list(by)).select(
        *by, F.col(label).alias("label"), "n", (100.0 * F.col("n") / F.col("_total")).alias("percent")
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (classes x n_class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # One row per class from here on.
    folded = counts.agg(F.collect_list(F.struct(label, "n")).alias("c"), F.sum("n").alias("total"))
    classes = folded.select(F.explode("c").alias("c"), F.size("c").alias("k"), "total")
    return classes.select(
        F.col(f"c.{label}").alias(label),
        F.col("c.n").alias("n"),
        (F.col("total") / (F.col("k") * F.col("c.n"))).alias("weight"),
    )


def with_class_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    weights = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(weights, label, "left")


def session_summary(features: DataFrame) -> DataFrame:
    stats = [
        f(c).alias(f"{name}_{c}")
        for c in ("sequence_length", "total_duration")
        for name, f in (("avg", F.avg), ("min", F.min), ("max", F.max))
    ]
    return features.agg(F.count(F.lit(1)).alias("sessions"), *stats)


def intake_report(df: DataFrame, label: str = "label", keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows and sessions seen, and those that cannot be aggregated (missing key or label)."""
    no_key = F.greatest(*[F.col(k).isNull().cast("int") for k in keys]) == 1
    per_session = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.count(label).alias("_labelled")
    )
    return per_session.agg(
        F.sum("_rows").alias("rows_seen"),
        F.coalesce(F.sum(F.when(no_key, F.col("_rows"))), F.lit(0)).alias("rows_without_key"),
        F.coalesce(F.sum(F.when(~no_key, F.col("_rows") - F.col("_labelled"))), F.lit(0)).alias(
            "rows_without_label"
        ),
        F.count_if(~no_key).alias("sessions_seen"),
        F.count_if(~no_key & (F.col("_labelled") > 0)).alias("sessions_aggregated"),
    )
