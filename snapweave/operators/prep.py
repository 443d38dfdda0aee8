"""Preprocessing: fitted on train rows, applied to all rows.

Each ``fit_*`` runs one small aggregate (or two, for exact percentiles) and keeps only
per-column numbers on the driver; each ``apply`` is a lazy projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from snapweave.operators.aggregates import column_profile
from snapweave.operators.ordering import HOT_ROWS, POS, cumulate_by_slices, model_order, number_rows
from snapweave.schema import KEYS

UNKNOWN = "UNK"


def numeric_columns(df: DataFrame, exclude: Sequence[str] = (*KEYS, "label", "split", "fold")) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def text_columns(df: DataFrame, exclude: Sequence[str] = (*KEYS, "label", "split", "fold")) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


# --- percentiles of whole columns -------------------------------------------------


def column_percentiles(
    df: DataFrame, columns: Sequence[str], points: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """Exact linear-interpolation percentiles of whole columns: feature, point, value.

    No column is sorted. Mergeable sketches bracket every wanted rank; then the distinct
    values inside the brackets, a few ``1/accuracy`` of the rows, are tallied together
    with one total for each gap between brackets, and added up in slices, so no task holds
    a column. Columns with fewer than ``accuracy`` values are tallied whole. A rank that its
    bracket misses is an error, not a missing value.
    """
    columns, points = list(columns), list(points)
    margin = 4.0 / accuracy
    bounds = [min(1.0, max(0.0, p + s)) for p in points for s in (-margin, margin)]
    long = (
        df.select(*[F.col(c).cast("double") for c in columns])
        .unpivot([], columns, "feature", "value")
        .filter("value IS NOT NULL")
    )
    low, high, at = F.col("low"), F.col("high"), F.col("at")
    around = [
        F.struct(
            (low if p <= margin else at[2 * j]).alias("lo"), (high if p >= 1 - margin else at[2 * j + 1]).alias("hi")
        )
        for j, p in enumerate(points)
    ]
    everything = F.array(F.struct(low.alias("lo"), high.alias("hi")))
    # One row per column.
    brackets = (
        long.groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.percentile_approx("value", bounds, accuracy).alias("at"),
        )
        .select("feature", "n", F.when(F.col("n") < accuracy, everything).otherwise(F.array(*around)).alias("spans"))
    )
    value = F.col("value")
    inside = F.exists("spans", lambda b: (value >= b["lo"]) & (value <= b["hi"]))
    gap = F.size(F.filter("spans", lambda b: b["hi"] < value))
    tally = (
        long.join(F.broadcast(brackets), "feature")
        .withColumn("inside", inside)
        .groupBy(
            "feature",
            "n",
            F.when(F.col("inside"), value).alias("exact"),
            F.when(~F.col("inside"), gap).alias("gap"),
        )
        .agg(F.count(F.lit(1)).alias("rows"), F.max("value").alias("top"))
    )
    placed = cumulate_by_slices(tally, ["feature"], "top", "rows")
    missed = F.raise_error(F.lit("a percentile lies outside the bracket of its sketch: ask for more accuracy"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("point")
    return (
        placed.select("*", wanted)
        .withColumn("rank", F.col("point") * (F.col("n") - 1))
        .filter("_before + rows > floor(rank) AND _before <= ceil(rank)")
        .withColumn("exact", F.coalesce("exact", missed.cast("double")))
        .groupBy("feature", "point", "rank")
        .agg(F.min("exact").alias("low"), F.max("exact").alias("high"))
        .select(
            "feature", "point", (low + (high - low) * (F.col("rank") - F.floor("rank"))).alias("value")
        )
    )


# --- missing values ----------------------------------------------------------------


@dataclass(frozen=True)
class Fill:
    """One replacement value per column."""

    values: dict[str, float | str]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.values.items()})


def fit_mean_fill(train: DataFrame, columns: Sequence[str]) -> Fill:
    """Train mean; 0 where a column has no value at all."""
    if not columns:
        return Fill({})
    means = _per_column(train, columns, "avg(`{0}`)")
    return Fill({c: m if m is not None else 0.0 for c, m in means.items()})


def fit_median_fill(train: DataFrame, columns: Sequence[str]) -> Fill:
    """Exact train median; columns without a value stay missing."""
    if not columns:
        return Fill({})
    found = {r["feature"]: r["value"] for r in column_percentiles(train, columns, [0.5]).collect()}
    return Fill({c: found[c] for c in columns if c in found})


def global_mean_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean over all rows, test rows included. This leaks; it exists to repeat the plain baseline."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("means")).scalar()
    return (
        df.withColumn("_means", means)
        .withColumns({c: F.coalesce(F.col(c), F.col(f"_means.{c}")) for c in columns})
        .drop("_means")
    )


def fill_unknown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in columns})


# --- column filters ----------------------------------------------------------------


@dataclass(frozen=True)
class ColumnChoice:
    kept: list[str]
    dropped: dict[str, str]
    report: DataFrame
    fill: Fill | None = None


def judge_columns(
    profile: DataFrame,
    max_missing: float = 0.25,
    min_variance: float = 1e-4,
    strict: bool = True,
    min_distinct: int = 2,
    max_distinct: int = 20,
) -> DataFrame:
    """Status per profiled column: kept, or the first rule that drops it.

    ``strict`` drops a variance below the bound, otherwise at or below it.
    """
    variance = F.col("variance")
    low = variance < min_variance if strict else variance <= min_variance
    numeric = F.col("kind") == "numeric"
    return profile.withColumn(
        "status",
        F.when(F.col("missing_rate") > max_missing, "missing")
        .when(numeric & low, "low_variance")
        .when(~numeric & ~F.col("n_distinct").between(min_distinct, max_distinct), "cardinality")
        .otherwise("kept"),
    )


def _choose(report: DataFrame, order: Sequence[str], fill: Fill | None = None) -> ColumnChoice:
    status = {r["feature"]: r["status"] for r in report.select("feature", "status").collect()}
    kept = [c for c in order if status[c] == "kept"]
    return ColumnChoice(
        kept=kept,
        dropped={c: status[c] for c in order if status[c] != "kept"},
        report=report,
        fill=fill and Fill({c: v for c, v in fill.values.items() if c in kept}),
    )


def choose_snapshot_columns(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), **rules
) -> ColumnChoice:
    """Sequence-model rules: variance over the values that are present, below 1e-4 drops."""
    report = judge_columns(column_profile(train, numeric, categorical), **rules)
    return _choose(report, [*numeric, *categorical])


def choose_session_columns(
    train: DataFrame, numeric: Sequence[str], max_missing: float = 0.25, min_variance: float = 1e-5
) -> ColumnChoice:
    """Session-model rules: variance after the median fill, at or below 1e-5 drops."""
    if not numeric:
        raise ValueError("no candidate columns")
    rates = _per_column(train, numeric, "avg(CAST(`{0}` IS NULL AS DOUBLE))")
    fill = fit_median_fill(train, [c for c in numeric if rates[c] is not None and rates[c] <= max_missing])
    variances = _per_column(fill.apply(train), numeric, "var_samp(`{0}`)")
    rows = [(c, "numeric", rates[c], variances[c], None) for c in numeric]
    profile = train.sparkSession.createDataFrame(
        rows, "feature string, kind string, missing_rate double, variance double, n_distinct long"
    )
    return _choose(judge_columns(profile, max_missing, min_variance, strict=False), numeric, fill)


def _per_column(df: DataFrame, columns: Sequence[str], formula: str) -> dict[str, float | None]:
    """One aggregate row: the same formula for every column."""
    row = df.agg(*[F.expr(formula.format(c)).alias(f"v_{i}") for i, c in enumerate(columns)]).first()
    return dict(zip(columns, row))


# --- scaling, encoding, vectors ------------------------------------------------------


@dataclass(frozen=True)
class Scaler:
    """(x - mean) / population sd; a constant column is only centred."""

    mean: dict[str, float]
    scale: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(self.scale[c]) for c, m in self.mean.items()})


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> Scaler:
    if not columns:
        return Scaler({}, {})
    row = train.agg(
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)],
    ).first()
    return Scaler(
        {c: row[f"m_{i}"] or 0.0 for i, c in enumerate(columns)},
        {c: row[f"s_{i}"] or 1.0 for i, c in enumerate(columns)},
    )


def padded_sequences(
    df: DataFrame,
    features: Sequence[str],
    maxlen: int,
    order: Sequence[Column] | None = None,
    keys: Sequence[str] = KEYS,
    carry: Sequence[str] = (),
    hot_rows: int | None = HOT_ROWS,
    width: int | None = None,
) -> DataFrame:
    """One array of ``maxlen`` feature arrays per session: earliest rows kept, zero rows appended.

    With a ``width``, ``features`` is a single column that holds arrays of so many numbers. ``length`` says
    how many rows are real. Rows past ``maxlen`` are dropped before anything is collected, so a
    group is never larger than the padded result.
    """
    order = order or model_order(df)
    vector = F.col(*features) if width else F.array(*[F.col(f).cast("double") for f in features])
    rows = (
        number_rows(df, keys, order, hot_rows=hot_rows)
        .filter(F.col(POS) < maxlen)
        .select(*keys, *carry, POS, vector.alias("_vector"))
    )
    steps = F.transform(F.array_sort(F.collect_list(F.struct(POS, "_vector"))), lambda s: s["_vector"])
    zero = F.array_repeat(F.lit(0.0), width or len(features))
    packed = rows.groupBy(*keys).agg(steps.alias("_steps"), *[F.min_by(c, POS).alias(c) for c in carry])
    gap = F.greatest(F.lit(0), F.lit(maxlen) - F.size("_steps"))
    packed = packed.withColumn("length", F.size("_steps"))
    return packed.withColumn("sequence", F.concat("_steps", F.array_repeat(zero, gap))).drop("_steps")


# --- choice by mutual information -----------------------------------------------------


def quantile_edges(train: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Distinct inner bin edges per column from exact train percentiles: feature, edges."""
    cuts = column_percentiles(train, columns, [i / bins for i in range(1, bins)])
    return cuts.groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("edges"))


def binned_labels(df: DataFrame, edges: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """Counts per (feature, bin, label); a value's bin is the number of edges below it.

    ``edges`` has one row per column, which bounds the broadcast.
    """
    long = df.select(F.col(label).alias("label"), *[F.col(c).cast("double") for c in columns]).unpivot(
        "label", list(columns), "feature", "value"
    )
    below = F.size(F.filter("edges", lambda e: e < F.col("value")))
    return (
        long.join(F.broadcast(edges), "feature")
        .groupBy("feature", F.when(F.col("value").isNotNull(), below).alias("bin"), "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def mutual_information(cells: DataFrame) -> DataFrame:
    """Mutual information (nats) of bin and label per feature.

    Works on the counts, whose number is bounded by features x bins x labels.
    """
    by_bin = Window.partitionBy("feature", "bin")
    by_label = Window.partitionBy("feature", "label")
    whole = Window.partitionBy("feature")
    n, total = F.col("n").cast("double"), F.sum("n").over(whole)
    term = n / total * F.log(n * total / (F.sum("n").over(by_bin) * F.sum("n").over(by_label)))
    return cells.withColumn("_term", term).groupBy("feature").agg(F.sum("_term").alias("mi"))


def choose_by_information(
    train: DataFrame, columns: Sequence[str], k: int | None, label: str = "label", bins: int = 10
) -> list[str]:
    """The ``k`` columns that tell most about the label; None keeps all."""
    if k is None or k >= len(columns):
        return list(columns)
    cells = binned_labels(train, quantile_edges(train, columns, bins), columns, label)
    scores = mutual_information(cells)
    best = scores.orderBy(F.col("mi").desc(), "feature").limit(k).collect()
    chosen = {r["feature"] for r in best}
    return [c for c in columns if c in chosen]


def label_codes(train: DataFrame, label: str = "label") -> DataFrame:
    """Alphabetical label codes 0..k-1, one row per class."""
    names = train.select(label).filter(F.col(label).isNotNull()).distinct()
    ranked = names.agg(F.array_sort(F.collect_set(label)).alias("names"))
    return ranked.select(F.posexplode("names").alias("label_index", label))


def encode_labels(df: DataFrame, codes: DataFrame, label: str = "label") -> DataFrame:
    """Join the codes; a label that was not fitted raises when the row is read."""
    joined = df.join(codes, label, "left")
    problem = F.raise_error(F.concat(F.lit("label was not seen in fit: "), F.col(label)))
    return joined.withColumn(
        "label_index",
        F.when(F.col("label_index").isNull() & F.col(label).isNotNull(), problem.cast("int")).otherwise(
            F.col("label_index")
        ),
    )
