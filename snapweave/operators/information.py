"""Mutual information of a number and a label by nearest neighbours, without bins.

For each value the distance r to its k-th nearest neighbour of the same label, then the number m of values of any
label within r: ``psi(N) + mean psi(k) - mean psi(rows of the label) - mean psi(m)``, psi being the
digamma function. One column has one order, so neighbours are sorted neighbours and counts are
differences of ranks. Equal values are tallied first and carry their number; orders are cut into
slices, so neither a column nor a label nor a frequent value is held by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from snapweave.operators.ordering import POS, cumulate_by_slices, number_by_slices
from snapweave.runtime import materialize

BLOCK = 100_000  # values whose neighbours one window looks up


def digamma(n: Column) -> Column:
    """Of a whole number from 1 on, to 12 digits: the recurrence up to n + 6, then the asymptotic series."""
    z = n.cast("double") + 6
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6)
    steps = [1 / (n.cast("double") + i) for i in range(6)]
    return series - sum(steps[1:], steps[0])


def label_tally(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """``feature, label, value, n`` over rows with a label and a value; labels with a single row of a feature are left out."""
    long = df.select(F.col(label).alias("label"), *[F.col(c).cast("double") for c in columns]).filter("label IS NOT NULL")
    cells = long.unpivot("label", list(columns), "feature", "value").filter("value IS NOT NULL AND NOT isnan(value)")
    tally = cells.groupBy("feature", "label", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = tally.groupBy("feature", "label").agg(F.sum("n").alias("of_label"))
    return tally.join(F.broadcast(totals.filter("of_label > 1")), ["feature", "label"])  # features times labels


def with_radius(tally: DataFrame, k: int = 3, block: int = BLOCK) -> DataFrame:
    """Add ``k`` (neighbours there are, at most the wanted number) and ``r``, the distance to the last of them.

    A window reads a block of the order and the k values before and after it. ``tally`` is read several times.
    """
    numbered = number_by_slices(tally, ["feature", "label"], [F.col("value")], written=True)
    at = F.expr(f"{POS} div {block}")
    near = F.array_distinct(F.array(F.expr(f"({POS} - {k}) div {block}"), at, F.expr(f"({POS} + {k}) div {block}")))
    spread = numbered.withColumn("home", at).withColumn("part", F.explode(near)).filter("part >= 0")
    order = Window.partitionBy("feature", "label", "part").orderBy(POS)

    def beside(shift: int) -> Column:
        value, n = (F.lag(c, shift).over(order) if shift > 0 else F.lead(c, -shift).over(order) for c in ("value", "n"))
        return F.struct(F.abs(value - F.col("value")).alias("d"), n.alias("n"))

    wide = spread.withColumn("beside", F.array(*[beside(s * j) for j in range(1, k + 1) for s in (1, -1)])).filter("home = part")
    wanted = F.least(F.lit(k), F.col("of_label") - 1)
    sorted_ = F.array_sort(F.filter("beside", lambda b: b["n"].isNotNull()))
    # Copies of the value come first, at distance 0; then the nearest until there are enough.
    start = F.struct((F.col("n") - 1).alias("have"), F.lit(0.0).alias("r"))
    reached = F.aggregate(
        sorted_,
        start,
        lambda a, b: F.when(a["have"] >= wanted, a).otherwise(F.struct((a["have"] + b["n"]).alias("have"), b["d"].alias("r"))),
    )
    return wide.select("feature", "label", "value", "n", "of_label", wanted.alias("k"), reached["r"].alias("r"))


def neighbour_information(df: DataFrame, columns: Sequence[str], label: str = "label", k: int = 3) -> DataFrame:
    """``feature, mi`` (nats, never below 0) for every column that has two rows of one label; others are absent.

    A value at exactly the distance of the last neighbour does not count as within it; equal values always do.
    """
    tally = materialize(label_tally(df, columns, label), "tally")
    found = with_radius(tally, k)
    cells = found.groupBy("feature", "value", "r", "k", "of_label").agg(F.sum("n").alias("n"))
    shrunk = F.col("r") * (1 - 1e-9)
    cells = materialize(cells.withColumns({"low": F.col("value") - shrunk, "high": F.col("value") + shrunk}), "radius")
    # Values between the ends of the queries, in one order: a low end before equal values, a high end behind them.
    at = lambda value, kind: F.struct(F.col(value).alias("v"), F.lit(kind).alias("kind")).alias("at")
    none = F.lit(0).cast("bigint").alias("n")
    values = tally.groupBy("feature", "value").agg(F.sum("n").alias("n")).select("feature", at("value", 1), "n")
    lows = cells.select("feature", at("low", 0), none).distinct()
    highs = cells.select("feature", at("high", 2), none).distinct()
    ranked = cumulate_by_slices(values.unionByName(lows).unionByName(highs), ["feature"], "at", "n")
    ranked = ranked.filter("at.kind <> 1").select("feature", "at", "_before")
    below = ranked.filter("at.kind = 0").select("feature", F.col("at.v").alias("low"), F.col("_before").alias("below"))
    upto = ranked.filter("at.kind = 2").select("feature", F.col("at.v").alias("high"), F.col("_before").alias("upto"))
    counted = cells.join(below, ["feature", "low"]).join(upto, ["feature", "high"]).withColumn("m", F.col("upto") - F.col("below"))
    n = F.sum("n").cast("double")
    term = F.col("n") * (digamma(F.col("k")) - digamma(F.col("of_label")) - digamma(F.col("m")))
    return counted.groupBy("feature").agg(F.greatest(F.lit(0.0), digamma(F.sum("n")) + F.sum(term) / n).alias("mi"))


def choose_by_neighbours(df: DataFrame, columns: Sequence[str], k: int, label: str = "label") -> list[str]:
    """The ``k`` columns that tell most about the label; ties by name."""
    best = neighbour_information(df, columns, label).orderBy(F.desc(F.round("mi", 9)), "feature").limit(k).collect()
    chosen = {row["feature"] for row in best}
    return [c for c in columns if c in chosen]
