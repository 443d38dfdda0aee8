"""Row numbers and neighbours in session order, also where one session is huge.

A window partitioned by session puts a whole session into one task. That is the
right plan for ordinary sessions and the wrong one for a session that holds a large
share of the table, so rows are numbered in two ways:

* sessions of at most ``hot_rows`` rows: one shuffle by session, one sort, one window;
* larger ones: range-partitioned over (session, order), so that a session is cut
  into slices of bounded size; slices are numbered on their own and shifted by the
  row counts of the slices before them.

Both order by the columns as they are and fill missing values afterwards, so both give
the same numbers. Which sessions are large is found by one count per session, combined
before the shuffle. Rows without a key belong to no session and are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from snapweave.runtime import materialize
from snapweave.schema import KEYS

HOT_ROWS = 250_000
# Rows of one slice of a huge session, and session keys that a broadcast may carry.
SLICE_ROWS = 250_000
BROADCAST_KEYS = 100_000

POS, SIZE = "_pos", "_n"


def order_by(df: DataFrame, prefer: Sequence[str], tiebreak: Sequence[str] = ()) -> list[Column]:
    """Sort columns: the first preferred column that exists, missing values last, then tiebreaks."""
    lead = next((c for c in prefer if c in df.columns), None)
    names = ([lead] if lead else []) + [c for c in tiebreak if c in df.columns and c != lead]
    if not names:
        raise ValueError(f"none of {list(prefer)} is a column, so the session has no order")
    return [F.col(c).asc_nulls_last() for c in names]


def model_order(df: DataFrame, tiebreak: Sequence[str] = ("event_id",)) -> list[Column]:
    return order_by(df, ["snapshot_sequence_num", "seconds_from_start"], tiebreak)


def prompt_order(df: DataFrame, tiebreak: Sequence[str] = ("event_id",)) -> list[Column]:
    return order_by(df, ["seconds_from_start", "snapshot_time"], tiebreak)


def previous(name: str) -> str:
    return f"{name}__prev"


def group_mean(name: str) -> str:
    return f"{name}__mean"


def with_keys_present(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that belong to a session: no part of the key is missing."""
    return df.dropna("any", subset=list(keys)) if keys else df


@dataclass(frozen=True)
class Huge:
    """Sessions above ``hot_rows``: their keys (to be broadcast only if few) and the number of their rows."""

    keys: DataFrame
    rows: int
    few: bool = False

    @property
    def slices(self) -> int:
        return max(2, -(-self.rows // SLICE_ROWS))


def hot_sessions(
    df: DataFrame, keys: Sequence[str] = KEYS, hot_rows: int | None = HOT_ROWS, counted: DataFrame | None = None
) -> Huge | None:
    """The sessions above ``hot_rows`` rows, or None. Needs the key columns only. Where ``df`` is a join that
    repeats no row, hand over the table before it as ``counted``, so that the join does not run for this look.
    ``hot_rows=None`` skips the look, for input whose sessions are known to be small.
    """
    if hot_rows is None:
        return None
    sizes = (df if counted is None else counted).groupBy(*keys).count()
    large = materialize(sizes.filter(F.col("count") > hot_rows), "hot-sessions")
    found = large.agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("rows")).first()
    if not found["n"]:
        return None
    named = large.select(*keys)
    few = found["n"] <= BROADCAST_KEYS
    return Huge(F.broadcast(named) if few else named, found["rows"], few)


def split_hot(
    df: DataFrame, keys: Sequence[str] = KEYS, hot_rows: int | None = HOT_ROWS, counted: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None, Huge | None]:
    """(rows of ordinary sessions, rows of huge sessions or None, which those are)."""
    hot = hot_sessions(df, keys, hot_rows, counted)
    if hot is None:
        return df, None, None
    keys = list(keys)
    return df.join(hot.keys, keys, "left_anti"), df.join(hot.keys, keys, "left_semi"), hot


def number_by_window(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    lags: Sequence[str] = (),
    fill: Sequence[str] = (),
) -> DataFrame:
    """One shuffle by key and one sort serve the mean, the row number, the size and the lags.

    Filled values replace their columns only at the end: the sort columns may be among
    them, and a sort column that changes between two windows would cost a second sort.
    """
    ordered = Window.partitionBy(*keys).orderBy(*order)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.withColumns(
        {group_mean(c): F.avg(c).over(whole) for c in fill}
        | {POS: F.row_number().over(ordered).cast("long") - 1, SIZE: F.count(F.lit(1)).over(whole)}
    )
    names = {c: filled(c) for c in fill}
    out = out.withColumns({new: F.coalesce(F.col(c), F.col(group_mean(c))) for c, new in names.items()})
    out = out.withColumns({previous(c): F.lag(names.get(c, c)).over(ordered) for c in lags})
    return out.drop(*names).withColumnsRenamed({new: c for c, new in names.items()})


def _ready_to_slice(df: DataFrame, slices: int | None, written: bool) -> tuple[DataFrame, int]:
    """The rows, from files, and the number of slices."""
    if not written:
        df = materialize(df, "unsliced")
    fewest = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df, slices or max(fewest, -(-df.count() // SLICE_ROWS))


def number_by_slices(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    lags: Sequence[str] = (),
    slices: int | None = None,
    written: bool = False,
) -> DataFrame:
    """Same columns as :func:`number_by_window`, with no task that holds a whole group.

    ``keys`` may be empty: then the whole table is numbered in one global order. Without a
    number of ``slices`` the rows are counted, so that a slice stays of bounded size. The input is
    written before it is counted and sampled, unless it is ``written`` already. The sliced rows are
    written too, because range bounds come from a sample and a second run of the same plan could cut elsewhere.
    """
    keys = list(keys)
    df, slices = _ready_to_slice(df, slices, written)
    cut = (
        df.repartitionByRange(slices, *[F.col(k) for k in keys], *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    cut = materialize(cut, "slices")
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    numbered = cut.withColumn("_local", F.row_number().over(within).cast("long") - 1)

    # One row per (group, slice): bounded by the number of slices, not by the rows.
    heads = numbered.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"),
        *([F.max_by(F.struct(*lags), "_local").alias("_tail")] if lags else []),
    )
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    offsets = heads.select(
        *keys,
        "_slice",
        (F.sum("_rows").over(by_slice) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias(SIZE),
        *([F.lag("_tail").over(by_slice).alias("_tail")] if lags else []),
    )
    out = numbered.join(offsets, [*keys, "_slice"]).withColumn(POS, F.col("_local") + F.col("_before"))
    if lags:
        out = out.withColumns(
            {
                previous(c): F.when(F.col("_local") == 0, F.col(f"_tail.{c}")).otherwise(
                    F.lag(c).over(within)
                )
                for c in lags
            }
        )
    return out.drop("_slice", "_local", "_before", "_tail")


def filled(name: str) -> str:
    return f"{name}__filled"


def fill_with_group_mean(df: DataFrame, keys: Sequence[str], columns: Sequence[str], few: bool = False) -> DataFrame:
    """``<c>__mean`` and ``<c>__filled`` by aggregate and join, for groups too large for a window.

    The columns themselves stay as they are, for an order may rest on them. ``few`` groups are broadcast, so that
    the rows of a group do not meet in one task.
    """
    if not columns:
        return df
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(group_mean(c)) for c in columns])
    out = df.join(F.broadcast(means) if few else means, list(keys))
    return out.withColumns({filled(c): F.coalesce(F.col(c), F.col(group_mean(c))) for c in columns})


def number_huge(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slices: int,
    lags: Sequence[str] = (),
    fill: Sequence[str] = (),
    few: bool = False,
) -> DataFrame:
    """:func:`number_by_window` for huge sessions: numbered in the order of the raw columns, filled before the lag."""
    ready = fill_with_group_mean(df, keys, fill, few)
    of = {c: filled(c) if c in fill else c for c in lags}
    out = number_by_slices(ready, keys, order, list(of.values()), slices)
    renamed = {previous(old): previous(c) for c, old in of.items()} | {filled(c): c for c in fill}
    return out.drop(*fill).withColumnsRenamed(renamed)


def number_rows(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    order: Sequence[Column] | None = None,
    lags: Sequence[str] = (),
    fill: Sequence[str] = (),
    hot_rows: int | None = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add ``_pos`` (0-based) and ``_n``; per lag column ``<c>__prev``; per fill column ``<c>__mean`` and
    the session mean where the value is missing (applied before the lag, never to the order).
    Rows without a key are left out."""
    order = list(order or model_order(df))
    usual, huge, hot = split_hot(with_keys_present(df, keys), keys, hot_rows, counted)
    out = number_by_window(usual, keys, order, lags, fill)
    if huge is None:
        return out
    return out.unionByName(number_huge(huge, keys, order, hot.slices, lags, fill, hot.few))


def cumulate_by_slices(
    df: DataFrame, keys: Sequence[str], order: str, weight: str, slices: int | None = None, written: bool = False
) -> DataFrame:
    """Add ``_before`` (weights of the group's rows before this one) and ``_total``, with no task that holds a group.

    ``order`` must not repeat within a group, so that a slice border can fall between any two rows.
    """
    keys = list(keys)
    df, slices = _ready_to_slice(df, slices, written)
    cut = df.repartitionByRange(slices, *keys, order).withColumn("_slice", F.spark_partition_id())
    cut = materialize(cut, "slices")
    within = Window.partitionBy(*keys, "_slice").orderBy(order)
    running = cut.withColumn("_local", F.sum(weight).over(within) - F.col(weight))
    heads = cut.groupBy(*keys, "_slice").agg(F.sum(weight).alias("_sum"))
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    offsets = heads.select(
        *keys,
        "_slice",
        (F.sum("_sum").over(by_slice) - F.col("_sum")).alias("_ahead"),
        F.sum("_sum").over(Window.partitionBy(*keys)).alias("_total"),
    )
    out = running.join(offsets, [*keys, "_slice"])
    return out.withColumn("_before", F.col("_local") + F.col("_ahead")).drop("_slice", "_local", "_ahead")


def global_positions(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Number the whole table in one order; the count of slices is the only thing one task sees."""
    return number_by_slices(df, [], order)
