"""Train, validation and test splits that never put one user on two sides.

Users are drawn by a seeded hash of their id, so a split is a plain column: no
shuffle, no state, the same on every run and for rows that arrive later. The exact
variants need a total order and number users or sessions in slices, never in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from snapweave.operators.ordering import POS, SIZE, global_positions, number_by_slices
from snapweave.schema import KEYS

TRAIN, VALIDATION, TEST = "train", "validation", "test"

_HASH_RANGE = 16**8


def draw(seed: int | str, *columns: Column | str) -> Column:
    """Seeded hash of the columns as 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns]))


def share_cut(share: float) -> str:
    """The 8-digit hex bound below which a hash falls with probability ``share``."""
    return f"{int(share * _HASH_RANGE):08x}"


def in_share(hash_: Column, share: float) -> Column:
    return F.substring(hash_, 1, 8) < share_cut(share)


def split_by_user(
    df: DataFrame,
    seed: int = 42,
    test_share: float = 0.2,
    user: str = "user_id",
    out: str = "split",
    exact: bool = False,
) -> DataFrame:
    """Add ``split``. ``exact`` puts ceil(share x users) users into test, else the share holds on average."""
    if not exact:
        return df.withColumn(
            out, F.when(in_share(draw(seed, user), test_share), F.lit(TEST)).otherwise(F.lit(TRAIN))
        )
    users = df.select(user).filter(F.col(user).isNotNull()).distinct().withColumn("_draw", draw(seed, user))
    placed = global_positions(users, [F.col("_draw"), F.col(user)])
    test = placed.filter(F.col(POS) < F.ceil(F.lit(test_share) * F.col(SIZE))).select(
        user, F.lit(TEST).alias(out)
    )
    return df.join(test, user, "left").withColumn(out, F.coalesce(out, F.lit(TRAIN)))


def split_by_list(
    df: DataFrame, test_users: Sequence[str], user: str = "user_id", out: str = "split"
) -> DataFrame:
    return df.withColumn(
        out, F.when(F.col(user).isin(list(test_users)), F.lit(TEST)).otherwise(F.lit(TRAIN))
    )


def with_validation(
    df: DataFrame,
    seed: int = 42,
    share: float = 0.2,
    user: str = "user_id",
    out: str = "split",
) -> DataFrame:
    """Move a share of the train users to validation, by a hash independent of the test draw."""
    chosen = (F.col(out) == TRAIN) & in_share(draw(f"{seed}:val", user), share)
    return df.withColumn(out, F.when(chosen, F.lit(VALIDATION)).otherwise(F.col(out)))


def lost_classes(df: DataFrame, label: str = "label", out: str = "split") -> DataFrame:
    """Labels of train + validation that occur in validation only."""
    pool = df.filter(F.col(out).isin(TRAIN, VALIDATION))
    return (
        pool.groupBy(label)
        .agg(F.count_if(F.col(out) == TRAIN).alias("_in_train"))
        .filter("_in_train = 0")
        .select(label)
    )


def stratified_validation(
    df: DataFrame,
    seed: int = 42,
    share: float = 0.2,
    label: str = "label",
    keys: Sequence[str] = KEYS,
    out: str = "split",
) -> DataFrame:
    """Validation = round(share x n) train sessions of every label, in hash order.

    A label can hold most sessions, so each label is numbered in slices.
    """
    pool = df.filter(F.col(out) == TRAIN).select(*keys, label)
    drawn = pool.withColumn("_draw", draw(f"{seed}:strat", *keys))
    placed = number_by_slices(drawn, [label], [F.col("_draw"), *[F.col(k) for k in keys]])
    chosen = placed.filter(F.col(POS) < F.round(F.lit(share) * F.col(SIZE))).select(
        *keys, F.lit(VALIDATION).alias("_moved")
    )
    return df.join(chosen, list(keys), "left").withColumn(out, F.coalesce("_moved", out)).drop("_moved")


def train_validation(df: DataFrame, seed: int = 42, share: float = 0.2, label: str = "label") -> DataFrame:
    """Validation by user; stratified by label instead if that would lose a class from train."""
    grouped = with_validation(df, seed, share)
    if lost_classes(grouped, label).isEmpty():
        return grouped
    return stratified_validation(df, seed, share, label)


def tail_validation(
    df: DataFrame, share: float = 0.15, keys: Sequence[str] = KEYS, out: str = "split"
) -> DataFrame:
    """Validation = the last ``share`` of the train sessions in key order."""
    placed = global_positions(df.filter(F.col(out) == TRAIN).select(*keys), [F.col(k) for k in keys])
    tail = placed.filter(F.col(POS) >= F.floor(F.col(SIZE) * F.lit(1 - share))).select(
        *keys, F.lit(VALIDATION).alias("_moved")
    )
    return df.join(tail, list(keys), "left").withColumn(out, F.coalesce("_moved", out)).drop("_moved")


def user_folds(
    df: DataFrame, k: int = 5, seed: int = 42, user: str = "user_id", out: str = "fold"
) -> DataFrame:
    """Fold 0..k-1 by user hash."""
    number = F.conv(F.substring(draw(f"{seed}:fold", user), 1, 8), 16, 10).cast("long")
    return df.withColumn(out, (number % k).cast("int"))


def balanced_user_folds(
    df: DataFrame, k: int = 5, user: str = "user_id", out: str = "fold"
) -> DataFrame:
    """Users sorted by row count and dealt in snake order, so folds have near-equal row counts."""
    sizes = df.filter(F.col(user).isNotNull()).groupBy(user).agg(F.count(F.lit(1)).alias("_rows"))
    placed = global_positions(sizes, [F.col("_rows").desc(), F.col(user).asc()])
    turn, seat = F.floor(F.col(POS) / k), F.col(POS) % k
    fold = F.when(turn % 2 == 0, seat).otherwise(k - 1 - seat).cast("int")
    return df.join(placed.select(user, fold.alias(out)), user, "left")


def fold_count(users: int, wanted: int = 5) -> int:
    return min(wanted, users)


def grouped_folds(df: DataFrame, wanted: int = 5, user: str = "user_id", out: str = "fold") -> tuple[DataFrame, int]:
    """Balanced folds that never split a user, as many as there are users but at most ``wanted``; none is empty."""
    k = fold_count(df.filter(F.col(user).isNotNull()).select(user).distinct().count(), wanted)
    if k < 2:
        raise ValueError("folds by user need two users")
    return balanced_user_folds(df.drop(out), k, user, out), k
