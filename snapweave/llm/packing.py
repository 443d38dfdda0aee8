"""Best-fit packing of token sequences by linear grouping.

What is decided depends on lengths alone, and there are at most ``capacity`` lengths. So the
plan is made on the driver from one count per length, whatever the number of documents:

1. Large lengths are put in groups of equal cardinality and rounded up to the longest of
   their group.
2. The few rounded sizes are packed by configurations (how many of each size a sequence
   holds): a linear program over configurations, solved by column generation, rounded down.
3. The actual lengths take the places of the rounded ones, longest first within a group, but
   for the last place of each configuration. As a group's places are filled in order,
   sequences of one configuration fall into few runs of equal content, which is all the plan
   has to keep.
4. What is left, and then the small lengths, go where they fit best: into the run with the
   least room that still takes them, or into new sequences. Steps 3 and 4 are done for a few
   shares of the configurations' counts; the plan with the fewest sequences is used.

Spark numbers the pieces within their length and looks their places up in the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from snapweave.llm.rows import released
from snapweave.llm.tokens import WordCache, text_groups
from snapweave.runtime import materialize

GROUPS = 96  # rounded sizes
SMALL = 8  # lengths up to capacity / SMALL are small
SHARES = (1.0, 0.95, 0.8, 0.5)  # of the configurations' sequences that are kept; the best share is taken

_PIECES = "part int, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint"


# ---------------------------------------------------------------- plan, on lengths alone


@dataclass
class Run:
    """``count`` sequences with the same content: ``(length, first, each)`` takes ``each`` pieces of that
    length per sequence, from the piece numbered ``first`` on."""

    count: int
    room: int
    content: list[tuple[int, int, int]] = field(default_factory=list)

    def split(self, count: int) -> tuple[Run, Run]:
        later = [(length, first + each * count, each) for length, first, each in self.content]
        return Run(count, self.room, list(self.content)), Run(self.count - count, self.room, later)

    def put(self, length: int, first: int, each: int) -> Run:
        return Run(self.count, self.room - each * length, [*self.content, (length, first, each)])


def group_lengths(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths in falling order with counts, cut into groups of about equal cardinality; a length may be in two."""
    share = max(1, -(-sum(counts.values()) // groups))
    out: list[list[tuple[int, int]]] = [[]]
    room = share
    for length in sorted(counts, reverse=True):
        left = counts[length]
        # A whole multiple of equal lengths needs no border inside it.
        if left >= share and out[-1]:
            out.append([])
            room = share
        while left:
            if not room:
                out.append([])
                room = share
            taken = left if left >= share and not out[-1] else min(left, room)
            out[-1].append((length, taken))
            left -= taken
            room = max(0, room - taken)
    return [g for g in out if g]


def _best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int):
    """Unbounded knapsack: the most valuable content of one sequence."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sorted_sizes, sorted_prices = sizes[order], prices[order]
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(sorted_sizes, c, "right"))
        if k:
            values = best[c - sorted_sizes[:k]] + sorted_prices[:k]
            at = int(values.argmax())
            if values[at] > best[c - 1] + 1e-12:
                best[c], taken[c] = values[at], order[at]
                continue
        best[c] = best[c - 1]
    column = np.zeros(len(sizes), np.int64)
    c = capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            column[taken[c]] += 1
            c -= sizes[taken[c]]
    return best[capacity], column


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000):
    """Fractional counts of configurations that cover the demand with fewest sequences (revised simplex)."""
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.linalg.inv(columns)
    amount = inverse @ demand
    for turn in range(rounds):
        prices = inverse.sum(axis=0)
        value, column = _best_configuration(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ column
        rising = direction > 1e-9
        if not rising.any():
            break
        ratio = np.full(m, np.inf)
        ratio[rising] = np.maximum(amount[rising], 0) / direction[rising]
        out = int(ratio.argmin())
        amount = amount - ratio[out] * direction
        amount[out] = ratio[out]
        columns[:, out] = column
        if turn % 50 == 49:
            inverse = np.linalg.inv(columns)
            amount = inverse @ demand
        else:
            row = inverse[out] / direction[out]
            inverse = inverse - np.outer(direction, row)
            inverse[out] = row
    return columns.astype(np.int64), np.maximum(amount, 0)


def pack_lengths(counts: dict[int, int], capacity: int, groups: int = GROUPS, small: int = SMALL) -> list[Run]:
    """Runs that hold every piece of every length once."""
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    large = {n: c for n, c in counts.items() if capacity // small < n < capacity and c}
    if not large:
        return _substitute(counts, capacity, [], np.zeros((0, 0), np.int64), np.zeros(0))
    grouped = group_lengths(large, groups)
    sizes = np.array([g[0][0] for g in grouped])
    demand = np.array([sum(c for _, c in g) for g in grouped], float)
    columns, amount = configurations(sizes, demand, capacity)
    order = np.argsort(-(columns * sizes[:, None]).sum(axis=0), kind="stable")
    tried = [_substitute(counts, capacity, grouped, columns[:, order], amount[order] * share) for share in SHARES]
    return min(tried, key=lambda runs: sum(r.count for r in runs))


def _substitute(counts: dict[int, int], capacity: int, grouped: list, columns: np.ndarray, amount: np.ndarray):
    """Actual lengths in the places of the rounded sizes; the last place of each configuration is left to best fit,
    which finds a length for the room there that rounding up has not spoilt."""
    used = dict.fromkeys(counts, 0)  # pieces of each length placed so far
    runs: list[Run] = []
    if counts.get(capacity):
        runs.append(Run(counts[capacity], 0, [(capacity, 0, 1)]))
        used[capacity] = counts[capacity]
    waiting = [list(g) for g in grouped]
    for k, copies in enumerate(np.floor(amount + 1e-6).astype(np.int64)):
        column = columns[:, k].copy()
        if column.sum() > 1:
            column[np.flatnonzero(column)[-1]] -= 1
        runs += _fill(column, int(copies), waiting, used, capacity)
    rest = {n: c - used[n] for n, c in counts.items() if c > used[n]}
    return _best_fit(runs, rest, used, capacity)


def _fill(column: np.ndarray, copies: int, waiting: list, used: dict[int, int], capacity: int) -> list[Run]:
    """``copies`` sequences of one configuration with actual lengths, as far as the groups last."""
    if not copies or not column.any():
        return []
    runs = [Run(copies, capacity)]
    for g in np.flatnonzero(column):
        for _ in range(int(column[g])):
            filled: list[Run] = []
            for run in runs:
                while run.count and waiting[g]:
                    length, left = waiting[g][0]
                    now, run = run.split(min(left, run.count))
                    filled.append(now.put(length, used[length], 1))
                    used[length] += now.count
                    if left == now.count:
                        waiting[g].pop(0)
                    else:
                        waiting[g][0] = (length, left - now.count)
                if run.count:
                    filled.append(run)
            runs = filled
    return [r for r in runs if r.content]


def _best_fit(runs: list[Run], rest: dict[int, int], used: dict[int, int], capacity: int) -> list[Run]:
    """Falling lengths into the least room that takes them; equal runs are handled as one."""
    number = 0
    by_room: list[tuple[int, int, Run]] = []
    for run in runs:
        by_room.append((run.room, number := number + 1, run))
    by_room.sort(key=lambda x: x[:2])
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            at = bisect.bisect_left(by_room, (length, 0), key=lambda x: x[:2])
            if at == len(by_room):
                each = min(capacity // length, left)
                run = Run(left // each, capacity)
            else:
                run = by_room.pop(at)[2]
                each = min(run.room // length, left)
                if run.count > left // each:
                    run, after = run.split(left // each)
                    bisect.insort(by_room, (after.room, number := number + 1, after), key=lambda x: x[:2])
            run = run.put(length, used[length], each)
            used[length] += each * run.count
            left -= each * run.count
            bisect.insort(by_room, (run.room, number := number + 1, run), key=lambda x: x[:2])
    return [run for _, _, run in by_room]


def places(runs: list[Run]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first, last, each, sequence, offset)``: the pieces of a length numbered first to last, ``each``
    in a sequence, go to sequences from ``sequence`` on, from ``offset`` on in each."""
    out, sequence = [], 0
    for run in runs:
        offset = 0
        for length, first, each in run.content:
            out.append((length, first, first + each * run.count - 1, each, sequence, offset))
            offset += each * length
        sequence += run.count
    return out


# ---------------------------------------------------------------- pieces, in Spark


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Ids of every document with its end id, cut into pieces, numbered per length within their task.

    Only documents longer than ``capacity`` are cut: a first piece that takes the remainder, then full ones.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with WordCache.lent(vocabulary) as cache:
            yield from pieces_of(batches, cache)

    def pieces_of(batches: Iterator[pa.RecordBatch], cache: WordCache) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            numbers, at = batch.column("doc_id"), 0
            for group in text_groups(batch.column("text").to_pylist()):
                who, piece, start, length, sums = [], [], [], [], []
                for ids in cache.encode(group):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        who.append(at)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        sums.append(zlib.crc32(ids[a:b]))
                    at += 1
                lengths = np.array(length)
                order = np.argsort(lengths, kind="stable")
                ordered = lengths[order]
                border = np.concatenate([[True], ordered[1:] != ordered[:-1]])
                first_of = np.maximum.accumulate(np.where(border, np.arange(len(ordered)), 0))
                nth = np.empty(len(ordered), np.int64)
                nth[order] = seen[ordered] + np.arange(len(ordered)) - first_of
                seen += np.bincount(lengths, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(who), part, np.int32)),
                        numbers.take(pa.array(who, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums, pa.int64()),
                        pa.array(nth),
                    ],
                    names=["part", "doc_id", "piece", "start", "length", "ids_crc32", "nth"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(cut), _PIECES)


def best_fit_pack(spark: SparkSession, pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds ``sequence_id, offset`` to pieces that carry ``part, length, nth`` (number within part and length).

    Any other column passes through. No pieces give no rows.
    """
    pieces = materialize(pieces, "pieces")
    per_part = pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    per_part = materialize(per_part, "counts")
    # At most `capacity` rows come to the driver.
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    planned = places(pack_lengths(counts, capacity))
    plan = spark.createDataFrame(planned, "length bigint, first bigint, last bigint, each bigint, sequence bigint, place bigint")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(base, ["part", "length"]).withColumn("index", F.col("base") + F.col("nth"))
    # The plan has a few rows per length whatever the input, so it is broadcast.
    hit = (F.col("index") >= F.col("p.first")) & (F.col("index") <= F.col("p.last"))
    found = numbered.alias("n").join(F.broadcast(plan).alias("p"), (F.col("n.length") == F.col("p.length")) & hit)
    local = F.col("index") - F.col("p.first")
    kept = [F.col(f"n.`{c}`") for c in pieces.columns if c not in ("part", "nth")]
    return found.select(
        *kept,
        (F.col("p.sequence") + F.expr("(index - p.first) div p.each")).alias("sequence_id"),
        (F.col("p.place") + local % F.col("p.each") * F.col("n.length")).alias("offset"),
    )


def pack_documents(
    spark: SparkSession, docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2
) -> DataFrame:
    """Pieces of all documents (null text: empty, so the end id alone) packed into sequences of ``capacity`` ids.

    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Repeated rows are packed each for
    itself; a row without ``doc_id`` keeps a null there.
    """
    return best_fit_pack(spark, token_pieces(docs, vocabulary, capacity, end_id), capacity)
