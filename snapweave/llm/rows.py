"""Row numbers, merged span lists and tidy tasks that several operators need."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from snapweave.runtime import materialize

ROW = "__row__"


def with_number(docs: DataFrame) -> DataFrame:
    """Rows with a number each, whatever their ``doc_id``. It depends on how the input is split, which may change from
    one reading to the next (cores at hand, lost executors): only for what is written once and never met with ``docs`` again."""
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def numbered(docs: DataFrame) -> DataFrame:
    """``with_number``, written once: rows of the result keep their numbers at each reading and can be found again."""
    return materialize(with_number(docs), "numbered")


def merged_list(base: str, added: Column, kinds: tuple[str, ...]) -> Column:
    """``base`` (a comma-joined list of kind:start:end) with an array of further such texts, in the same order."""
    every = F.filter(F.concat(F.split(base, ","), F.coalesce(added, F.array().cast("array<string>"))), lambda s: s != "")
    rank = F.create_map(*[F.lit(x) for n, kind in enumerate(kinds) for x in (kind, n)])

    def keyed(span: Column) -> Column:
        part = F.split(span, ":")
        return F.struct(part[1].cast("long").alias("a"), rank[part[0]].alias("b"), part[2].cast("long").alias("c"), span.alias("s"))

    return F.array_join(F.transform(F.array_sort(F.transform(every, keyed)), lambda s: s["s"]), ",")


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


SLICE_BYTES = 4 << 20  # of a batch that is worked on at once


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in pieces of about ``most`` bytes: a batch has a number of rows, however long their texts."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(batch.nbytes, 1))
        if step >= batch.num_rows:
            yield batch
            continue
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


BATCH_ROWS = 1000  # of whole texts that go to a Python worker at once
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches for Python workers get at most ``BATCH_ROWS`` rows: executor and worker each hold a batch whole, outside
    the heap, and in buffers that double as they grow. A smaller setting stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def give_back() -> None:
    """Freed memory of Arrow and, where the C library can, of Python and numpy goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Run) -> Run:
    """``run`` over the batches of a task, in slices, giving freed memory back when the task ends: the worker lives on,
    waits for other tasks, and would keep what the largest batches took."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(slices(batches))
        finally:
            give_back()

    return task
