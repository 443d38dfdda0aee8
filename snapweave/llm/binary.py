"""Token-ID output: flat files of unsigned integers and of 64-bit document offsets.

A data set is a folder of shards. Shard ``n`` holds ``n.ids`` (little-endian, 16 bits wide where
the vocabulary has at most 65,536 ids, else 32; all documents one after the other), ``n.off`` (int64: the first id of each document, counted over
the whole data set, and one closing offset) and ``n.doc`` (int64 document numbers). Shards follow one
another in document order, so the data set is one flat sequence cut at document borders.

Documents are dealt by ranges of ``doc_id``, each task writes its shard's ids and lengths, and
the base of a shard is the prefix sum over one row per shard; then tasks write the offsets.
Rows without a number come first; the shard table says how many there are. Rows of one number
are ordered by a hash of their text. Null text is empty: the end id alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from snapweave.llm.files import make_folder, read_array, write_file
from snapweave.llm.tokens import WordCache, text_groups
from snapweave.runtime import materialize, scratch_path

_SHARDS = "shard int, first_doc bigint, n_docs bigint, n_null bigint, n_ids bigint"
_DOCS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def width(vocabulary: str) -> str:
    """The narrowest of the two id types that holds every id of a vocabulary."""
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(vocabulary).get_vocab().values()
    return "<u2" if max(ids) < 2**16 else "<u4"


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int, kind: str) -> DataFrame:
    """Encode ``doc_id, text`` of every row into shards under ``folder``; gives the shard table with bases."""
    make_folder(folder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        lengths: list[int] = []
        numbers: list[int] = []
        nulls = total = 0

        def ids(cache: WordCache):
            nonlocal nulls, total
            for batch in batches:
                at = 0
                own = batch.column("doc_id").to_pylist()
                for group in text_groups(batch.column("text").to_pylist()):
                    for found in cache.encode(group):
                        piece = np.append(found, np.uint32(end_id)).astype(kind)
                        nulls += own[at] is None
                        numbers.append(own[at] or 0)
                        lengths.append(len(piece))
                        total += len(piece)
                        at += 1
                        yield piece.tobytes()

        with WordCache.lent(vocabulary) as cache:
            write_file(f"{folder}/{shard}.ids", ids(cache))
        write_file(f"{folder}/{shard}.doc", [np.array(numbers, "<i8").tobytes()])
        write_file(f"{folder}/{shard}.len", [np.array(lengths, "<i8").tobytes()])
        if lengths:
            row = {"shard": [shard], "first_doc": [numbers[0]], "n_docs": [len(lengths)], "n_null": [nulls], "n_ids": [total]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32())] + [(c, pa.int64()) for c in list(row)[1:]]))

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    dealt = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    shards = materialize(dealt.mapInArrow(encode, _SHARDS), "shards")
    # One row per shard: the only thing that is summed in one place.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = read_array(f"{folder}/{row['shard']}.len", "<i8")
                found = row["base"] + np.concatenate([[0], np.cumsum(lengths)])
                write_file(f"{folder}/{row['shard']}.off", [found.astype("<i8").tobytes()])
            yield batch

    # An explicit count: the rows are few and tiny, the files behind them are not.
    dealt_out = base.repartition(max(1, shards.count()))
    return materialize(dealt_out.mapInArrow(offsets, f"{_SHARDS}, base bigint"), "bases")


def read_ids(shards: DataFrame, folder: str, kind: str) -> DataFrame:
    """One row per document from the files alone: ``doc_id, start, n_tokens, ids_crc32``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_docs"]
                for at in range(0, n, 20_000):
                    some = min(20_000, n - at)
                    off = np.asarray(read_array(f"{folder}/{row['shard']}.off", "<i8", at, some + 1))
                    numbers = read_array(f"{folder}/{row['shard']}.doc", "<i8", at, some)
                    ids = read_array(f"{folder}/{row['shard']}.ids", kind, int(off[0] - row["base"]), int(off[-1] - off[0]))
                    cuts = (off - off[0]).tolist()
                    sums = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(cuts, cuts[1:])]
                    missing = np.arange(at, at + some) < row["n_null"]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(numbers), pa.int64(), mask=missing),
                            pa.array(off[:-1], pa.int64()),
                            pa.array(np.diff(off), pa.int64()),
                            pa.array(sums, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return shards.repartition(max(1, shards.count())).mapInArrow(read, _DOCS)


def binary_round_trip(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write the ids of all documents in ascending ``doc_id`` order and read the files back."""
    folder = scratch_path(spark, "ids")
    kind = width(vocabulary)
    return read_ids(write_ids(docs, folder, vocabulary, end_id, kind), folder, kind)
