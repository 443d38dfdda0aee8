"""Exact top-k search by tiled matrix products.

Vectors become integers once and are packed into blocks: blocks of queries and shards of
candidates. A tile is one query block against one shard: a matrix product, then a partial
selection of the ``k`` best per query. The lists of a query block are merged in a tree, a fixed
number of lists at a time, so no task ever holds more than ``FAN`` lists of one block. Data that
moves: each shard once per query block, and ``k`` rows per query and tile.

Scores order first, then the smaller ``vec_id``. Products run in float32 or float64 while they
are exact there (largest component squared times the length), else in int64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from snapweave.runtime import materialize

QUERY_BLOCK, SHARD, FAN = 2048, 8192, 16
_BLOCK = "block string, dim int, n int, ids binary, vectors binary"
_TOP = "query_block int, slot bigint, query_id bigint, vec_id bigint, score bigint"


def _integers(embedding: str, scale: float) -> list:
    """Components times ``scale``, rounded down; vectors with a null or non-finite component (or none) are left out."""
    raw = F.transform(F.col(embedding), lambda x: x.cast("double"))
    finite = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return [finite & (F.size(raw) > 0), F.transform(raw, lambda x: F.floor(x * F.lit(scale)))]


def _pack(size: int):
    """Rows of one length to blocks of ``size``, in the order in which a task reads them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def block(rows: list) -> pa.RecordBatch:
            nonlocal made
            made += 1
            ids = np.array([r[0] for r in rows], "<i8")
            order = np.argsort(ids, kind="stable")
            matrix = np.array([r[1] for r in rows], "<i8")[order]
            row = [f"{part}-{made}", matrix.shape[1], len(rows), ids[order].tobytes(), matrix.tobytes()]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            arrays = [pa.array([v], k) for v, k in zip(row, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["block", "dim", "n", "ids", "vectors"])

        for batch in batches:
            for number, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = held.setdefault(len(vector), [])
                rows.append((number, vector))
                if len(rows) == size:
                    yield block(held.pop(len(vector)))
        for rows in held.values():
            yield block(rows)

    return pack


def _matrix(ids: bytes, vectors: bytes, dim: int):
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<i8").reshape(-1, dim)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**24:
        return (a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.int64)
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def tile_top(query_ids, queries, ids, vectors, k: int, rows: int = 256):
    """``query_id, vec_id, score`` of the best ``k`` of a shard for each query; ids of the shard rise."""
    out = []
    for at in range(0, len(query_ids), rows):
        own = query_ids[at : at + rows]
        scores = _product(queries[at : at + rows], vectors)
        allowed = ids[None, :] != own[:, None]
        low = scores.min(initial=0) - 1
        scores = np.where(allowed, scores, low)
        if scores.shape[1] > k:
            # The k-th best score first: what is above it stays, and of its ties the first (smallest) ids.
            kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            above = scores > kth[:, None]
            tied = scores == kth[:, None]
            room = k - above.sum(axis=1)
            kept = above | (tied & (np.cumsum(tied, axis=1) <= room[:, None]))
        else:
            kept = np.ones_like(allowed)
        r, c = np.nonzero(kept & allowed)
        out.append((own[r], ids[c], scores[r, c]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = frame.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return ordered[ordered.groupby("query_id").cumcount() < k]


def exact_top_k(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    scale: float = 64.0,
    query_block: int = QUERY_BLOCK,
    shard: int = SHARD,
    fan: int = FAN,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` candidates with the highest integer inner product per query.

    ``vectors`` has ``vec_id, embedding``; queries are the rows where ``is_query`` holds, candidates all rows of the
    same length but those with the query's own id. A row without ``vec_id`` takes no part. Of repeated rows with
    one id each is a candidate, and the query is the least of their vectors. No vectors give no rows.
    """
    usable, integers = _integers("embedding", scale)
    clean = vectors.where(usable & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long"), integers.alias("vector"), is_query.alias("q")
    )
    shards = materialize(clean.select("vec_id", "vector").mapInArrow(_pack(shard), _BLOCK), "shards")
    asked = clean.where("q").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = materialize(asked.mapInArrow(_pack(query_block), _BLOCK), "queries")
    n_shards, n_blocks = max(1, shards.count()), blocks.count()
    blocks = blocks.withColumn("query_block", F.row_number().over(Window.orderBy("block")))  # one row per block

    def tiles(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for r in batch.to_pylist():
                own = _matrix(r["q_ids"], r["q_vectors"], r["dim"])
                got = tile_top(*own, *_matrix(r["ids"], r["vectors"], r["dim"]), k)
                n = len(got[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, r["query_block"], np.int32)), pa.array(np.full(n, r["slot"], np.int64)), *map(pa.array, got)],
                    names=["query_block", "slot", "query_id", "vec_id", "score"],
                )

    # Shards are numbered; each meets every query block of its length, in a task of its own.
    slots = shards.withColumn("slot", F.abs(F.xxhash64("block")) % F.lit(n_shards))
    spread = slots.withColumn("query_block", F.explode(F.sequence(F.lit(1), F.lit(max(1, n_blocks)))))
    asked = blocks.select("query_block", "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    tasks = min(n_shards * max(1, n_blocks), 10_000)
    pairs = spread.join(asked, ["query_block", "dim"]).repartition(tasks)
    tops = materialize(pairs.mapInArrow(tiles, _TOP), "tops")
    lists = n_shards
    while True:
        lists = -(-lists // fan)
        grouped = tops.withColumn("slot", F.floor(F.col("slot") / F.lit(fan))).groupBy("query_block", "slot")
        tops = materialize(grouped.applyInPandas(lambda frame: _best(frame, k), _TOP), "tops")
        if lists <= 1:
            break

    def ranked(frame: pd.DataFrame) -> pd.DataFrame:
        best = _best(frame, k)
        return best.assign(rank=(best.groupby("query_id").cumcount() + 1).astype("int32"))[["query_id", "rank", "vec_id", "score"]]

    return tops.groupBy("query_block").applyInPandas(ranked, "query_id bigint, rank int, vec_id bigint, score bigint")
