"""Merkle manifest of a table: hash trees per group and over the groups, stored in van Emde Boas order.

Rows of a group are leaves in a given order. While a level has several nodes, every three
consecutive ones (the last run may be shorter, even one) become their hash; what remains is the
group's root, and the group roots, in the order of their names, are the leaves of one more tree.

A tree is stored as aligned subtrees (blocks) of ``HEIGHT`` levels, at most 3**7 leaves each. A
block is one byte string whose nodes lie in van Emde Boas order: the upper half of its levels
first, then the subtrees hanging below them one after the other, each laid out the same way. The
place of a node follows from its depth and index by arithmetic alone (``places``), and construction
follows the same recursion. The roots of the blocks of one band are the leaves of the next band, so
a tree of any size is built in log(n) / 7 rounds, no task holds more than one block, and the path
from a row to the root is read from one block per band.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from snapweave.operators.ordering import POS, SIZE, number_by_slices
from snapweave.runtime import materialize

ARITY = 3
HEIGHT = 7  # levels of a block below its root
WIDTH = ARITY**HEIGHT  # leaves of a block
BYTES = 32

_BLOCKS = "grp string, block bigint, size bigint, height int, store binary, root binary"
_PATHS = "grp string, pos bigint, shape string, siblings binary, subroot binary, top binary"
_PROOFS = "row struct<{fields}>, subroot string, root string, proof_sha256 string, folded_root string"


# --- one block ---------------------------------------------------------------------------------


def count_nodes(levels: int) -> int:
    """Nodes of a full tree with so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


@lru_cache(maxsize=None)
def places(height: int) -> tuple[tuple[int, ...], ...]:
    """Per depth, the places of its nodes in the van Emde Boas order of a full block.

    At each step the tree is cut at half height. A node of the upper half keeps its depth and
    index; one of the lower half lies behind the upper half and behind the subtrees to its left.
    """
    out = []
    for depth in range(height + 1):
        index = np.arange(ARITY**depth, dtype=np.int64)
        base, below, levels = np.zeros_like(index), depth, height + 1
        while levels > 1:
            upper = levels // 2
            if below < upper:
                levels = upper
                continue
            lower = levels - upper
            subtree = index // ARITY ** (below - upper)
            base += count_nodes(upper) + subtree * count_nodes(lower)
            index -= subtree * ARITY ** (below - upper)
            below, levels = below - upper, lower
        out.append(tuple(base.tolist()))
    return tuple(out)


def digest(parts: Sequence[bytes]) -> bytes:
    """Hash of digests written one after the other in lower-case hex."""
    return sha256(b"".join(parts).hex().encode()).digest()


def height_of(size: int) -> int:
    """Levels of the blocks of a tree (or band) of ``size`` nodes: a tree of one block ends at its root."""
    height = 0
    while height < HEIGHT and ARITY**height < size:
        height += 1
    return height


def build_block(leaves: Sequence[bytes], height: int) -> bytes:
    """The block over ``leaves``; places of nodes that a shorter last block lacks stay zero."""
    store = bytearray(count_nodes(height + 1) * BYTES)

    def fold(levels: int, base: int, nodes: Sequence[bytes]) -> bytes:
        if levels == 1:
            store[base * BYTES : (base + 1) * BYTES] = nodes[0]
            return nodes[0]
        upper = levels // 2
        lower = levels - upper
        width, step = ARITY ** (lower - 1), count_nodes(lower)
        roots = [
            fold(lower, base + count_nodes(upper) + n * step, nodes[at : at + width])
            for n, at in enumerate(range(0, len(nodes), width))
        ]
        return fold(upper, base, [digest(roots[at : at + ARITY]) for at in range(0, len(roots), ARITY)])

    fold(height + 1, 0, leaves)
    return bytes(store)


def path_in_block(store: bytes, height: int, leaves: int, leaf: int) -> tuple[str, bytes]:
    """From a leaf up: place in the run and length of the run, two digits a level, and the siblings' digests."""
    shape, siblings, at = [], [], places(height)
    for depth in range(height, 0, -1):
        present = -(-leaves // ARITY ** (height - depth))
        own = leaf // ARITY ** (height - depth)
        first = own - own % ARITY
        run = range(first, min(first + ARITY, present))
        shape.append(f"{own - first}{len(run)}")
        siblings += [store[at[depth][k] * BYTES : (at[depth][k] + 1) * BYTES] for k in run if k != own]
    return "".join(shape), b"".join(siblings)


def fold_path(leaf: bytes, shape: str, siblings: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    at = 0
    for k in range(0, len(shape), 2):
        slot, others = int(shape[k]), int(shape[k + 1]) - 1
        left, end = at + slot * BYTES, at + others * BYTES
        leaf = digest((siblings[at:left], leaf, siblings[left:end]))
        at = end
    return leaf


# --- blocks of a table ---------------------------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns])


def _batches(rows, schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (tuples) in batches of at most ``most``."""
    kept = []
    for row in rows:
        kept.append(row)
        if len(kept) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes sorted by group and position, whole blocks only: one row per block."""
    schema = pa.schema(
        [("grp", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("height", pa.int32())]
        + [("store", pa.binary()), ("root", pa.binary())]
    )

    def blocks():
        now, leaves = None, []

        def done():
            group, block, size = now
            store = build_block(leaves, height_of(size))
            return group, block, size, height_of(size), store, store[:BYTES]

        for group, pos, size, node in _rows(batches):
            key = (group, pos // WIDTH, size)
            if key != now:
                if leaves:
                    yield done()
                now, leaves = key, []
            leaves.append(node)
        if leaves:
            yield done()

    yield from _batches(blocks(), schema, 64)


def build_bands(nodes: DataFrame) -> list[DataFrame]:
    """All blocks over ``grp, pos, size, node``, one table per band, lowest first.

    ``pos`` counts from 0 in a group of ``size`` nodes. A band is written once and read by the next.
    """
    largest = nodes.agg(F.max("size").alias("most")).first()["most"] or 0
    bands = []
    while largest:
        ordered = (
            nodes.select("grp", "pos", "size", "node")
            .repartition("grp", F.expr(f"pos div {WIDTH}"))
            .sortWithinPartitions("grp", "pos")
        )
        blocks = materialize(ordered.mapInArrow(_build, _BLOCKS), "blocks")
        bands.append(blocks)
        if largest <= WIDTH:
            break
        nodes = blocks.filter(F.col("size") > WIDTH).select(
            "grp", F.col("block").alias("pos"), F.expr(f"(size + {WIDTH - 1}) div {WIDTH}").alias("size"), F.col("root").alias("node")
        )
        largest = -(-largest // WIDTH)
    return bands


def finished(bands: Sequence[DataFrame]) -> DataFrame:
    """``grp, root`` of every group, from the band where its tree ends."""
    out = None
    for blocks in bands:
        ended = blocks.filter(F.col("size") <= WIDTH).select("grp", "root")
        out = ended if out is None else out.unionByName(ended)
    return out


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the path of their root: the path of every leaf."""
    schema = pa.schema(
        [("grp", pa.string()), ("pos", pa.int64()), ("shape", pa.string())]
        + [(c, pa.binary()) for c in ("siblings", "subroot", "top")]
    )

    def paths():
        for group, block, size, height, store, shape, siblings, subroot, top in _rows(batches):
            leaves = min(WIDTH, size - block * WIDTH)
            for leaf in range(leaves):
                own_shape, own = path_in_block(store, height, leaves, leaf)
                yield group, block * WIDTH + leaf, own_shape + shape, own + siblings, subroot, top

    yield from _batches(paths(), schema, 2000)


def _with_upper_path(blocks: DataFrame, ends: DataFrame, above: DataFrame | None) -> DataFrame:
    """Blocks with the path from their root up: ``ends`` (by group) where the tree ends here, else ``above`` (by position)."""
    path = ["shape", "siblings", "subroot", "top"]
    out = blocks.filter(F.col("size") <= WIDTH).join(ends.select("grp", *path), "grp")
    if above is not None:
        upper = above.select("grp", F.col("pos").alias("block"), *path)
        out = out.unionByName(blocks.filter(F.col("size") > WIDTH).join(upper, ["grp", "block"]))
    return out.select("grp", "block", "size", "height", "store", *path)


def paths_above(bands: Sequence[DataFrame], ends: DataFrame) -> DataFrame:
    """Blocks of the lowest band with the path from their roots to the top, walked down band by band."""
    above = None
    for blocks in reversed(bands[1:]):
        above = _with_upper_path(blocks, ends, above).mapInArrow(_walk, _PATHS)
    return _with_upper_path(bands[0], ends, above)


# --- manifest ---------------------------------------------------------------------------------------


@dataclass
class Manifest:
    """Stored blocks of all trees: per band the groups' and the top's, with the numbered rows they were built from."""

    rows: DataFrame  # what was given, with grp, pos, size
    bands: list[DataFrame]
    top: list[DataFrame]
    names: DataFrame  # grp, pos: the groups in the order of the top tree


def build_manifest(rows: DataFrame, group: Column, order: Sequence[Column], leaf: str) -> Manifest:
    """Trees over the binary column ``leaf``, per value of ``group`` (text; null is a group, and the first) in ``order``.

    Rows are numbered in slices of their order, so a group of any share of the rows is spread out. ``rows`` is
    read three times: hand over what is written.
    """
    named = rows.withColumn("grp", F.coalesce(F.concat(F.lit("="), group), F.lit("")))
    numbered = number_by_slices(named, ["grp"], order, written=True).withColumnsRenamed({POS: "pos", SIZE: "size"})
    numbered = materialize(numbered, "leaves")
    bands = build_bands(numbered.withColumn("node", F.col(leaf)))
    if not bands:
        return Manifest(numbered, [], [], None)
    names = number_by_slices(finished(bands), [], [F.col("grp")], written=True).withColumnsRenamed({POS: "pos", SIZE: "size"})
    names = materialize(names.select("grp", "pos", "size", F.col("root").alias("node")), "groups")
    return Manifest(numbered, bands, build_bands(names.withColumn("grp", F.lit(""))), names)


def prove(manifest: Manifest, claim: str) -> DataFrame:
    """Every row of the manifest with ``subroot, root, proof_sha256`` and ``folded_root``, all hex.

    The proof is the row's siblings from its leaf to the root; ``folded_root`` is the root that they
    give with the binary column ``claim`` as the leaf. Rows meet their block in the task that reads it.
    """
    rows = manifest.rows
    kept = [f for f in rows.schema.fields if f.name not in ("grp", "pos", "size")]
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in kept)
    result = _PROOFS.format(fields=fields)
    if not manifest.bands:
        return rows.sparkSession.createDataFrame([], result).select("row.*", "subroot", "root", "proof_sha256", "folded_root")
    empty = F.lit("").cast("binary")
    start = finished(manifest.top).select(
        "grp", F.lit("").alias("shape"), empty.alias("siblings"), empty.alias("subroot"), F.col("root").alias("top")
    )
    tops = paths_above(manifest.top, start).mapInArrow(_walk, _PATHS)
    ends = manifest.names.select("grp", "pos", F.col("node").alias("own")).join(tops.drop("grp", "subroot"), "pos")
    ends = ends.select("grp", "shape", "siblings", F.col("own").alias("subroot"), "top")
    blocks = paths_above(manifest.bands, ends)

    missing = F.lit(None)
    of_block = blocks.select(
        "grp", "block", F.lit(-1).cast("bigint").alias("pos"), F.struct("size", "height", "store", "shape", "siblings", "subroot", "top").alias("b"),
        missing.cast("binary").alias("claim"), missing.cast(f"struct<{fields}>").alias("row"),
    )
    of_row = rows.select(
        "grp", F.expr(f"pos div {WIDTH}").alias("block"), "pos", missing.cast(of_block.schema["b"].dataType).alias("b"),
        F.col(claim).alias("claim"), F.struct(*[f.name for f in kept]).alias("row"),
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = None
        for batch in batches:
            own, out = batch.column("row"), []
            for n, (block, pos, given, claimed) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("block", "pos", "b", "claim")])):
                if given is not None:
                    b = given
                    continue
                leaves = min(WIDTH, b["size"] - block * WIDTH)
                shape, siblings = path_in_block(b["store"], b["height"], leaves, pos - block * WIDTH)
                shape, siblings = shape + b["shape"], siblings + b["siblings"]
                proof = sha256(siblings.hex().encode()).hexdigest()
                out.append((n, b["subroot"].hex(), b["top"].hex(), proof, fold_path(claimed, shape, siblings).hex()))
            if out:
                index, *texts = zip(*out)
                columns = [own.take(pa.array(index)), *[pa.array(t, pa.string()) for t in texts]]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "subroot", "root", "proof_sha256", "folded_root"])

    together = of_block.unionByName(of_row).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    return together.mapInArrow(check, result).select("row.*", "subroot", "root", "proof_sha256", "folded_root")


# --- documents --------------------------------------------------------------------------------------


def fields_digest(*columns: Column) -> Column:
    """Binary sha256 of the columns, each as ``-`` if null, else byte count, colon, value."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def document_manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether a tampered copy of it still verifies.

    Leaves of one source ascend by ``doc_id`` (null first; equal ones by their leaf). Tampering
    takes the line breaks out of the text of rows whose crc32 of ``doc_id`` is even; rows without
    ``doc_id`` stay. Null columns count as such; repeated rows are leaves of their own; an empty
    table has no rows. Other columns are ignored.
    """
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text, cut = F.col("text"), F.translate("text", "\n", "")
    tampered = F.coalesce(number % 2 == 0, F.lit(False)) & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))

    def leaf(text: Column) -> Column:
        return fields_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    own = docs.select("doc_id", "source", leaf(text).alias("leaf"), F.when(tampered, leaf(cut)).alias("changed"))
    own = materialize(own, "digests").withColumn("claim", F.coalesce("changed", "leaf")).drop("changed")
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    proven = prove(build_manifest(own, F.col("source"), order, "leaf"), "claim")
    return proven.select(
        "doc_id",
        F.lower(F.hex("leaf")).alias("leaf"),
        "subroot",
        "root",
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
