"""Exact n-gram Jaccard join by parity sketches, and the groups of near duplicates it gives.

Link: the sets of 5-word shingles have a similarity of at least 3/4. Then their symmetric
difference is at most a seventh of their sizes' sum.

1. A set's elements fall into parts by hash; the parity (XOR) of a part's elements is one key.
   Few differences leave parts equal, so linked sets share keys (pigeonhole per size band,
   ``shingles.signature``). Equal sets have one node, a hash of the set.
2. Keys are brought together. Pairs of a member and one leading member of its keys are tested
   first by size and by the Hamming distance of bit sketches, then by
   exact intersection. Links give components.
3. A key whose members are in one component is settled: a large group of copies costs one
   pair per member. In unsettled keys of at most ``FEW`` rows every pair between components is tested.
4. Unsettled keys of more rows come from passages that many documents share. Linked sets share more
   than d / 4 keys, so a set with fewer such keys is found by its other keys. The sets
   that have more are joined again with parts of one element each: prefixes by rarest
   element first, where a shared passage comes last. This is exact for sets of any make-up; only
   sets that consist of shared passages nearly whole and are still not linked
   meet there pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from snapweave.llm.components import connected_components
from snapweave.llm.langid import _texts_as_bytes
from snapweave.llm.rows import ROW, numbered, released
from snapweave.llm.shingles import mix, parity_sketches, reduce_by, shingle_sets, signature
from snapweave.runtime import materialize

FEW = 16
STAR_ROUNDS = 3
# Rows of (node, row) that may be sent to every task; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000
CHUNK_BYTES = 1_000_000
HELD_ROWS = 500_000
# Elements that may meet by chance in 32 bits between two sets: more has no measurable probability up to 10**5 elements.
CHANCE = 16


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a text column in runs of about ``CHUNK_BYTES``: first row, end row, bytes, cuts."""
    data, offsets = _texts_as_bytes(column)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right"))
        end = min(max(end - 1, at + 1), len(column))
        yield at, end, data, offsets[at : end + 1]
        at = end


def _fingerprints(sets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every set; the first one is its node."""
    one = mix(reduce_by(np.add, mix(sets ^ np.uint64(0xD6E8FEB86659FD93)), cuts) + np.diff(cuts).astype(np.uint64))
    two = mix(reduce_by(np.bitwise_xor, mix(sets + np.uint64(0xA0761D6478BD642F)), cuts))
    return one.view(np.int64), two.view(np.int64)


def document_sets(docs: DataFrame) -> DataFrame:
    """One row per document of ``docs`` (numbered): ``__row__, doc_id, n, node, check, sketch``; ``node`` is null without words."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _chunks(batch.column("text")):
                sets, cuts = shingle_sets(data, offsets)
                n = np.diff(cuts)
                node, check = _fingerprints(sets, cuts)
                words, borders = parity_sketches(sets, cuts)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(ROW),
                        part.column("doc_id"),
                        pa.array(n, pa.int64()),
                        pa.array(node, pa.int64(), mask=n == 0),
                        pa.array(check, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(words)),
                    ],
                    names=[ROW, "doc_id", "n", "node", "check", "sketch"],
                )

    schema = f"{ROW} bigint, doc_id bigint, n bigint, node bigint, check bigint, sketch array<bigint>"
    return docs.select(ROW, F.col("doc_id").cast("long"), "text").mapInArrow(released(describe), schema)


def signatures(docs: DataFrame) -> DataFrame:
    """``key, node`` for every key of every set; equal sets of one task once."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in _chunks(batch.column("text")):
                sets, cuts = shingle_sets(data, offsets)
                nodes, keys, counts = _fingerprints(sets, cuts)[0], [], []
                for node, a, b in zip(nodes.tolist(), cuts.tolist(), cuts[1:].tolist()):
                    if b > a and node not in seen:
                        seen.add(node)
                        found = signature(sets[a:b])
                        keys.append(found)
                        counts.append((node, len(found)))
                if keys:
                    who = np.repeat([c[0] for c in counts], [c[1] for c in counts])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), pa.array(who, pa.int64())], names=["key", "node"]
                    )

    return docs.select("text").mapInArrow(released(sign), "key bigint, node bigint")


def _groups_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, leader, node, size`` of the keys that more than one node has, from rows in the order of the keys.

    A group of any size is passed on in runs: what is held is bounded. A long group keeps its first
    run's leader; its size is then that of the run, which is large enough to be told as many.
    """

    held_key = held_leader = None  # of a group whose first rows have been passed on

    def emit(keys: np.ndarray, nodes: np.ndarray) -> tuple[pa.RecordBatch, int]:
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        rows = np.diff(np.append(first, len(keys)))
        low, high = np.minimum.reduceat(nodes, first), np.maximum.reduceat(nodes, first)
        many, size = low != high, rows.copy()
        if held_leader is not None and keys[0] == held_key:
            low[0], many[0], size[0] = held_leader, True, max(rows[0], HELD_ROWS)
        kept = np.repeat(many, rows)
        columns = [keys[kept], np.repeat(low, rows)[kept], nodes[kept], np.repeat(size, rows)[kept]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names), low[-1]

    names = ["key", "leader", "node", "size"]
    keys, nodes = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy()])
        nodes = np.concatenate([nodes, batch.column("node").to_numpy()])
        if not len(keys):
            continue
        # The last key may go on in the next batch.
        other = np.flatnonzero(keys != keys[-1])
        whole = int(other[-1]) + 1 if len(other) else 0
        if not whole and len(keys) >= HELD_ROWS:
            whole = len(keys)
        if whole:
            out, last = emit(keys[:whole], nodes[:whole])
            held_key, held_leader = (keys[-1], last) if whole == len(keys) else (None, None)
            keys, nodes = keys[whole:], nodes[whole:]
            yield out
    if len(keys):
        yield emit(keys, nodes)[0]


def gather(signed: DataFrame) -> DataFrame:
    ordered = signed.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(released(_groups_in_order), "key bigint, leader bigint, node bigint, size bigint")


def _hamming(a: Column, b: Column) -> Column:
    """Of two sketches of which one is at most twice as long: it is halved first."""

    def halved(x: Column, n: Column) -> Column:
        return F.when(F.size(x) > n, F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    n = F.least(F.size(a), F.size(b))
    apart = F.zip_with(halved(a, n), halved(b, n), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(apart, F.lit(0), lambda x, y: x + y)


class SetJoin:
    """Tests of pairs of nodes against the sets of the (numbered) documents."""

    def __init__(self, docs: DataFrame, described: DataFrame):
        self.docs = docs
        clash = F.raise_error(F.lit("two different sets have one 64-bit hash"))
        kept = described.where(F.col("node").isNotNull()).groupBy("node").agg(
            F.min("n").alias("n"),
            F.min(ROW).alias(ROW),
            (F.min("check") == F.max("check")).alias("one"),
            F.any_value("sketch").alias("sketch"),
        )
        self.nodes = materialize(kept.withColumn("n", F.when(F.col("one"), F.col("n")).otherwise(clash)).drop("one"), "nodes")

    def sets_of(self, wanted: DataFrame, bits: int = 64) -> DataFrame:
        """``node, elements`` of the given nodes, computed anew from one document each; hashes cut to 32 or all 64 bits."""
        places = materialize(wanted.join(self.nodes.select("node", ROW), "node"), "wanted")
        if places.count() <= BROADCAST_ROWS:
            places = F.broadcast(places)
        texts = self.docs.select(ROW, "text").join(places, ROW).select("node", "text")
        kind = np.int32 if bits == 32 else np.int64

        def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, data, offsets in _chunks(batch.column("text")):
                    sets, cuts = shingle_sets(data, offsets)
                    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(sets.view(np.int64).astype(kind)))
                    yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), lists], names=["node", "elements"])

        return texts.mapInArrow(released(elements), f"node bigint, elements array<{'int' if bits == 32 else 'bigint'}>")

    def near(self, pairs: DataFrame) -> DataFrame:
        """``a, b, na, nb`` of the pairs that sizes and sketches do not rule out."""
        near = pairs.select("a", "b").distinct()
        for side in "ab":
            own = self.nodes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
            near = near.join(own, side)
            if side == "b":
                near = near.where(4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb"))
        near = near.where(7 * _hamming(F.col("sa"), F.col("sb")) <= F.col("na") + F.col("nb"))
        return materialize(near.select("a", "b", "na", "nb"), "near")

    def _counted(self, near: DataFrame, bits: int) -> DataFrame:
        sets = self.sets_of(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), bits)
        for side in "ab":
            near = near.join(sets.select(F.col("node").alias(side), F.col("elements").alias(f"e{side}")), side)
        # The margin by which the similarity is above 3/4, in elements.
        shared = F.size(F.array_intersect("ea", "eb")) if bits == 64 else F.size("ea") - F.size(F.array_except("ea", "eb"))
        total = F.col("na") + F.col("nb")
        return materialize(near.select("a", "b", "na", "nb", (7 * shared - 3 * total).alias("margin")), "counted")

    def linked(self, near: DataFrame) -> DataFrame:
        """``a, b`` of the pairs whose similarity is at least 3/4: 4 * shared >= 3 * (na + nb - shared).

        Halves of the hashes are compared first. Where two elements meet there by chance the count is too high by
        one; pairs so near the border that this might matter are counted anew with whole hashes.
        """
        first = self._counted(near, 32)
        close = first.where((F.col("margin") >= 0) & (F.col("margin") < 7 * CHANCE)).select("a", "b", "na", "nb")
        sure = first.where(F.col("margin") >= 7 * CHANCE).select("a", "b")
        if close.isEmpty():
            return sure
        return sure.unionByName(self._counted(close, 64).where(F.col("margin") >= 0).select("a", "b"))


def _with_component(groups: DataFrame, members: DataFrame) -> DataFrame:
    joined = groups.join(members, "node", "left")
    return joined.withColumn("component", F.coalesce("component", "node"))


def _unsettled(groups: DataFrame) -> DataFrame:
    """Rows (with ``component``) of keys whose members are in more than one component."""
    keys = groups.groupBy("key").agg((F.min("component") != F.max("component")).alias("open")).where("open").select("key")
    return groups.join(keys, "key", "left_semi")


def _pairs_between(groups: DataFrame) -> DataFrame:
    """Pairs of a key's (few) members in different components. Documents that share a passage share many keys with
    the same members: equal lists are taken once."""
    lists = groups.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("node", "component"))).alias("all")).select("all").distinct()
    each = lists.select("all", F.explode("all").alias("x"))
    later = F.filter("all", lambda y: (y["node"] > F.col("x.node")) & (y["component"] != F.col("x.component")))
    listed = each.select(F.col("x.node").alias("a"), F.explode(later).alias("y")).select("a", F.col("y.node").alias("b"))
    return listed.distinct()


def _star(groups: DataFrame) -> DataFrame:
    """``a, b``: for each node the leader of its keys of few rows, and the most central member of those of many.

    The text that others are copies of has the most company in its keys, copies have keys of their own. One
    such member links a large group with one pair for each of the others.
    """
    few = groups.where((F.col("size") <= FEW) & (F.col("leader") != F.col("node")))
    many = groups.where(F.col("size") > FEW).select("key", "node", "size")
    company = many.groupBy("node").agg(F.sum("size").alias("company"))
    known = many.select("key", "node").join(company, "node")
    central = known.groupBy("key").agg(F.max(F.struct("company", "node")).alias("top"))
    met = known.join(central, "key").where(F.col("top.node") != F.col("node")).groupBy("node").agg(F.max("top").alias("top"))
    pairs = few.groupBy("node").agg(F.min("leader").alias("other")).unionByName(met.select("node", F.col("top.node").alias("other")))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def _rarest_first(elements: DataFrame) -> DataFrame:
    """``key, node, n, nth, low, size`` over single elements, each set's rarest first.

    Of linked sets the larger one has the first element that both hold among its n - ceil(3n/4) + 1 rarest, and the
    smaller one (``low``) among its n // 7 + 1 rarest, as at least 6/7 of it must still follow. Elements
    that are low for no set link nothing: a passage that most of a set consists of comes late in it.
    """
    each = elements.select("node", F.size("elements").alias("n"), F.explode("elements").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("often"))
    order = F.row_number().over(Window.partitionBy("node").orderBy("often", "key"))
    kept = each.join(often, "key").withColumn("nth", order).where(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * 0.75) + 1)
    kept = kept.where(F.col("often") > 1).withColumn("low", F.col("nth") <= F.floor(F.col("n") / 7) + 1).drop("often")
    wanted = kept.groupBy("key").agg(F.count("*").alias("size"), F.max("low").alias("any")).where(F.col("any") & (F.col("size") > 1))
    return kept.join(wanted.drop("any"), "key")


def _pairs_in_reach(groups: DataFrame) -> DataFrame:
    """Pairs between components whose first common element may be this one: what follows it suffices for a link."""

    def side(x: str) -> list[Column]:
        return ["key", *[F.col(c).alias(c + x) for c in ("node", "n", "nth", "low", "component")]]

    smaller = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("node1") < F.col("node2")))
    follow = 1 + F.least(F.col("n1") - F.col("nth1"), F.col("n2") - F.col("nth2"))
    met = groups.where("low").select(*side("1")).join(groups.select(*side("2")), "key").where(
        (F.col("node1") != F.col("node2"))
        & (F.col("component1") != F.col("component2"))
        & (smaller | ~F.col("low2"))
        & (4 * F.least("n1", "n2") >= 3 * F.greatest("n1", "n2"))
        & (7 * follow >= 3 * (F.col("n1") + F.col("n2")))
    )
    return met.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def near_duplicate_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``document_sets`` of all (numbered) documents, and ``node, component`` of the nodes that have links."""
    described = materialize(document_sets(docs), "described")
    join = SetJoin(docs, described)
    groups = materialize(gather(signatures(docs)), "groups")
    links = join.linked(join.near(_star(groups)))
    members = connected_components(links)
    rest = materialize(_unsettled(_with_component(groups, members)), "unsettled")
    pairs = _pairs_between(rest.where(F.col("size") <= FEW))
    many = rest.where(F.col("size") > FEW).groupBy("node").agg(F.count("*").alias("keys"))
    # Linked sets share more than d / 4 keys, which is a sixteenth of the larger one's size at least where no set has
    # fewer non-empty parts than are asked for. With a margin for those: a set of whose keys fewer than a
    # twentieth of its size are frequent shares another key with each of its partners.
    mixed = materialize(many.join(join.nodes.select("node", "n"), "node").where(F.col("keys") * 20 >= F.col("n")).select("node"), "mixed")
    if not mixed.isEmpty():
        again = materialize(_rarest_first(join.sets_of(mixed)), "again")
        for _ in range(STAR_ROUNDS):
            open_ = materialize(_unsettled(_with_component(again, members)), "open")
            # A component's members stand apart from each other no more: one of the others is tried.
            found = join.linked(join.near(_star_between(open_)))
            if found.isEmpty():
                break
            links = links.unionByName(found)
            members = connected_components(links)
        pairs = pairs.unionByName(_pairs_in_reach(_unsettled(_with_component(again, members))))
    more = join.linked(join.near(pairs))
    if not more.isEmpty():
        members = connected_components(links.unionByName(more))
    return described, materialize(members, "members")


def _star_between(groups: DataFrame) -> DataFrame:
    """``a, b``: for each node the most central member of its unsettled keys that is in another component."""
    company = groups.groupBy("node").agg(F.sum("size").alias("company"))
    known = groups.select("key", "node", "component").join(company, "node")
    central = known.groupBy("key").agg(F.max(F.struct("company", "node", "component")).alias("top"))
    apart = known.join(central, "key").where(F.col("top.component") != F.col("component"))
    met = apart.groupBy("node").agg(F.max("top").alias("top"))
    return met.select(F.least("node", "top.node").alias("a"), F.greatest("node", "top.node").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``__row__, doc_id, n_shingles, component_id`` for every row.

    A document's component is named by the smallest ``doc_id`` that links reach from it, its own included (null if
    all of them are null). Null text, empty text and text without words have no shingles and are linked with nothing.
    """
    described, members = near_duplicate_nodes(numbered(docs.select("doc_id", "text")))
    placed = described.select(ROW, "doc_id", "n", "node").join(members, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    least = placed.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "component", "left").select(
        ROW,
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the smallest ``doc_id`` (then the first row). Documents without
    words stay. All columns as they are."""
    names, docs = docs.columns, numbered(docs)
    described, members = near_duplicate_nodes(docs)
    placed = described.select(ROW, "doc_id", "node").join(members, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW)
    first = placed.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(order).alias("first"))
    kept = first.select(F.col(f"first.{ROW}").alias(ROW)).unionByName(placed.where(F.col("component").isNull()).select(ROW))
    kept = materialize(kept, "kept")
    if kept.count() <= BROADCAST_ROWS:
        kept = F.broadcast(kept)
    return docs.join(kept, ROW, "left_semi").select(*names)
