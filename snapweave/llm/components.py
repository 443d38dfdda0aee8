"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from snapweave.runtime import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link a node's larger neighbours (large star), or its smaller ones and itself (small star), to the least of all.

    The least neighbour is combined before the shuffle, so a centre of very many edges costs one row per
    task there; the join back is an ordinary one that adaptive execution may split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    met = both.join(least, "a")
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return out.where(F.col("a") != F.col("b")).distinct()


def _sum(edges: DataFrame) -> tuple:
    found = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return found["n"], found["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a, b`` of one type, without nulls); a component is
    named by its least node. Each round is written to the shared folder; loops and repeated edges do no harm."""
    current = edges.select("a", "b").where(F.col("a") != F.col("b")).distinct()
    current = materialize(_stars(current, large=False), "stars")
    before = _sum(current)
    while before[0]:
        current = materialize(_stars(_stars(current, large=True), large=False), "stars")
        now = _sum(current)
        if now == before:
            break
        before = now
    # Every edge now leads from a node to the least of its component.
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
