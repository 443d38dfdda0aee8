"""What a chain of filters does in each order: survivors, removals, redundancy, lost labels.

Every filter is kept as a relation of the ids that fail it. Prefixes of a chain that hold the same
filters leave the same rows, so one relation of survivors per set of filters stands for all orders:
a left-anti join with the next filter's ids gives the survivors of the longer prefix, a left-semi
join the rows that the filter removes there. All relations hold ids and a few flags, are bucketed by
id with the same number of buckets, and so meet without a further shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from snapweave.llm.rows import ROW, numbered
from snapweave.runtime import materialize, scratch_path

# Texts with more copies than a part in so many of all rows: at most so many of them, so they may be broadcast.
HOT_SHARE = 10_000

WORDS = r"[\x20\x09-\x0D]+"


def text_flags(text: Column) -> dict[str, Column]:
    """The four filters that need the text alone: true where it fails. Null text is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, WORDS), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": capitals * 100 > F.char_length(text) * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def flag_repeats(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Add ``name``: some row of the same ``key`` has a smaller ``order`` value. Rows without one never have.

    The least value per key is counted before the shuffle. A key with a large share of the rows
    meets its least value by broadcast (there can be only ``HOT_SHARE`` such keys), the others by a join
    on keys that occur more than once.
    """
    least = rows.groupBy(key).agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("copies"))
    least = materialize(least.filter("copies > 1"), "least")
    bound = rows.count() // HOT_SHARE + 1000
    hot = F.broadcast(least.filter(F.col("copies") > bound).select(key, F.col("least").alias("hot_least")))
    rare = least.filter(F.col("copies") <= bound).select(F.col(key).alias("rare_key"), F.col("least").alias("rare_least"))
    met = rows.join(hot, key, "left")
    # Rows of hot keys have no partner in the shuffled join: a key of their own each keeps them spread out.
    spread = F.when(F.col("hot_least").isNull(), F.col(key)).otherwise(F.concat(F.lit("#"), F.col(ROW).cast("string")))
    met = met.withColumn("spread_key", spread).join(rare, F.col("spread_key") == F.col("rare_key"), "left")
    fails = F.coalesce(F.col(order) > F.coalesce("hot_least", "rare_least"), F.lit(False))
    return met.withColumn(name, fails).drop("hot_least", "rare_least", "rare_key", "spread_key")


class Relations:
    """Bucketed tables of one audit in the shared folder; their names leave the catalog when it is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keep(self, rows: DataFrame, name: str, dealt: bool = False) -> DataFrame:
        """Written by buckets of the id; ``dealt`` says that the rows come from a join on it already."""
        full = f"audit_{name}_{uuid.uuid4().hex}"
        rows = rows if dealt else rows.repartition(self.buckets, ROW)
        writer = rows.write.format("parquet").bucketBy(self.buckets, ROW).sortBy(ROW)
        writer.option("path", scratch_path(self.spark, full)).saveAsTable(full)
        self.names.append(full)
        return self.spark.table(full)

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _joined(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _counts(rows: DataFrame, next_filter: Column) -> DataFrame:
    return rows.groupBy("part", "prefix", next_filter.alias("filter")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
    )


def prefix_counts(rows: DataFrame, filters: Sequence[str]) -> DataFrame:
    """``part, prefix, filter, n, good, toxic``: rows that ``filter`` removes from the survivors of the filters in
    ``prefix`` (a bit mask), or with a null filter the survivors themselves. Zero counts have no row.

    ``rows`` holds an id, ``part``, ``good`` and ``toxic`` (0 or 1) and one boolean per filter, true where it fails.
    """
    kept = Relations(rows.sparkSession)
    try:
        fails = {f: kept.keep(rows.filter(f).select(ROW), f"fails_{f}") for f in filters}
        # Rows that pass everything survive every prefix: they are counted once and take no part in the joins.
        clean = rows.filter(~F.greatest(*filters)) if len(filters) > 1 else rows.filter(~F.col(filters[0]))
        at_risk = _joined([ids for ids in fails.values()])
        level = kept.keep(rows.select(ROW, "part", "good", "toxic", F.lit(0).alias("prefix")), "rows")
        level = level.join(at_risk, ROW, "left_semi")
        found = [_counts(clean.withColumn("prefix", F.lit(-1)), F.lit(None).cast("string"))]
        for size in range(len(filters) + 1):
            parts = [_counts(level, F.lit(None).cast("string"))]
            longer = []
            for n, f in enumerate(filters):
                candidates = level.filter(F.col("prefix").bitwiseAND(1 << n) == 0)
                if size < len(filters):
                    parts.append(_counts(candidates.join(fails[f], ROW, "left_semi"), F.lit(f)))
                # Each set of filters is reached once: by its last filter.
                ahead = candidates.filter(F.col("prefix") < 1 << n)
                longer.append(ahead.join(fails[f], ROW, "left_anti").withColumn("prefix", F.col("prefix") + (1 << n)))
            found.append(materialize(_joined(parts), "counts"))
            if size < len(filters):
                level = kept.keep(_joined(longer), f"survivors_{size + 1}", dealt=True)
        every = materialize(_joined(found), "counts")
    finally:
        kept.close()
    # What passes everything is part of each prefix's survivors.
    prefixes = F.explode(F.array(*[F.lit(m) for m in range(1 << len(filters))]))
    clean = every.filter("prefix = -1").withColumn("prefix", prefixes)
    return _joined([every.filter("prefix >= 0"), clean]).groupBy("part", "prefix", "filter").agg(
        *[F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    )


def interactions(counts: DataFrame, parts: DataFrame, filters: Sequence[str]) -> DataFrame:
    """One row per part, order of the filters and step, from ``prefix_counts``; zeros included."""
    steps = [
        ("".join(order), step + 1, sum(1 << filters.index(f) for f in order[:step]), f)
        for order in permutations(filters)
        for step, f in enumerate(order)
    ]
    grid = F.explode(
        F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(m).alias("prefix"), F.lit(f).alias("filter")) for o, s, m, f in steps])
    )
    rest = len(filters) - 1
    weights = [factorial(m.bit_count()) * factorial(rest - m.bit_count()) if m.bit_count() <= rest else 0 for m in range(1 << len(filters))]
    by_prefix = F.array(*[F.lit(w).cast("bigint") for w in weights])
    removed = counts.filter("filter IS NOT NULL")
    totals = removed.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("prefix") == 0, F.col("n")).otherwise(0)).alias("fails"),
        F.max(F.when(F.col("prefix").bitwiseXOR(F.element_at(_bits(filters), F.col("filter"))) == (1 << len(filters)) - 1, F.col("n"))).alias("alone"),
        F.sum(F.col("n") * F.element_at(by_prefix, F.col("prefix") + 1)).alias("shapley"),
    )
    survivors = counts.filter("filter IS NULL").select("part", F.col("prefix").alias("after"), F.col("n").alias("kept"))
    here = removed.select("part", "prefix", "filter", F.col("n").alias("removed"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"))
    out = parts.select("part", grid.alias("g")).select("part", "g.*")
    out = out.withColumn("after", F.col("prefix").bitwiseOR(F.element_at(_bits(filters), F.col("filter"))))
    out = out.join(here, ["part", "prefix", "filter"], "left").join(survivors, ["part", "after"], "left").join(totals, ["part", "filter"], "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("kept", "removed", "good_lost", "toxic_lost", "shapley", "fails", "alone")}
    return out.select(
        "part", "filter_order", "step", n["kept"].alias("kept"), n["removed"].alias("removed"),
        (n["fails"] - n["removed"]).alias("redundant"), n["alone"].alias("unique_fails"),
        n["good_lost"].alias("good_lost"), n["toxic_lost"].alias("toxic_lost"), n["shapley"].alias("shapley"),
    )


def _bits(filters: Sequence[str]) -> Column:
    return F.create_map(*[F.lit(x) for n, f in enumerate(filters) for x in (f, 1 << n)])


def audit_documents(docs: DataFrame, labels: DataFrame, flags: Mapping[str, Column] | None = None) -> DataFrame:
    """The five filters A to E over whole texts, in all 120 orders, per source.

    A: under 50 words; B: under 65 % of the words are distinct; C: over 5 % capital letters; D: holds one of
    ``#$%&*|``; E: the same text as a document with a smaller ``doc_id``. Null text is empty; a row without
    ``doc_id`` fails E never and has no labels, and its text still counts for none. Repeated rows count each; a
    repeated label counts as 1 if one of its rows does. A null source is the part with the empty name, together with
    an empty one. An empty table has no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    flags = flags or text_flags(F.col("text"))
    rows = numbered(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("same"), *[c.alias(f) for f, c in flags.items()]))
    rows = flag_repeats(rows, "same", "doc_id", "E")
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = rows.join(known, "doc_id", "left").select(
        ROW, "part", *flags, "E", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    )
    rows = materialize(rows, "flagged")
    filters = [*flags, "E"]
    return interactions(prefix_counts(rows, filters), rows.select("part").distinct(), filters)
