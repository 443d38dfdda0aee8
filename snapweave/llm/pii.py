"""Personal data by bootstrapped contextual extraction.

Seeds are what fixed patterns find (``spans.private_spans``). Every identifier-like token, seed
or not, is an instance; the words around it make lexical patterns (two words before; one
before and one after). Spark scores the graph of patterns and instances in rounds:

* a pattern scores the mean of its instances' scores, over distinct instances, if at least
  ``support`` distinct instances in as many documents share it, else nothing;
* a seed scores 1, another instance 1 - product(1 - score) over its patterns.

After ``rounds`` rounds, instances that are no seeds and score at least ``confidence`` are
personal data that no fixed pattern knows: kind ``context``. Base spans always stay. Edges are
combined before they are shuffled, so a frequent pattern is one row per instance.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from snapweave.llm.rows import ROW, merged_list, with_number
from snapweave.llm.spans import PRIVATE_KINDS, digest, listed, private_spans
from snapweave.runtime import materialize

KINDS = (*PRIVATE_KINDS, "context")
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.9, 2
# An identifier has at least four digits, or an at sign inside. A token begins where its run begins.
TOKEN = re.compile(r"(?<![^\s\"'<>()\[\]{},;])[^\s\"'<>()\[\]{},;0-9@]*+[0-9@][^\s\"'<>()\[\]{},;]*+")
WORD = re.compile(r"[^\W\d_]+")

_FOUND = (
    f"{ROW} bigint, doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, "
    "base_sha256 string, seen array<struct<value:string,seed:boolean,span:string,patterns:array<string>>>"
)


class Contexts:
    """Lexical patterns of places in a text: its words are listed once, when the first place asks for them."""

    def __init__(self, text: str):
        self.text, self.words = text, None

    def of(self, start: int, end: int) -> list[str]:
        if self.words is None:
            self.words = [m.span() for m in WORD.finditer(self.text)]
        first = bisect_left(self.words, (start,))
        before = [self._word(k, start) for k in range(max(0, first - 2), first)]
        following = bisect_left(self.words, (end,))
        if following and self.words[following - 1][1] > end:  # a word that begins inside the place
            following -= 1
        after = [self.text[max(a, end) : b].lower() for a, b in self.words[following : following + 1]]
        return patterns(before, after)

    def _word(self, k: int, end: int) -> str:
        a, b = self.words[k]
        return self.text[a : min(b, end)].lower()


def patterns(before: list[str], after: list[str]) -> list[str]:
    out = []
    if len(before) >= 2:
        out.append(f"{before[-2]} {before[-1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for text in batch.column("text").to_pylist():
            text = text or ""
            found, near = list(private_spans(text)), Contexts(text)
            base, seen = listed(found, PRIVATE_KINDS), []
            for kind, start, end in found:
                value = digest(f"{kind}:{text[start:end].lower()}")
                seen.append({"value": value, "seed": True, "span": "", "patterns": near.of(start, end)})
            for m in TOKEN.finditer(text):
                token = m[0].strip(".:!?|*#$%&-")
                start = m.start() + m[0].find(token) if token else m.start()
                end = start + len(token)
                if sum(c.isdigit() for c in token) < 4 and "@" not in token[1:-1]:
                    continue
                if any(a < end and start < b for _, a, b in found):
                    continue
                seen.append(
                    {
                        "value": digest(token.lower()),
                        "seed": False,
                        "span": f"context:{start}:{end}",
                        "patterns": near.of(start, end),
                    }
                )
            row = [sum(f[0] == kind for f in found) for kind in PRIVATE_KINDS] + [base, digest(base), seen]
            for column, value in zip(out, row, strict=True):
                column.append(value)
        struct = [("value", pa.string()), ("seed", pa.bool_()), ("span", pa.string()), ("patterns", pa.list_(pa.string()))]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.struct(struct))]
        names = [ROW, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "seen"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in names[:2]] + [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names
        )


def strong_patterns(places: DataFrame, support: int) -> DataFrame:
    """Patterns with at least ``support`` distinct instances, in at least as many documents (rows)."""
    # Two steps each: pairs first, so that a frequent pattern is combined before its pairs are counted.
    instances = places.select("pattern", "value").distinct().groupBy("pattern").agg(F.count("*").alias("n"))
    documents = places.select("pattern", ROW).distinct().groupBy("pattern").agg(F.count("*").alias("d"))
    return instances.where(F.col("n") >= support).join(documents.where(F.col("d") >= support), "pattern").select("pattern")


def score_instances(places: DataFrame, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """``value, score`` of instances that are no seeds, from their places: row, ``value, seed, pattern``."""
    # Patterns that too few share can never score; dropping their edges first leaves a small graph.
    edges = places.groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    edges = materialize(edges.join(strong_patterns(places, support), "pattern"), "edges")
    scores = edges.select("value", F.col("seed").cast("double").alias("score")).distinct()
    for _ in range(rounds):
        patterns = edges.join(scores, "value").groupBy("pattern").agg(F.avg("score").alias("worth"))
        # log1p of -1 is no number; a pattern of seeds alone is worth a little less than 1.
        doubt = F.log1p(-F.least(F.col("worth"), F.lit(0.999999)))
        raised = edges.join(patterns, "pattern").groupBy("value").agg(
            F.max("seed").alias("seed"), (1 - F.exp(F.sum(doubt))).alias("score")
        )
        scores = materialize(raised.select("value", F.when(F.col("seed"), 1.0).otherwise(F.col("score")).alias("score"), "seed"), "scores")
        seeds = scores
        scores = scores.select("value", "score")
    return seeds.where(~F.col("seed")).select("value", "score")


def find_private(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context``.

    Null text is empty and has no spans. Repeated rows are separate rows.
    """
    keyed = with_number(docs).select(ROW, F.col("doc_id").cast("long"), "text")
    found = materialize(keyed.mapInArrow(_scan, _FOUND), "private")
    seen = found.where(F.size("seen") > 0).select(ROW, F.explode("seen").alias("s")).select(ROW, "s.*")
    places = seen.select(ROW, "value", "seed", "span", F.explode("patterns").alias("pattern"))
    good = score_instances(places, support, rounds).where(F.col("score") >= confidence)
    added = (
        seen.where(~F.col("seed")).join(good, "value").groupBy(ROW).agg(F.collect_set("span").alias("added"))
    )
    return found.join(added, ROW, "left").select(
        "doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        "base_sha256",
        merged_list("base", F.col("added"), KINDS).alias("spans"),
        F.coalesce(F.size("added").cast("long"), F.lit(0)).alias("n_context"),
    )
