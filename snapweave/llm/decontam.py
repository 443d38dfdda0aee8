"""Benchmark decontamination by pigeonhole edit matching.

An item of length n may occur in a document with up to k = ceil(``share`` * n) edits. Cut into
k + 1 pieces, at least one piece of it is then left unedited, so an occurrence is found by exact
hits of pieces and verified with Myers' bit-parallel distance of the item against the text
around the hit. Both sides are compared in lower case with every run of characters that are
neither letters nor digits as one space.

The items are the test set; they are sent to the tasks in blocks of at most ``BLOCK_CHARS``
characters, so a larger set takes more passes over the documents and no more memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from snapweave.llm.rows import released

SHARE = 0.06
LEAST_CHARS = 24  # shorter items are searched without edits, as whole words
LEAST_EXACT = 8  # still shorter ones are in any text: ``unsearched_items`` lists them
BLOCK_CHARS = 4_000_000
OTHER = re.compile(r"[\W_]+")
_FOUND = "doc_id bigint, item_id bigint, distance int, budget int, ends int"


def plain(text: str | None) -> str:
    """Lower case, one space for every run that is neither letter nor digit, none at the ends."""
    return OTHER.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their places."""
    n = budget + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, budget: int, masks: dict[str, int]) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to any substring of ``text`` and where that ends; None beyond the budget."""
    m = len(pattern)
    top, every = 1 << (m - 1), (1 << m) - 1
    up, down, score = every, 0, m
    best = None
    for place, char in enumerate(text):
        match = masks.get(char, 0)
        across = (((match & up) + up) ^ up) | match | down
        plus, minus = down | ~(across | up) & every, up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        # A match may begin anywhere in the text, so nothing is carried in at the top.
        plus, minus = (plus << 1) & every, (minus << 1) & every
        vertical = match | down
        up, down = minus | ~(vertical | plus) & every, plus & vertical
        if score <= budget and (best is None or score < best[0]):
            best = (score, place + 1)
            if not score:
                break
    return best


class Matcher:
    """Items of one block: their pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]], share: float, least: int = LEAST_CHARS):
        import ahocorasick

        self.items = []
        self.hits = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for number, text in items:
            budget = -int(-len(text) * share // 1) if len(text) >= least else 0
            if len(text) < least:
                text = f" {text} "  # between word borders
            masks: dict[str, int] = {}
            for k, char in enumerate(text):
                masks[char] = masks.get(char, 0) | 1 << k
            for at, piece in pieces(text, budget):
                places.setdefault(piece, []).append((len(self.items), at))
            self.items.append((number, text, budget, masks))
        for piece, where in places.items():
            self.hits.add_word(piece, (len(piece), where))
        if places:
            self.hits.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """``item, distance, budget, end`` of the best occurrence of each item that occurs."""
        found: dict[int, tuple[int, int]] = {}
        tried: dict[int, list[int]] = {}
        if not self.items or not text:
            return []
        text = f" {text} "
        for end, (length, where) in self.hits.iter(text):
            for index, at in where:
                _, item, budget, masks = self.items[index]
                if index in found and not found[index][0]:
                    continue
                begin = end + 1 - length - at  # of the item, if nothing is edited before the piece
                seen = tried.setdefault(index, [])
                # Windows reach budget characters to each side: one try covers begins within the same cell.
                cell = begin // (budget + 1)
                if cell in seen:
                    continue
                seen.append(cell)
                low = max(0, cell * (budget + 1) - budget)
                high = (cell + 1) * (budget + 1) + len(item) + budget
                got = myers(item, text[low:high], budget, masks)
                if got and (index not in found or got[0] < found[index][0]):
                    found[index] = (got[0], low + got[1])
        # Ends are told in the text as it was given, and without the border behind a short item.
        spaces = [1 + self.items[k][1].endswith(" ") for k in sorted(found)]
        return [(self.items[k][0], d, self.items[k][2], e - n) for n, (k, (d, e)) in zip(spaces, sorted(found.items()))]


def _blocks(benchmark: DataFrame, least: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, streamed to the driver. Null, empty and very short items match nothing."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        text = plain(row["text"])
        if len(text) < min(least, LEAST_EXACT):
            continue
        block.append((row["item_id"], text))
        size += len(text)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def unsearched_items(benchmark: DataFrame) -> DataFrame:
    """``item_id, reason`` of the items that ``find_leaks`` does not look for."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"(?U)[\W_]+", " "))
    reason = F.when(F.length(text) == 0, "no letter or digit").otherwise("too short to be told from chance")
    return benchmark.where(F.length(text) < LEAST_EXACT).select(F.col("item_id").cast("long"), reason.alias("reason"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, item_id, distance, budget, ends`` (where the occurrence ends in the plain text), one row per
    document and item that it holds within the budget. Null text holds nothing; repeated rows give repeated rows."""
    spark = docs.sparkSession
    out = None
    for items in _blocks(benchmark, least):
        sent = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, share, least)
            for batch in batches:
                rows = []
                numbers = batch.column("doc_id").to_pylist()
                for number, text in zip(numbers, batch.column("text").to_pylist(), strict=True):
                    rows += [(number, *hit) for hit in matcher.find(plain(text))]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                    names = ["doc_id", "item_id", "distance", "budget", "ends"]
                    arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(search), _FOUND)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], _FOUND)


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least: int = LEAST_CHARS) -> DataFrame:
    """Rows that hold no item within its budget; all columns as they are."""
    schema = docs.schema
    for items in _blocks(benchmark, least):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, share, least)
            for batch in batches:
                good = [not matcher.find(plain(t)) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(good, pa.bool_()))

        docs = docs.mapInArrow(released(clean), schema)
    return docs
