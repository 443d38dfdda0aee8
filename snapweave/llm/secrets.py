"""Secret scan with corpus-wide ownership.

A credential that many owners or many repositories have is a copied example; one that a single
owner has in few repositories looks live. A first pass hashes the values of base spans. Their lengths and a bitmap of their hashes
go to the second pass, which hashes every occurrence of a possible credential: those values, bare
runs of their alphabet that may be one of them (whatever they look like), and bare tokens that
look like keys. The bitmap only spares rows: what it lets through by chance is told apart by the
whole hash. Repositories and owners of a hash are counted in two steps each (distinct pairs first,
combined before the shuffle, then per hash), so a value that a third of all documents quote has
no task of its own. A document without an owner is an owner of its own, and one without a repository
a repository of its own. The method adds, as kind ``live``, bare occurrences outside the base spans whose value

* is the value of a base span somewhere in the corpus and belongs to at most ``owners`` owners and at
  most ``repos`` repositories, or
* has the make-up of a key (both letter cases and digits) and belongs to one owner in one repository.

A value is taken without ``=`` before it and full stops after it. A bare run of its alphabet is tried
whole, from behind each ``=`` and between them. Base spans stay whatever their owners; ``n_example`` and ``n_live`` say how many base values
are copied examples and how many are live. Values are only kept as hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from snapweave.llm.rows import ROW, merged_list, numbered, released, with_number
from snapweave.llm.spans import SECRET_KINDS, digest, listed, secret_spans
from snapweave.runtime import materialize

KINDS = (*SECRET_KINDS, "live")
OWNERS = 1  # a value of more owners is no live credential
REPOS = 5  # nor is one of more repositories, whoever owns them
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}+")
LEAST_CHARS = 12  # of a base value
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
EQUALS = re.compile(r"=+")
BITS = 26  # the bitmap has 2 ** BITS places (8 MB)

_FOUND = (
    f"{ROW} bigint, doc_id bigint, repo string, owner string, n_assign bigint, n_access bigint, n_hex bigint, "
    "base string, base_sha256 string, values array<string>, bare array<struct<value:string,mixed:boolean,a:int,b:int>>"
)


def _has_key_shape(token: str) -> tuple[bool, bool]:
    """Whether a token may be a credential, and whether it mixes both letter cases and digits."""
    lower, upper = any(c.islower() for c in token), any(c.isupper() for c in token)
    numbers = sum(c.isdigit() for c in token)
    return numbers >= 3 and (lower or upper) and len(set(token)) >= 8, lower and upper and numbers >= 3


def canonical(value: str) -> str:
    """What is compared: no ``=`` before and no full stop after the value, unless too little is left."""
    short = value.lstrip("=").rstrip(".")
    return short if len(short) >= LEAST_CHARS else value


def _runs(text: str, lengths: frozenset[int]) -> Iterator[tuple[int, int]]:
    """Places of runs of the base alphabet, whole, from behind each ``=`` and between them, that have a base value's length."""
    for m in RUN.finditer(text):
        equals = [(m.start() + e.start(), m.start() + e.end()) for e in EQUALS.finditer(m[0])]
        stop = m.start() + len(m[0].rstrip("."))
        for begin, end in zip([m.start(), *[e for _, e in equals]], [*[e for e, _ in equals], m.end()], strict=True):
            if m.end() - begin in lengths:
                yield begin, m.end()
            if stop - begin in lengths and stop < m.end():
                yield begin, stop
            if end < m.end():
                if end - begin in lengths:
                    yield begin, end
                while end > begin and text[end - 1] == ".":
                    end -= 1
                    if end - begin in lengths:
                        yield begin, end


def _base_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {canonical(f[3]) for text in batch.column("text").to_pylist() for f in secret_spans(text or "")}
        if found:
            values = [pa.array(list(map(digest, found)), pa.string()), pa.array(list(map(len, found)), pa.int32())]
            yield pa.RecordBatch.from_arrays(values, names=["value", "length"])


def _known(docs: DataFrame) -> tuple[np.ndarray, frozenset[int]]:
    """Bitmap of the hashes of all base values, and their lengths."""
    values = docs.select("text").mapInArrow(released(_base_values), "value string, length int").distinct()
    values = materialize(values, "base_values")
    place = F.shiftright(F.conv(F.substring("value", 1, 7), 16, 10).cast("long"), 28 - BITS)
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))")
    words = values.select(place.alias("place")).groupBy(F.expr("place div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    table = words.toArrow()
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    bitmap[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return bitmap, frozenset(r["length"] for r in values.select("length").distinct().toLocalIterator())


def _scanner(bitmap, lengths: frozenset[int]):
    """``bitmap``: broadcast."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bitmap.value
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in batch.column("text").to_pylist():
                text = text or ""
                found = list(secret_spans(text))
                base = listed([f[:3] for f in found], SECRET_KINDS)
                bare: dict[tuple[int, int], dict] = {}
                for a, b in _runs(text, lengths):
                    if canonical(text[a:b]) != text[a:b]:
                        continue  # the same value is met without what surrounds it
                    value = digest(text[a:b])
                    place = int(value[:7], 16) >> (28 - BITS)
                    if int(known[place >> 6]) >> (place & 63) & 1 and not any(x <= a and b <= y for _, x, y, _ in found):
                        bare[a, b] = {"value": value, "mixed": False, "a": a, "b": b}
                for m in TOKEN.finditer(text):
                    possible, mixed = _has_key_shape(m[0])
                    if possible and not any(a < m.end() and m.start() < b for _, a, b, _ in found):
                        bare[m.span()] = {"value": digest(canonical(m[0])), "mixed": mixed, "a": m.start(), "b": m.end()}
                row = [sum(f[0] == kind for f in found) for kind in SECRET_KINDS]
                row += [base, digest(base), sorted({digest(canonical(f[3])) for f in found}), list(bare.values())]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.string())]
            kinds.append(pa.list_(pa.struct([("value", pa.string()), ("mixed", pa.bool_()), ("a", pa.int32()), ("b", pa.int32())])))
            names = [ROW, "doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base", "base_sha256", "values", "bare"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names[:4]] + [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names
            )

    return scan


def find_secrets(
    docs: DataFrame, repo: str = "doc_id", owner: str = "source", owners: int = OWNERS, repos: int = REPOS
) -> DataFrame:
    """One row per document: ``__row__, doc_id``, counts, ``base_sha256``, ``spans``, ``n_live``, ``n_example``, ``added``, ``live_values``.

    A live value has at most ``owners`` owners and at most ``repos`` repositories; ``added`` lists the added spans and
    ``live_values`` the base values that are live. Null text is empty and has no spans; each row without an owner
    is an owner of its own, each without a repository a repository of its own. ``docs`` may be numbered already.
    """
    keyed = (docs if ROW in docs.columns else with_number(docs)).select(
        ROW,
        F.col("doc_id").cast("long"),
        F.col(repo).cast("string").alias("repo"),
        F.col(owner).cast("string").alias("owner"),
        "text",
    )
    bitmap, lengths = _known(docs)
    scan = _scanner(docs.sparkSession.sparkContext.broadcast(bitmap), lengths)
    # Compact before the few rows that hold anything are looked at again.
    found = materialize(keyed.mapInArrow(released(scan), _FOUND), "secrets")
    # Numbers of rows that lack a name stand apart from all names.
    who = [F.struct(c, F.when(F.col(c).isNull(), F.col(ROW)).alias(ROW)).alias(c) for c in ("repo", "owner")]
    named = found.where(F.size("values") > 0).select(ROW, *who, F.explode("values").alias("value"))
    bare = found.where(F.size("bare") > 0).select(ROW, *who, F.explode("bare").alias("b")).select(ROW, "repo", "owner", "b.*")
    seen = named.select("repo", "owner", "value", F.lit(True).alias("in_base")).unionByName(
        bare.select("repo", "owner", "value", F.lit(False).alias("in_base"))
    )
    per_repo = seen.groupBy("value", "repo").agg(F.max("in_base").alias("in_base"))
    per_repo = per_repo.groupBy("value").agg(F.count("*").alias("repos"), F.max("in_base").alias("in_base"))
    per_owner = seen.select("value", "owner").distinct().groupBy("value").agg(F.count("*").alias("owners"))
    stats = per_repo.join(per_owner, "value")
    specific = (F.col("owners") <= owners) & (F.col("repos") <= repos)
    stats = stats.withColumn("is_live", specific)
    stats = materialize(stats, "owners")
    live = stats.where("is_live")
    # Of spans within each other the longest is listed.
    ahead = Window.partitionBy(ROW).orderBy("a", F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    added = (
        bare.join(live, "value")
        .where(F.col("in_base") | (F.col("mixed") & (F.col("repos") == 1) & (F.col("owners") == 1)))
        .select(ROW, "a", "b", F.max("b").over(ahead).alias("reached"))
        .where(F.col("reached").isNull() | (F.col("b") > F.col("reached")))
        .groupBy(ROW)
        .agg(F.collect_set(F.concat_ws(":", F.lit("live"), "a", "b")).alias("added"))
    )
    values = (
        named.join(stats, "value")
        .groupBy(ROW)
        .agg(
            F.count_if("is_live").alias("n_live"),
            F.count_if(~F.col("is_live")).alias("n_example"),
            F.collect_set(F.when(F.col("is_live"), F.col("value"))).alias("live_values"),
        )
    )
    return (
        found.join(added, ROW, "left")
        .join(values, ROW, "left")
        .select(
            ROW,
            "doc_id",
            "n_assign",
            "n_access",
            "n_hex",
            "base_sha256",
            merged_list("base", F.col("added"), KINDS).alias("spans"),
            F.coalesce("n_live", F.lit(0)).alias("n_live"),
            F.coalesce("n_example", F.lit(0)).alias("n_example"),
            F.coalesce("added", F.array().cast("array<string>")).alias("added"),
            F.coalesce("live_values", F.array().cast("array<string>")).alias("live_values"),
        )
    )


MASK = "[secret]"
HIT = "__hit__"
# Rows with a live value whose numbers are sent to every task (some 40 MB); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def _masked(text: str, added: list[str], live_values: set[str]) -> str:
    spans = [tuple(map(int, s.split(":")[1:])) for s in added]
    for kind, start, end, value in secret_spans(text):
        if digest(canonical(value)) in live_values:
            spans.append((end - len(value), end) if kind == "assign" else (start, end))
    out, at = [], 0
    for start, end in sorted(spans):
        if end > at:
            out += [text[at : max(at, start)], MASK]
            at = end
    return "".join([*out, text[at:]])


def mask_live_secrets(docs: DataFrame) -> DataFrame:
    """Documents with live credentials masked in ``text`` (and ``n_chars`` counted anew, where there
    is one). Copied examples and every other document stay as they are."""
    names, schema, docs = docs.columns, docs.schema, numbered(docs)
    found = find_secrets(docs).where((F.size("added") > 0) | (F.size("live_values") > 0))
    hit = materialize(found.select(ROW, F.struct("added", "live_values").alias(HIT)), "live")
    ids = hit.select(ROW)
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)  # numbers only: the texts of other rows stay where they are
    untouched = docs.join(ids, ROW, "left_anti").select(*names)
    joined = docs.join(ids, ROW, "left_semi").join(hit, ROW)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("text").to_pylist(), batch.column(HIT).to_pylist(), strict=True)
            texts = [_masked(text, hit["added"], set(hit["live_values"])) for text, hit in rows]
            columns = {c: batch.column(c) for c in names}
            columns["text"] = pa.array(texts, batch.column("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array(list(map(len, texts)), columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    masked = joined.select(*names, HIT).mapInArrow(released(mask), schema)
    return untouched.unionByName(masked)
