"""Canonical names of true and predicted labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from snapweave.schema import HUMAN_NAMES, LABEL_NAMES, SPECIAL_SPELLINGS


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def true_label(raw: Column) -> Column:
    """Human-readable name (exact case, outer blanks ignored) to canonical; otherwise empty."""
    return F.coalesce(_lookup(dict(zip(HUMAN_NAMES, LABEL_NAMES)), F.trim(raw)), F.lit(""))


def predicted_label(raw: Column) -> Column:
    """Free spelling to canonical: exact, then cleaned, then special spellings; otherwise empty."""
    text = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    cleaned = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9_]+", "_"), "_+", "_")
    cleaned = F.regexp_replace(cleaned, "^_+|_+$", "")
    known = {name: name for name in LABEL_NAMES}
    return F.coalesce(
        _lookup(known, text),
        _lookup(known, cleaned),
        _lookup(SPECIAL_SPELLINGS, cleaned),
        F.lit(""),
    )
