"""URL filter with redirect equivalence.

A rule is an action, a host and a path: it fits its host and all subdomains where the path
starts with the rule's; the longest fitting rule decides. Pages that no rule decides take part
in redirect equivalence: canonical links and refresh redirects join addresses (host and path),
and a component that holds a blocked address is blocked. An explicit allow always comes
first: it keeps its own address allowed and is not overruled by the component.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from snapweave.llm.components import connected_components
from snapweave.runtime import materialize

Rule = tuple[str, str, str]  # action, host, path

_ADDRESS = "://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null and for no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, _ADDRESS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as ``struct(rule, action)``; null if none fits. Rules are a short list of literals."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        named = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, named).otherwise(out)
    return out


def _tags(html: Column, name: str, marked: str) -> Column:
    found = F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b[^>]*>"), F.lit(0))
    return F.filter(found, lambda tag: tag.rlike(marked))


def redirect_edges(pages: DataFrame) -> DataFrame:
    """``a, b``: a page's address and the address that its canonical link or refresh redirect names.

    Targets may be whole addresses, ``//host/path`` or ``/path``; others name no address of their own.
    """
    html = F.col("html")
    canonical = F.transform(
        _tags(html, "link", r"(?i)\brel\s*=\s*[\"']?\s*canonical\b"),
        lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)", 1),
    )
    refresh = F.transform(
        _tags(html, "meta", r"(?i)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"),
        lambda t: F.regexp_extract(t, r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", 1),
    )
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    to = F.col("to")
    target = (
        F.when(to.contains("://"), to)
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("/"), F.concat(F.lit("http://"), F.col("host"), to))
    )
    named = pages.where(F.lower(html).rlike("canonical|refresh")).select(
        host.alias("host"), path.alias("path"), F.explode(F.concat(canonical, refresh)).alias("to")
    )
    return (
        named.where(F.col("host") != "")
        .select(F.concat("host", "path").alias("a"), "host", target.alias("target"))
        .where(host_of(F.col("target")) != "")
        .select("a", F.concat(host_of(F.col("target")), path_of(F.col("target"))).alias("b"))
        .distinct()
    )


def judge_urls(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``page_id, host, path, rule, verdict, component`` for every row of ``pages`` (``page_id, url, html``).

    Null addresses have an empty host and path, fit no rule and are allowed. Repeated rows are judged each.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn(
        "found", rule_of(F.col("host"), F.col("path"), rules)
    )
    members = connected_components(materialize(redirect_edges(pages), "redirects"))
    # An address is cut into host and path again where its first slash is; hosts hold none.
    own = F.substring_index("node", "/", 1)
    rest = F.expr("substring(node, length(substring_index(node, '/', 1)) + 1)")
    ruled = members.withColumn("found", rule_of(own, rest, rules))
    blocked = ruled.groupBy("component").agg(F.bool_or(F.col("found.action") == "block").alias("blocked"))
    alias = members.join(blocked, "component")
    return (
        judged.withColumn("node", F.concat("host", "path"))
        .join(alias, "node", "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("found.rule").alias("rule"),
            F.coalesce(F.col("found.action"), F.when(F.col("blocked"), "block"), F.lit("allow")).alias("verdict"),
            "component",
        )
    )


def parse_rule(text: str) -> Rule:
    """``block example.org/es/`` as a rule."""
    found = re.fullmatch(r"(allow|block) ([^/]+)(/.*)?", text)
    if not found:
        raise ValueError(f"no rule: {text}")
    return found[1], found[2].lower(), found[3] or ""
