"""Queries over whole tables of documents and labels: Merkle manifest, filter audit, toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalog.registry import query
from snapweave.llm import merkle
from snapweave.llm.filter_audit import audit_documents
from snapweave.llm.toxicity import judge_documents
from snapweave.llm.queries import table

_LEVELS = 16  # of the trees that the SQL can follow: 3**16 documents of one source

# The register of crc32 after the digits of ``n``; the sum itself is its complement.
_CRC = (
    "list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST({n} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), "
    "lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT for i in range(8)]), "
    "lambda a, i: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
)


def _field(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _trees(name: str, leaves: str) -> str:
    """CTEs of one tree per group: ``name_nodes`` (grp, level, pos, n, node, left and right siblings)."""
    parts = [f"{name}_0 AS ({leaves})"]
    for level in range(_LEVELS):
        parts.append(
            f"""{name}_{level + 1} AS (SELECT grp, pos // 3 AS pos, (any_value(n) + 2) // 3 AS n,
              CASE WHEN any_value(n) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node
              FROM {name}_{level} GROUP BY grp, pos // 3)"""
        )
    every = " UNION ALL ".join(f"SELECT {level} AS level, * FROM {name}_{level}" for level in range(_LEVELS))
    window = "OVER (PARTITION BY level, grp, pos // 3 ORDER BY pos ROWS BETWEEN"
    parts.append(
        f"""{name}_nodes AS (SELECT level, grp, pos, n,
          coalesce(string_agg(node, '') {window} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
          coalesce(string_agg(node, '') {window} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM ({every}) WHERE n > 1)"""
    )
    return ", ".join(parts)


MERKLE_SQL = f"""WITH RECURSIVE
    docs AS (SELECT doc_id, coalesce('=' || source, '') AS grp, {_leaf('text')} AS leaf,
      CASE WHEN ({_CRC.format(n='doc_id')} & 1) = 1 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS claim FROM documents),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM docs),
    {_trees("own", "SELECT grp, pos, n, leaf AS node FROM numbered")},
    roots AS (SELECT grp, node AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS place FROM own_{_LEVELS}),
    {_trees("top", "SELECT 'top' AS grp, place AS pos, (SELECT count(*) FROM roots) AS n, subroot AS node FROM roots")},
    -- Level by level: the folded leaf, the siblings so far; the source's tree first, the one over sources behind it.
    lower_path AS (SELECT doc_id, grp, leaf, pos AS at, 0 AS level, claim AS folded, '' AS proof FROM numbered
      UNION ALL SELECT p.doc_id, p.grp, p.leaf, p.at // 3, p.level + 1, sha256(s.l || p.folded || s.r), p.proof || s.l || s.r
      FROM lower_path p JOIN own_nodes s ON s.grp = p.grp AND s.level = p.level AND s.pos = p.at),
    lower_end AS (SELECT * FROM lower_path QUALIFY level = max(level) OVER (PARTITION BY grp)),
    upper_path AS (SELECT e.doc_id, e.leaf, r.subroot, r.place AS at, 0 AS level, e.folded, e.proof FROM lower_end e JOIN roots r USING (grp)
      UNION ALL SELECT p.doc_id, p.leaf, p.subroot, p.at // 3, p.level + 1, sha256(s.l || p.folded || s.r), p.proof || s.l || s.r
      FROM upper_path p JOIN top_nodes s ON s.level = p.level AND s.pos = p.at)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
    FROM upper_path, (SELECT node AS root FROM top_{_LEVELS}) QUALIFY level = max(level) OVER ()"""


@query("op11_merkle_manifest", MERKLE_SQL)
def merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf, "documents"))


# Failure of each filter as SQL over ``t`` (text), ``n`` (words), ``w`` (the words) and ``first`` (least doc_id of the text).
AUDIT_SQL = r"""WITH lettered AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM lettered a, lettered b, lettered c, lettered d, lettered e
      WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    flagged AS (SELECT part, coalesce(quality = 1, FALSE) AS good, coalesce(l.toxic = 1, FALSE) AS toxic,
      CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
      || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
      || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
      || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
      FROM texts d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
    grouped AS (SELECT part, fails, good, toxic, count(*) AS n FROM flagged GROUP BY ALL),
    steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, s, 1) AS f, left(filter_order, s - 1) AS ahead
      FROM orders, range(1, 6) r(s)),
    marked AS (SELECT part, filter_order, step, f, good, toxic, n, contains(fails, f) AS failing, fails = f AS alone,
      len(translate(fails, ahead, '')) < len(fails) AS gone FROM grouped, steps),
    counted AS (SELECT part, filter_order, step, f, sum(n) FILTER (NOT gone AND NOT failing) AS kept, sum(n) FILTER (NOT gone AND failing) AS removed,
      sum(n) FILTER (gone AND failing) AS redundant, sum(n) FILTER (alone) AS unique_fails, sum(n) FILTER (NOT gone AND failing AND good) AS good_lost,
      sum(n) FILTER (NOT gone AND failing AND toxic) AS toxic_lost FROM marked GROUP BY part, filter_order, step, f)
    SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
      CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
      CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
      CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM counted"""


@query("op12_filter_audit", AUDIT_SQL)
def filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op13_toxicity")
def toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return judge_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))
