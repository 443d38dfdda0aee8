"""The operators over the given tables, as registered queries, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.registry import query
from snapweave.llm import binary, decontam, html, jaccard, langid, packing, pii, secrets, topk, urls


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op2_jaccard_join")
def jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op3_language_id")
def language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return langid.predict(docs, langid.train(docs))


RULES = [
    urls.parse_rule(text)
    for text in (
        "allow org/",
        "block example.org/es/",
        "block example.org/en/1",
        "allow com/fr/",
        "block com/de/",
    )
]


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _host_sql(url: str) -> str:
    return f"coalesce(translate(regexp_extract({url}, '://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}'), '')"


def _path_sql(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '://([^/?#]*)([^?#]*)', 2), '')"


def _rule_sql(host: str, path: str, field: int) -> str:
    """The longest fitting rule (field 1) or its action (field 0)."""
    cases = " ".join(
        f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(action, h + p)[field]}'"
        for action, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"CASE {cases} END"


_NODE = "split_part(node, '/', 1)", "substr(node, length(split_part(node, '/', 1)) + 1)"
URL_SQL = f"""WITH RECURSIVE judged AS (
      SELECT page_id, {_host_sql('url')} AS host, {_path_sql('url')} AS path, html FROM pages),
    tags AS (
      SELECT host, path, regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) AS target FROM (
        SELECT host, path, unnest(regexp_extract_all(html, '(?i)<link\\b[^>]*>')) AS tag FROM judged)
      WHERE regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?\\s*canonical\\b')
      UNION ALL
      SELECT host, path, regexp_extract(tag, '(?i)\\burl\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) FROM (
        SELECT host, path, unnest(regexp_extract_all(html, '(?i)<meta\\b[^>]*>')) AS tag FROM judged)
      WHERE regexp_matches(tag, '(?i)\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b')),
    named AS (
      SELECT host || path AS a, CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN 'http:' || target
        WHEN starts_with(target, '/') THEN 'http://' || host || target END AS target FROM tags WHERE host <> ''),
    edges AS (SELECT a, {_host_sql('target')} || {_path_sql('target')} AS b FROM named WHERE {_host_sql('target')} <> ''),
    both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
    reached AS (SELECT a AS node, b AS other FROM both_ways UNION SELECT r.node, e.b FROM reached r JOIN both_ways e ON e.a = r.other),
    members AS (SELECT node, least(node, min(other)) AS component FROM reached GROUP BY node),
    blocked AS (SELECT component, bool_or(coalesce({_rule_sql(*_NODE, 0)} = 'block', FALSE)) AS blocked FROM members GROUP BY component)
    SELECT page_id, host, path, {_rule_sql('host', 'path', 1)} AS rule,
      coalesce({_rule_sql('host', 'path', 0)}, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict, m.component
    FROM judged LEFT JOIN members m ON m.node = host || path LEFT JOIN blocked b ON b.component = m.component"""


@query("op4_url_filter", URL_SQL)
def url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf, "pages"), RULES)


@query("op5_private_data")
def private_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_private(table(spark, sf, "documents"))


@query("op6_main_text")
def main_text(spark: SparkSession, sf: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf, "pages"))


TOP_SQL = """WITH v AS (
      SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored QUALIFY rank <= 20"""


@query("op7_exact_top_k", TOP_SQL)
def exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op8_secret_scan")
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example")


@query("op9_decontamination")
def decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op10_token_files")
def token_files(spark: SparkSession, sf: str) -> DataFrame:
    return binary.binary_round_trip(spark, table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))
