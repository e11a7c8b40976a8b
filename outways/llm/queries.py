"""The registered queries of this subpackage: one thin function per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outways.llm import block_max, box_tree, forest_search, host_reputation, jaccard_groups, multiset_hash, packing, pfair_mix, piece_spans, quality_rules, site_templates, toxic_grammar, warc_fixity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit a damaged replica, derived from the pages, against the pages."""
    pages = _table(spark, sf_dir, "pages")
    return warc_fixity.audit(pages, warc_fixity.damaged_copy(pages))


def op2_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.schedule(_table(spark, sf_dir, "documents"))


def op4_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"))


def op5_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.joined(_table(spark, sf_dir, "documents"))


def op6_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return forest_search.searched(vectors, vectors.filter("vec_id % 100 = 0"))


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_reputation.judged_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_grammar.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.extracted(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "templates_removed")


def op11_piece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_spans.round_trip(_table(spark, sf_dir, "documents"))


def op12_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_max.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_box_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_tree.mined(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_merkle_fixity": op1_merkle_fixity,
    "op2_multiset_hash": op2_multiset_hash,
    "op3_pfair_mix": op3_pfair_mix,
    "op4_swap_packing": op4_swap_packing,
    "op5_token_groups": op5_token_groups,
    "op6_projection_forest": op6_projection_forest,
    "op7_host_reputation": op7_host_reputation,
    "op8_rule_ensemble": op8_rule_ensemble,
    "op9_toxic_grammar": op9_toxic_grammar,
    "op10_site_templates": op10_site_templates,
    "op11_piece_spans": op11_piece_spans,
    "op12_block_max": op12_block_max,
    "op13_box_tree": op13_box_tree,
}

_RECORD = (
    "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || "
    "CAST(strlen(coalesce(html, '')) AS STRING) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"
)
_LEAVES = "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY sha) - 1 AS INT) AS copy, sha, bytes FROM (SELECT page_id, sha256({0}) AS sha, CAST(strlen({0}) AS BIGINT) AS bytes FROM {1})"
_OP1 = f"""WITH own AS ({_LEAVES.format(_RECORD, "pages")}),
replica AS (SELECT page_id, url, CASE WHEN (page_id % 1009 * 31) % 50 = 0 THEN '~' || substring(coalesce(html, ''), 2) ELSE html END AS html
  FROM (SELECT *, unnest(range(CASE (page_id % 1009 * 31) % 50 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END)) AS i FROM pages)),
other AS ({_LEAVES.format(_RECORD, "replica")}),
placed AS (SELECT page_id, copy, coalesce(CAST(sum(bytes) OVER (PARTITION BY page_id // 1024 ORDER BY page_id, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS "offset", bytes FROM own)
SELECT page_id, copy, CASE WHEN other.sha IS NULL THEN 'missing' WHEN own.sha IS NULL THEN 'added' ELSE 'altered' END AS status, page_id // 1024 AS file, "offset", placed.bytes,
  own.sha AS primary_sha256, other.sha AS replica_sha256
FROM own FULL JOIN other USING (page_id, copy) LEFT JOIN placed USING (page_id, copy) WHERE own.sha IS DISTINCT FROM other.sha"""


def _strength(groups: str, mean: str) -> str:
    """The prior strength of a level by the method of moments, as one row ``k``."""
    return (
        f"SELECT CASE WHEN g < 2 OR coalesce(size <= 1, true) THEN 10.0::DOUBLE WHEN rho <= 0.001 THEN 1000.0::DOUBLE ELSE greatest(1.0::DOUBLE, 1 / least(rho, 0.999::DOUBLE) - 1) END AS k FROM ("
        f"SELECT *, (q / nullif(g - 1, 0) - 1) / nullif(size - 1, 0) AS rho FROM (SELECT *, (t - t2 / nullif(t, 0)) / nullif(g - 1, 0) AS size FROM (SELECT CAST(count(*) AS DOUBLE) AS g, CAST(sum(n) AS DOUBLE) AS t, "
        f"CAST(sum(n * n) AS DOUBLE) AS t2, sum((bad - n * {mean}) * (bad - n * {mean}) / (n * {mean} * (1 - {mean}))) AS q FROM {groups} WHERE n > 0)))"
    )


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


#: Literals, not the module's own, so that a wrong rule there shows: longest first.
_RULES = (("www.example.com", "/en/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("com", "/", "allow"))
_OP7 = f"""WITH own AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, TRY_CAST(regexp_extract(url, '://[^/?#]*[^?#]*?/([0-9]+)', 1) AS BIGINT) AS doc_id FROM pages),
named AS (SELECT host, CASE WHEN len(p) >= 3 AND length(p[-1]) = 2 AND p[-2] IN ('co', 'com', 'org', 'net', 'ac', 'gov', 'edu', 'ne', 'or') THEN p[-2] || '.' || p[-1] ELSE p[-1] END AS suffix
  FROM (SELECT DISTINCT host, string_split(host, '.') AS p FROM own)),
split AS (SELECT host, suffix, CASE WHEN len(string_split(host, '.')) > len(string_split(suffix, '.')) + 1
  THEN array_to_string(list_slice(string_split(host, '.'), -1 - len(string_split(suffix, '.')), -1), '.') ELSE host END AS domain FROM named),
outcome AS (SELECT doc_id, max(CAST(quality = 0 OR toxic = 1 AS INT)) AS bad FROM labels GROUP BY 1 HAVING max(CAST(quality = 0 OR toxic = 1 AS INT)) IS NOT NULL),
hosts AS (SELECT host, suffix, domain, n, bad FROM (SELECT host, count(*) AS n, CAST(sum(bad) AS BIGINT) AS bad FROM own JOIN outcome USING (doc_id) GROUP BY 1) JOIN split USING (host)),
corpus AS (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1.0::DOUBLE) AS m0 FROM hosts),
s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, any_value(m0) AS m0 FROM hosts, corpus GROUP BY 1), s1 AS (SELECT suffix, (bad + k * m0) / (n + k) AS m1 FROM s, ({_strength("s", "m0")})),
d AS (SELECT suffix, domain, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, any_value(m1) AS m1 FROM hosts JOIN s1 USING (suffix) GROUP BY ALL), k2 AS ({_strength("d", "m1")}), d1 AS (SELECT domain, (bad + k * m1) / (n + k) AS m2 FROM d, k2),
h AS (SELECT host, n, bad, m2 FROM hosts JOIN d1 USING (domain)), k3 AS ({_strength("h", "m2")}), h1 AS (SELECT host, n, bad, (bad + k * m2) / (n + k) AS mean, n + k AS weight FROM h, k3),
known AS (SELECT host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, CASE WHEN host = '' THEN m0 ELSE coalesce(mean, m2, m1, m0) END AS mean,
  CASE WHEN host = '' THEN 10.0::DOUBLE WHEN mean IS NOT NULL THEN weight WHEN m2 IS NOT NULL THEN k3.k WHEN m1 IS NOT NULL THEN k2.k ELSE 10.0::DOUBLE END AS weight
  FROM split LEFT JOIN h1 USING (host) LEFT JOIN d1 USING (domain) LEFT JOIN s1 USING (suffix), corpus, k2, k3),
bounded AS (SELECT *, greatest(0.0::DOUBLE, mean - 1.645::DOUBLE * sqrt(mean * (1 - mean) / (weight + 1))) AS low FROM own JOIN known USING (host))
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(a, b)} THEN '{a}{b}'" for a, b, _ in _RULES)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(a, b)} THEN '{v}'" for a, b, v in _RULES)} WHEN low > 0.3 THEN 'block' ELSE 'allow' END AS verdict,
  n AS n_labelled, bad AS n_bad, round(mean, 6) AS bad_rate, round(low, 6) AS bad_rate_bound FROM bounded"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_OP12 = f"""WITH words AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
docs AS (SELECT d, doc_id, len(terms) AS n, terms FROM words WHERE len(terms) > 0),
size AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nl FROM docs),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY ALL),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), size),
scored AS (SELECT item_id, doc_id, d, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nl)))) AS BIGINT) AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN docs USING (d), size GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20"""

_OP13 = """WITH fine AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
met AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM fine a JOIN fine b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN met USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""

#: Where DuckDB can say the same thing.
ORACLES: dict[str, str] = {"op13_box_tree": _OP13, "op12_block_max": _OP12, "op1_merkle_fixity": _OP1, "op7_host_reputation": _OP7}
