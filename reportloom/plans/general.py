"""Queries of the general data problems: units (p3) and references (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.operators import references as R
from reportloom.operators import units as U
from reportloom.session import table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return U.converted_rows(table(spark, sf, "input_entities"), table(spark, sf, "metric_units"))


def p3_by_unit(spark: SparkSession, sf: str) -> DataFrame:
    q = U.convert_quantities(table(spark, sf, "input_entities"), table(spark, sf, "metric_units"))
    return q.groupBy("common_unit").agg(
        F.count(F.lit(1)).alias("rows"), F.count("common_value").alias("converted"), F.count_if(F.col("factor") != 1).alias("rescaled"), F.min("common_value").alias("least"), F.max("common_value").alias("most")
    )


def orphans(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    parents = [
        R.parent_keys(t("chunks"), "chunks", "chunk_id", "ingested_at", "deleted_at"),
        R.parent_keys(t("canonical_entities"), "canonical_entities", "canonical_id", "created_at", "deleted_at"),
    ]
    golden = t("golden_test").select("id", "created_at", F.explode("source_chunk_ids").alias("ref"))
    children = [
        R.child_keys(t("input_entities"), "input_entities", "id", "source_chunk_id", "chunks", "extracted_at"),
        R.child_keys(golden, "golden_test", "id", "ref", "chunks", "created_at"),
        R.child_keys(t("aliases"), "aliases", "alias_id", "canonical_entity_id", "canonical_entities", "resolved_at"),
    ]
    return R.orphan_references(parents, children)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphans(spark, sf).select("table_name", "record_key", "missing_key", "reason").distinct()


def p6_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.orphan_counts(orphans(spark, sf))


def _values(rows: list[tuple[str, ...]]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


_GAP = r" \x{00a0}\x{2009}\x{202f}"
_NUMBER = rf"\d{{1,3}}(?:[{_GAP}]\d{{3}})+(?:[.,]\d+)?|\d[\d.,]*"
_BRACKET = rf"[(\[]([^()\[\]]*[^\d\s.,()\[\]{_GAP}\-−][^()\[\]]*)[)\]]"
_BLANK = r"[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}]"


def _sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _sql_phrase(c: str) -> str:
    t = f"regexp_replace(lower(replace({c}, 'İ', 'i')), '[''’´`]000', ' thousand ', 'g')"
    # m2, m3, km2 and tco2e keep their digit: it is hidden while numbers go
    t = f"regexp_replace({t}, '(m|tco)(\\d)', '\\1#\\2', 'g')"
    t = f"regexp_replace({t}, '#(\\d)|(?:{_NUMBER})', '\\1 ', 'g')"
    t = f"replace({t}, 'tco2 e', 'tco2e')"
    t = f"regexp_replace(replace({t}, 'mw-h', 'mw~h'), '[-−–—.,()\\[\\]+]', ' ', 'g')"
    return f"trim(regexp_replace(replace({t}, 'mw~h', 'mw-h'), '[\\s{_GAP}]+', ' ', 'g'))"


_CONVERTED = f"""
WITH u AS (SELECT dimension, unit, factor::DECIMAL(22,3) AS factor, unnest(string_split(alias, '|')) AS alias FROM ({_values(U.known_units())}) t(dimension, unit, factor, alias, o, v)),
s AS (SELECT scale::DECIMAL(22,3) AS scale, unnest(string_split(word, '|')) AS word FROM ({_values(U.SCALES)}) t(scale, word)),
forms AS (
  SELECT dimension, alias AS phrase, unit, factor, NULL::DECIMAL(22,3) AS scale, 0 AS p FROM u
  UNION ALL SELECT d.dimension, word, NULL, NULL, scale, 1 FROM (SELECT DISTINCT dimension FROM u) d, s
  UNION ALL SELECT dimension, word || ' ' || alias, unit, factor, scale, 2 FROM u, s
  UNION ALL SELECT dimension, alias || ' ' || word, unit, factor, scale, 3 FROM u, s),
a AS (SELECT * FROM forms QUALIFY row_number() OVER (PARTITION BY dimension, phrase ORDER BY p) = 1),
k AS (SELECT regexp_replace(lower({_sql_strip('metric_key')}), '[\\s_-]+', '_', 'g') AS k, min(dimension) AS dimension, min(lower(common_unit)) AS own FROM metric_units GROUP BY 1),
e0 AS (SELECT DISTINCT id, properties['metric_key'] AS mk, coalesce(properties['name'], canonical_name) AS nm,
    CASE WHEN regexp_matches(properties['reported_value'], '\\S') THEN properties['reported_value'] END AS rv, properties['value'] AS v, properties['unit'] AS pu, properties['scale'] AS ps,
    regexp_extract(evidence_text, '{_BRACKET}', 1) AS br, lower(regexp_extract(source_file, '__([A-Za-z]{{2}})__', 1)) AS lang
  FROM input_entities WHERE type = 'FinancialMetric'),
e1 AS (SELECT id, v, rv, lang = 'en' AS en, regexp_replace(lower({_sql_strip('mk')}), '[\\s_-]+', '_', 'g') AS k,
    regexp_replace(translate(lower(replace(nm, 'İ', 'i')), '{U.FOLD[0]}', '{U.FOLD[1]}'), '[^a-z0-9]', '', 'g') AS nm,
    regexp_replace(rv, '[''’´`]000', ' ', 'g') AS t, {_sql_phrase('rv')} AS said, {_sql_phrase('br')} AS note, lower({_sql_strip('pu')}) AS pu, lower({_sql_strip('ps')}) AS ps FROM e0),
e2 AS (SELECT *, regexp_replace(regexp_extract(t, '{_NUMBER}'), '[{_GAP}]|[.,]+$', '', 'g') AS raw FROM e1),
e3 AS (SELECT *, CASE WHEN en THEN regexp_matches(raw, '^\\d+,\\d+$') AND NOT regexp_matches(raw, '^\\d+,\\d{{3}}$')
    ELSE regexp_matches(raw, '^\\d+\\.\\d+$') AND NOT regexp_matches(raw, '^\\d+\\.\\d{{3}}$') END AS odd FROM e2),
e4 AS (SELECT *, TRY_CAST(CASE WHEN en <> odd THEN replace(raw, ',', '') ELSE replace(replace(raw, '.', ''), ',', '.') END AS DECIMAL(16,4)) AS x FROM e3),
e5 AS (SELECT id, k, nm, said, note, pu, ps,
    CASE WHEN rv IS NULL THEN TRY_CAST(v AS DECIMAL(16,4)) WHEN regexp_matches(t, '[-−–]\\s*\\d|\\(\\s*\\d[^()]*\\)') THEN -x ELSE x END AS number FROM e4),
e6 AS (SELECT e5.*, k.dimension AS d1, k.own FROM e5 LEFT JOIN k USING (k)),
named AS (SELECT nm, d1 FROM (SELECT nm, d1, count(DISTINCT id) AS n FROM e6 WHERE d1 IS NOT NULL AND nm <> '' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY nm ORDER BY n DESC, d1 DESC) = 1),
e7 AS (SELECT e6.*, coalesce(e6.d1, named.d1) AS dimension FROM e6 LEFT JOIN named USING (nm)),
ps AS (SELECT *, coalesce((SELECT scale FROM s WHERE word = ps LIMIT 1), TRY_CAST(TRY_CAST(CASE WHEN regexp_matches(ps, '^\\d{{1,3}}([.,]\\d{{3}})+$') THEN regexp_replace(ps, '[.,]', '', 'g') ELSE ps END AS DOUBLE) AS DECIMAL(22,3))) AS pscale FROM e7),
q AS (SELECT ps.id, ps.number, coalesce(x.unit, y.unit, z.unit, w.unit) AS common_unit,
    coalesce(x.scale, y.scale, ps.pscale, 1) AS scale, coalesce(x.factor, y.factor, z.factor, w.factor) AS unit_factor
  FROM ps LEFT JOIN a x ON x.dimension = ps.dimension AND x.phrase = ps.said LEFT JOIN a y ON y.dimension = ps.dimension AND y.phrase = ps.note
  LEFT JOIN a z ON z.dimension = ps.dimension AND z.phrase = ps.pu LEFT JOIN a w ON w.dimension = ps.dimension AND w.phrase = ps.own),
c AS (SELECT id AS entity_id, common_unit, (scale::DECIMAL(12,0) * unit_factor) AS factor, round(number * (scale::DECIMAL(12,0) * unit_factor)::DECIMAL(22,3), 0)::BIGINT AS common_value FROM q)
"""

_ORPHANS = f"""
WITH p AS (SELECT 'chunks' AS parent, lower({_sql_strip('chunk_id')}) AS key, min(ingested_at) AS arrived, bool_and(deleted_at IS NOT NULL) AS gone FROM chunks GROUP BY 1, 2
  UNION ALL SELECT 'canonical_entities', lower({_sql_strip('canonical_id')}), min(created_at), bool_and(deleted_at IS NOT NULL) FROM canonical_entities GROUP BY 1, 2),
c AS (SELECT 'input_entities' AS table_name, id AS record_key, 'chunks' AS parent, lower({_sql_strip('source_chunk_id')}) AS key, extracted_at AS ts FROM input_entities
  UNION SELECT 'golden_test', id, 'chunks', lower({_sql_strip('x')}), created_at FROM (SELECT id, created_at, unnest(source_chunk_ids) AS x FROM golden_test)
  UNION SELECT 'aliases', alias_id, 'canonical_entities', lower({_sql_strip('canonical_entity_id')}), resolved_at FROM aliases),
f AS (SELECT DISTINCT table_name, record_key, c.key AS missing_key, CAST(date_trunc('month', ts) AS DATE) AS period,
    CASE WHEN p.key IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN arrived > ts THEN 'late' END AS reason
  FROM c LEFT JOIN p ON p.parent = c.parent AND p.key = c.key WHERE c.key <> '')
"""

QUERIES = {"p3_found": p3_found, "p3_by_unit": p3_by_unit, "p6_found": p6_found, "p6_counts": p6_counts}
SQL = {
    "p3_found": _CONVERTED + "SELECT DISTINCT entity_id, common_value, common_unit FROM c WHERE factor <> 1 AND common_value IS NOT NULL",
    "p3_by_unit": _CONVERTED + "SELECT common_unit, count(*) AS rows, count(common_value) AS converted, count(*) FILTER (WHERE factor <> 1) AS rescaled, min(common_value) AS least, max(common_value) AS most FROM c GROUP BY 1",
    "p6_found": _ORPHANS + "SELECT DISTINCT table_name, record_key, missing_key, reason FROM f WHERE reason IS NOT NULL",
    "p6_counts": _ORPHANS + "SELECT table_name, period, reason, count(*) AS orphan_refs, count(DISTINCT record_key) AS records FROM f WHERE reason IS NOT NULL GROUP BY 1, 2, 3",
}
