"""Queries of the resolution of mentions by name and context, with their SQL: pairs, decisions, aliases, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.operators import claims as C
from reportloom.operators import contexts as X
from reportloom.plans import snippets as S
from reportloom.session import table

QUERIES, SQL = {}, {}
VERSION = "v1"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _renamed(key: str, names: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k.replace(' ', '_')}' THEN '{v}'" for k, v in names.items()) + f" ELSE {key} END"


_P = lambda k: f"nullif(trim(properties['{k}']), '')"
_TITLES = ", ".join(f"'{t}'" for t in X.PERSON_TITLES)
_NORM = f"""CASE type WHEN 'Company' THEN coalesce(upper({_P('ticker')}), {S.ascii_key('canonical_name')}) WHEN 'Person' THEN array_to_string(list_filter(string_split({S.ascii_key('canonical_name')}, '_'), lambda w: w NOT IN ({_TITLES})), '_')
WHEN 'FinancialMetric' THEN {_renamed(S.ascii_key(f"coalesce({_P('metric_key')}, canonical_name)"), X.METRIC_NAMES)} ELSE {S.ascii_key('canonical_name')} END"""
_YEAR = lambda c: f"nullif(regexp_extract({c}, '\\b((?:19|20)\\d{{2}})\\b', 1), '')"
_CONTEXTS = f"""e0 AS (SELECT id, type, canonical_name AS name, {_NORM} AS norm, {_P('ticker')} AS ticker, {_P('company_id')} AS own, coalesce({_P('source_report_id')}, 'report:' || regexp_replace(source_file, '^.*[:/]|\\.pdf$', '', 'g')) AS report_id,
  {_P('date_id')} AS date_id, upper({_P('scope')}) AS scope, upper({_P('unit')}) AS unit, TRY_CAST({_P('value')} AS DOUBLE) AS value, source_file AS file, evidence_text AS evidence FROM input_entities WHERE id IS NOT NULL),
e1 AS (SELECT id, {', '.join(f'min({c}) AS {c}' for c in 'type name norm ticker own report_id date_id scope unit value file evidence'.split())} FROM e0 GROUP BY 1),
e2 AS (SELECT *, nullif(upper(regexp_extract(report_id, '^report:(.*?)__', 1)), '') AS rt, {S.ascii_key('name')} AS k FROM e1),
tick AS (SELECT DISTINCT upper(ticker) AS t FROM companies), keys AS (SELECT k, min(t) AS t FROM (SELECT DISTINCT upper(ticker) AS t, unnest([{S.ascii_key('ticker')}, {S.ascii_key('company_name')}, {S.ascii_key('short_name')}]) AS k FROM companies) GROUP BY 1 HAVING count(*) = 1),
ctx AS (SELECT id, type, name, norm, CASE WHEN type = 'Company' THEN coalesce((SELECT t FROM tick WHERE t = upper(ticker)), (SELECT t FROM tick WHERE t = upper(regexp_extract(own, '^company:(.*)$', 1))), (SELECT t FROM tick WHERE t = rt), (SELECT t FROM keys WHERE keys.k = e2.k)) END AS identity,
  coalesce(own, CASE WHEN type = 'Company' THEN 'company:' || upper(ticker) END, 'company:' || rt) AS company_id, coalesce({_YEAR('date_id')}, {_YEAR('report_id')}, {_YEAR('file')})::INT AS year, report_id, date_id, scope, unit, value,
  list_sort(list_distinct(regexp_extract_all(coalesce(name, ''), '\\d+'))) AS codes, list_filter(list_distinct(string_split({S.ascii_key("coalesce(evidence, '')")}, '_')), lambda w: w <> '') AS tokens FROM e2)"""
_PAIRS = f"""WITH RECURSIVE {_CONTEXTS}, pr AS (SELECT a, b, max(s) AS s FROM (
  SELECT least(left_entity_id, right_entity_id) AS a, greatest(left_entity_id, right_entity_id) AS b, name_similarity AS s FROM resolution_decisions WHERE left_entity_id <> right_entity_id AND name_similarity IS NOT NULL
  UNION ALL SELECT min(id) OVER (PARTITION BY type, norm), id, 1.0 FROM ctx WHERE norm <> '') WHERE a <> b GROUP BY 1, 2),
j AS (SELECT a, b, s, l, r, coalesce(l.norm = r.norm, false) AS same, l.company_id IS NOT NULL AND r.company_id IS NOT NULL AS scoped, len(l.codes) > 0 AND len(r.codes) > 0 AS coded,
  abs(l.value - r.value) <= greatest(1e-9, 1e-6 * greatest(abs(l.value), abs(r.value))) AS fit, coalesce(l.company_id <> r.company_id, false) AS dc FROM pr JOIN (SELECT id AS a, ctx AS l FROM ctx) USING (a) JOIN (SELECT id AS b, ctx AS r FROM ctx) USING (b) WHERE l.type = r.type),
f AS (SELECT *, [{', '.join(f"CASE WHEN l.{c} = r.{c} THEN 'same_{c}' END" for c in X.FIELDS)}, CASE WHEN coded AND l.codes = r.codes THEN 'same_model_codes' END] AS sg,
  [{', '.join(f"CASE WHEN l.{c} <> r.{c} THEN 'different_{c}' END" for c in X.FIELDS)}, CASE WHEN coded AND l.codes <> r.codes THEN 'different_model_codes' END] AS cf, {S.jaccard('l.tokens', 'r.tokens')} AS words FROM j),
g AS (SELECT *, list_filter(sg, lambda x: x IS NOT NULL) AS sgs, list_filter(cf, lambda x: x IS NOT NULL) AS conflicts FROM f),
h AS (SELECT *, round(least(1.0::DOUBLE, 0.8::DOUBLE * (CASE WHEN len(sgs) + len(conflicts) > 0 THEN len(sgs) / (len(sgs) + len(conflicts))::DOUBLE ELSE 0.0 END) + 0.2::DOUBLE * words), 4) AS context_similarity,
  CASE WHEN words >= 0.25 THEN list_append(sgs, 'evidence_context_overlap') ELSE sgs END AS signals,
  CASE l.type WHEN 'Company' THEN CASE WHEN l.identity IS NOT NULL AND r.identity IS NOT NULL THEN CASE WHEN l.identity = r.identity THEN 'EXACT_MATCH one_registered_company' ELSE 'DIFFERENT_ENTITY two_registered_companies' END
    WHEN same THEN 'REVIEW_REQUIRED same_name_unregistered' WHEN s >= 0.92 THEN 'REVIEW_REQUIRED similar_name_unregistered' ELSE 'DIFFERENT_ENTITY names_differ' END
  WHEN 'Person' THEN CASE WHEN dc THEN 'DIFFERENT_ENTITY other_company' WHEN NOT scoped THEN CASE WHEN s >= 0.78 THEN 'REVIEW_REQUIRED no_company' ELSE 'DIFFERENT_ENTITY names_differ' END WHEN same THEN 'EXACT_MATCH same_name_and_company'
    WHEN s >= 0.86 AND l.report_id IS NOT DISTINCT FROM r.report_id THEN 'HIGH_CONFIDENCE_MATCH similar_name_in_report' WHEN s >= 0.9 AND l.year IS NOT DISTINCT FROM r.year THEN 'HIGH_CONFIDENCE_MATCH similar_name_in_year' WHEN s >= 0.78 THEN 'REVIEW_REQUIRED similar_name' ELSE 'DIFFERENT_ENTITY names_differ' END
  WHEN 'Product' THEN CASE WHEN dc THEN 'DIFFERENT_ENTITY other_company' WHEN coded AND l.codes <> r.codes THEN 'DIFFERENT_ENTITY other_model' WHEN NOT scoped THEN CASE WHEN s >= 0.75 THEN 'REVIEW_REQUIRED no_company' ELSE 'DIFFERENT_ENTITY names_differ' END WHEN same THEN 'EXACT_MATCH same_name_and_company'
    WHEN s >= 0.88 AND (list_has_any(l.codes, r.codes) OR l.report_id IS NOT DISTINCT FROM r.report_id) THEN 'HIGH_CONFIDENCE_MATCH similar_name_same_model' WHEN s >= 0.7 THEN 'REVIEW_REQUIRED similar_name' ELSE 'DIFFERENT_ENTITY names_differ' END
  WHEN 'FinancialMetric' THEN CASE WHEN dc OR coalesce(l.date_id <> r.date_id, false) OR coalesce(l.scope <> r.scope, false) OR coalesce(l.unit <> r.unit, false) OR coalesce(l.report_id <> r.report_id, false) THEN 'DIFFERENT_ENTITY other_observation' WHEN NOT same AND s < 0.85 THEN 'DIFFERENT_ENTITY names_differ'
    WHEN NOT fit THEN 'REVIEW_REQUIRED values_differ' WHEN same AND fit THEN 'EXACT_MATCH same_observation' WHEN same THEN 'HIGH_CONFIDENCE_MATCH value_missing' WHEN s >= 0.85 AND fit THEN 'HIGH_CONFIDENCE_MATCH similar_name_same_value' ELSE 'REVIEW_REQUIRED similar_name' END END AS verdict FROM g),
o AS (SELECT a, b, l.type AS type, s AS name_similarity, context_similarity, signals, conflicts, string_split(verdict, ' ')[1] AS match_class, string_split(verdict, ' ')[2] AS rationale FROM h)"""
_CANON = """, ac AS (SELECT a, b FROM o WHERE match_class IN ('EXACT_MATCH', 'HIGH_CONFIDENCE_MATCH')), en AS (SELECT a AS x, b AS y FROM ac UNION SELECT b, a FROM ac), rc AS (SELECT x AS id, x AS z FROM en UNION SELECT rc.id, en.y FROM rc JOIN en ON en.x = rc.z),
cn AS (SELECT id, min(z) AS canonical FROM rc GROUP BY 1)"""


def _outcomes(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Pairs of the decisions, and each mention with the first of its type and name, with their outcomes."""
    ctx = X.entity_contexts(table(spark, sf, "input_entities"), table(spark, sf, "companies"))
    d = table(spark, sf, "resolution_decisions").where("left_entity_id <> right_entity_id AND name_similarity IS NOT NULL")
    d = d.select(F.least("left_entity_id", "right_entity_id").alias("a"), F.greatest("left_entity_id", "right_entity_id").alias("b"), F.col("name_similarity").alias("s"))
    named = ctx.where("norm <> ''").select("id", "type", "norm")
    first = named.groupBy("type", "norm").agg(F.min("id").alias("a"))
    same = named.join(first, ["type", "norm"]).where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("s"))
    return X.resolution_pairs(d.unionByName(same).groupBy("a", "b").agg(F.max("s").alias("name_similarity")), ctx), ctx


@query(_PAIRS + " SELECT * FROM o")
def resolution_pairs(spark, sf):
    return _outcomes(spark, sf)[0]


@query(_PAIRS + " SELECT type, match_class, rationale, count(*) AS pairs FROM o GROUP BY ALL")
def resolution_outcomes(spark, sf):
    return _outcomes(spark, sf)[0].groupBy("type", "match_class", "rationale").agg(F.count(F.lit(1)).alias("pairs"))


@query(_PAIRS + _CANON + f""" SELECT 'decision:' || {S.digest([chr(39) + VERSION + chr(39), 'a', 'b', 'match_class'])} AS decision_id, o.*, coalesce(l.canonical, a) AS left_canonical_id, coalesce(r.canonical, b) AS right_canonical_id, coalesce(l.canonical, a) = coalesce(r.canonical, b) AS merged
FROM o LEFT JOIN cn l ON l.id = a LEFT JOIN cn r ON r.id = b""")
def decision_rows(spark, sf):
    return X.decision_rows(_outcomes(spark, sf)[0], VERSION)


@query(_PAIRS + _CANON + f""", bo AS (SELECT a AS id, b AS x, match_class, name_similarity AS s FROM o UNION ALL SELECT b, a, match_class, name_similarity FROM o),
be AS (SELECT id, bool_or(match_class = 'EXACT_MATCH') AS ex, bool_or(match_class = 'HIGH_CONFIDENCE_MATCH') AS hi, max({{'s': s, 'x': x}}) FILTER (WHERE match_class = 'REVIEW_REQUIRED') AS rv FROM bo GROUP BY 1),
n AS (SELECT ctx.id, type, name AS alias, norm AS normalized_alias, coalesce(canonical, ctx.id) AS canonical_id, coalesce(ex, false) AS ex, coalesce(hi, false) AS hi, CASE WHEN NOT coalesce(ex OR hi, false) THEN rv.x END AS other, canonical IS NOT NULL AS many FROM ctx LEFT JOIN be USING (id) LEFT JOIN cn USING (id))
SELECT 'alias:' || {S.digest([chr(39) + VERSION + chr(39), 'n.id', 'canonical_id'])} AS alias_id, n.id, type, alias, normalized_alias, canonical_id, coalesce(cn.canonical, other) AS candidate_canonical_id,
CASE WHEN ex THEN 'EXACT_MATCH' WHEN hi THEN 'HIGH_CONFIDENCE_MATCH' WHEN other IS NOT NULL THEN 'REVIEW_REQUIRED' ELSE 'DIFFERENT_ENTITY' END AS match_class, many AS auto_merged FROM n LEFT JOIN cn ON cn.id = n.other""")
def alias_rows(spark, sf):
    pairs, ctx = _outcomes(spark, sf)
    return X.alias_rows(ctx, pairs, VERSION)


# --- claims: what a metric row states, against the chunk that it names and the other chunks of that company and year --

_CLAIM_SQL = f"""WITH k AS (SELECT lower(trim(chunk_id)) AS chunk_id, max(ticker) AS ticker, max(company) AS company, max(year) AS year, {S.lower_tr('max(text)')} AS content FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
c AS (SELECT DISTINCT id AS claim_id, lower(trim(source_chunk_id)) AS chunk_id, upper(regexp_extract(id, ':([A-Z]+):', 1)) AS company, TRY_CAST(regexp_extract(properties['date_id'], '(20[0-9]{{2}})', 1) AS INT) AS year, nullif({S.lower_tr("trim(properties['reported_value'])")}, '') AS value, nullif({S.lower_tr("trim(properties['unit'])")}, '') AS unit FROM input_entities WHERE type = 'FinancialMetric'),
ch AS (SELECT c.*, CASE WHEN c.chunk_id IS NULL THEN 'no_evidence' WHEN k.chunk_id IS NULL THEN 'unknown_evidence'
  WHEN c.company <> '' AND NOT (contains(upper(coalesce(k.company, '')), c.company) OR contains(upper(coalesce(k.ticker, '')), c.company) OR contains(c.company, upper(coalesce(k.ticker, '')))) THEN 'company_mismatch'
  WHEN c.year <> k.year THEN 'year_mismatch' WHEN NOT contains(coalesce(content, ''), c.value) THEN 'value_mismatch' WHEN NOT contains(coalesce(content, ''), c.unit) THEN 'unit_mismatch' END AS fault FROM c LEFT JOIN k USING (chunk_id)),
nu AS (SELECT upper(ticker) AS company, year, chunk_id, content FROM k WHERE regexp_matches(coalesce(content, ''), '[0-9]') AND ticker IS NOT NULL AND year IS NOT NULL),
ok AS (SELECT * FROM ch WHERE fault IS NULL),
con AS (SELECT claim_id, chunk_id, value, count(*) AS n FROM (SELECT ok.claim_id, ok.chunk_id, ok.value, nu.chunk_id AS o FROM ok JOIN nu ON nu.company = ok.company AND nu.year = ok.year WHERE nu.chunk_id <> ok.chunk_id AND ok.value IS NOT NULL AND NOT contains(nu.content, ok.value)) GROUP BY 1, 2, 3)"""


@query(_CLAIM_SQL + """ SELECT ch.claim_id, ch.chunk_id, ch.value, ch.unit, coalesce(fault, CASE WHEN n > 0 THEN 'contradicted' END, 'verified') AS outcome, CASE WHEN fault IS NOT NULL THEN 'unsupported' WHEN n > 0 THEN 'contradicted' ELSE 'verified' END AS status,
coalesce(n, 0) AS contradicting FROM ch LEFT JOIN con ON con.claim_id = ch.claim_id AND con.chunk_id = ch.chunk_id AND con.value IS NOT DISTINCT FROM ch.value""")
def claim_checks(spark, sf):
    p = lambda k: F.nullif(T.lower_tr(F.trim(F.try_element_at("properties", F.lit(k)))), F.lit(""))
    claims = table(spark, sf, "input_entities").where("type = 'FinancialMetric'").select(
        F.col("id").alias("claim_id"), F.lower(F.trim("source_chunk_id")).alias("chunk_id"), F.upper(F.regexp_extract("id", ":([A-Z]+):", 1)).alias("company"),
        F.regexp_extract(F.try_element_at("properties", F.lit("date_id")), "(20[0-9]{2})", 1).try_cast("int").alias("year"), p("reported_value").alias("value"), p("unit").alias("unit"),
    )
    return C.check_claims(claims, table(spark, sf, "chunks")).select("claim_id", "chunk_id", "value", "unit", "outcome", "status", "contradicting")


@query(_CLAIM_SQL + """, st AS (SELECT coalesce(fault, CASE WHEN n > 0 THEN 'contradicted' END, 'verified') AS outcome FROM ch LEFT JOIN con ON con.claim_id = ch.claim_id AND con.chunk_id = ch.chunk_id AND con.value IS NOT DISTINCT FROM ch.value)
SELECT outcome, count(*) AS claims, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM st GROUP BY 1""")
def claim_summary(spark, sf):
    return C.claim_summary(claim_checks(spark, sf))
