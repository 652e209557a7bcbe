"""Queries of the ontology's rules, and of the audit and repair of a graph with provenance, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from reportloom.operators import audit as A
from reportloom.operators import ontology as O
from reportloom.plans import snippets as S
from reportloom.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _text(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, float) else "[" + ", ".join(map(_text, x)) + "]" if isinstance(x, list) else "'" + str(x).replace("'", "''") + "'"


def _rows(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows)


# --- ontology: mentions with what the pipeline itself knows about them, as it writes them into the graph -------------

_OWN = ["id", "name", "source_chunk_id", "source_page"]
_NODES = f"""SELECT DISTINCT id, type, map_concat(map_from_entries(list_filter(map_entries(coalesce(properties, MAP {{}})), lambda x: NOT list_contains({_OWN}, x.key))),
MAP {{'id': id, 'name': coalesce(properties['name'], canonical_name), 'source_chunk_id': source_chunk_id, 'source_page': CAST(page_number AS VARCHAR)}}) AS p FROM input_entities"""
_FITS = "CASE kind " + " ".join(f"WHEN '{k}' THEN regexp_full_match(v, '{p}')" for k, p in O.KINDS.items()) + " END"


def _nodes(spark, sf):
    e = table(spark, sf, "input_entities")
    own = F.create_map(F.lit("id"), F.col("id"), F.lit("name"), F.coalesce(F.try_element_at("properties", F.lit("name")), F.col("canonical_name")), F.lit("source_chunk_id"), F.col("source_chunk_id"), F.lit("source_page"), F.col("page_number").cast("string"))
    rest = F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(_OWN))
    return e.select("id", "type", F.map_concat(rest, own).alias("properties"))


@query(f"""WITH n AS ({_NODES}), r(type, property, kind, required, pattern, allowed, least, most) AS ({_rows(O.property_rules())}),
e AS (SELECT n.id, n.type, x.key AS property, x.value AS v FROM n, unnest(map_entries(p)) t(x) WHERE x.value IS NOT NULL AND type IN (SELECT type FROM r)),
j AS (SELECT e.*, kind, pattern, allowed, least, most FROM e LEFT JOIN r USING (type, property))
SELECT DISTINCT id, property, problem FROM (
  SELECT id, NULL AS property, 'unknown_type' AS problem FROM n WHERE type IS NULL OR type NOT IN (SELECT type FROM r)
  UNION ALL SELECT n.id, r.property, 'missing_required' FROM n JOIN r ON r.type = n.type AND r.required WHERE n.p[r.property] IS NULL
  UNION ALL SELECT id, property, CASE WHEN kind IS NULL THEN 'unknown_property' WHEN NOT {_FITS} THEN 'type' WHEN trim(v) = '' THEN 'blank' WHEN NOT regexp_matches(v, pattern) THEN 'pattern'
    WHEN NOT list_contains(allowed, v) THEN 'allowed' WHEN kind IN ('INTEGER', 'FLOAT') AND TRY_CAST(v AS DOUBLE) < least THEN 'minimum' WHEN kind IN ('INTEGER', 'FLOAT') AND TRY_CAST(v AS DOUBLE) > most THEN 'maximum' END FROM j) WHERE problem IS NOT NULL""")
def ontology_violations(spark, sf):
    return O.property_problems(_nodes(spark, sf))


def _id_sql() -> str:
    p = lambda k: f"nullif(p['{k}'], '')"
    value = {"TICKER": f"coalesce({p('ticker')}, nullif(regexp_extract({p('company_id')}, '^company:(.+)$', 1), ''))", "normalized_name": f"coalesce({p('normalized_name')}, nullif({S.ascii_key(p('name'))}, ''))"}
    out = []
    for kind, (pattern, digested) in O.id_recipes().items():
        value["sha256"] = f"CASE WHEN {' AND '.join(p(d) + ' IS NOT NULL' for d in digested)} THEN {S.digest([p(d) for d in digested])} END" if digested else "NULL"
        parts = [f"'{x}'" if i % 2 == 0 else f"({value.get(x, p(x))})" for i, x in enumerate(re.split(r"\{(\w+)\}", pattern)) if x]
        out.append(f"WHEN '{kind}' THEN {' || '.join(parts)}")
    return "CASE type " + " ".join(out) + " END"


@query(f"SELECT DISTINCT id, type, {_id_sql()} AS node_id FROM (SELECT id, type, map_concat(p, MAP {{'source_report_id': 'report:' || regexp_replace(source_file, '^.*[:/]|\\.pdf$', '', 'g')}}) AS p FROM (SELECT n.*, source_file FROM ({_NODES}) n JOIN (SELECT id, min(source_file) AS source_file FROM input_entities GROUP BY 1) USING (id)))")
def ontology_ids(spark, sf):
    f = table(spark, sf, "input_entities").groupBy("id").agg(F.min("source_file").alias("source_file"))
    report = F.concat(F.lit("report:"), F.regexp_replace("source_file", r"^.*[:/]|\.pdf$", ""))
    n = _nodes(spark, sf).join(f, "id").withColumn("properties", F.map_concat(F.map_filter("properties", lambda k, v: k != "source_report_id"), F.create_map(F.lit("source_report_id"), report)))
    return n.select("id", "type", O.node_id(F.col("type"), F.col("properties")).alias("node_id")).distinct()


# an ontology with one fault of each kind
_FAULTY = O.property_rules() + [("Company", "name", "STRING", False, None, None, None, None), ("Widget", "colour", "STRING", True, None, None, None, None), ("Widget", "weight", "FLOAT", False, None, None, 5.0, 1.0)]
_FAULTY_EDGES = O.edge_rules() + [("MAKES", "Company", "Gadget")]
_FAULTY_IDS = O.id_recipes() | {"Widget": ("widget:{serial}:{sha256}", ["colour", "maker"])}
_INPUTS = [(t, x) for t, (p, d) in _FAULTY_IDS.items() for x in [*re.findall(r"\{(\w+)\}", p), *d] if x not in ("TICKER", "sha256")]


@query(f"""WITH r(type, property, kind, required, pattern, allowed, least, most) AS ({_rows(_FAULTY)}), e(kind, s, d) AS ({_rows(_FAULTY_EDGES)}), i(type, property) AS ({_rows(_INPUTS)})
SELECT DISTINCT * FROM (SELECT 'declared_twice' AS "check", type AS owner, property AS what FROM r GROUP BY 2, 3 HAVING count(*) > 1
UNION ALL SELECT 'key_not_required', type, 'id' FROM r GROUP BY 2 HAVING count(*) FILTER (WHERE property = 'id' AND required) = 0
UNION ALL SELECT 'undeclared_input', type, property FROM i WHERE (type, property) NOT IN (SELECT (type, property) FROM r)
UNION ALL SELECT 'unknown_label', kind, x FROM (SELECT kind, unnest([s, d]) AS x FROM e) WHERE x NOT IN (SELECT type FROM r) UNION ALL SELECT 'bad_bounds', type, property FROM r WHERE least > most)""")
def ontology_check(spark, sf):
    return spark.createDataFrame(O.ontology_problems(_FAULTY, _FAULTY_EDGES, _FAULTY_IDS), "check string, owner string, what string")


# --- audit ---------------------------------------------------------------------------------------------------------

_CHUNK = lambda c: f"'chunk:' || lower(trim({c}))"
_LOST = lambda c: f"lower(coalesce({c}, '')) IN ({', '.join(map(_text, A.PLACEHOLDERS))})"
_MENTIONS = f"""WITH en AS (SELECT id, type AS label, canonical_name AS name, source_chunk_id AS chunk, source_file AS file, evidence_text AS evidence, page_number AS page, TRY_CAST(regexp_extract(properties['date_id'], '(\\d{{4}})', 1) AS INT) AS year, confidence, properties['company_id'] AS company FROM input_entities),
nodes AS (SELECT id, min(label) AS label, min(name) AS name, min(chunk) AS chunk, min(file) AS file, min(evidence) AS evidence, min(page) AS page, min(year) AS year, min(confidence) AS confidence FROM (
  SELECT * EXCLUDE (company) FROM en UNION ALL SELECT {_CHUNK('chunk_id')}, 'Chunk', lower(trim(chunk_id)), chunk_id, source_file, document_id, page_number, year, NULL FROM chunks WHERE chunk_id IS NOT NULL
  UNION ALL SELECT company_id, 'Company', company_name, NULL, NULL, NULL, NULL, NULL, NULL FROM companies) WHERE id IS NOT NULL GROUP BY 1),
st AS (SELECT * FROM (SELECT 'EVIDENCED_BY' AS type, id AS src, {_CHUNK('chunk')} AS dst, chunk, file, page, confidence FROM en UNION ALL SELECT 'OFFERS', company, id, chunk, file, page, confidence FROM en WHERE label = 'Product'
  UNION ALL SELECT 'REPORTED_METRIC', company, id, chunk, file, page, confidence FROM en WHERE label = 'FinancialMetric' UNION ALL SELECT 'HOLDS_ROLE_AT', id, company, chunk, file, page, confidence FROM en WHERE label = 'Person') WHERE src IS NOT NULL AND dst IS NOT NULL),
ed AS (SELECT type, src, dst, min(chunk) AS chunk, min(file) AS file, min(page) AS page, max(coalesce(confidence, 1.0)) AS confidence, count(*) AS statements, {S.digest(['type', 'src', 'dst'])} AS id FROM st GROUP BY 1, 2, 3)"""
_AUDIT = _MENTIONS + f""", rules(type, s, d) AS ({_rows(O.edge_rules())}), kinds(category, severity, repairable) AS ({_rows(A.CATEGORIES)}),
x AS (SELECT ed.*, a.id IS NULL OR b.id IS NULL AS lost, a.label AS sl, b.label AS dl FROM ed LEFT JOIN nodes a ON a.id = ed.src LEFT JOIN nodes b ON b.id = ed.dst),
found AS (SELECT 'dangling_relation' AS category, 'edge' AS item, id AS item_id, type AS item_type FROM x WHERE lost UNION ALL SELECT 'duplicate_relation', 'edge', id, type FROM x WHERE statements > 1
  UNION ALL SELECT 'schema_violation', 'edge', id, type FROM x WHERE NOT lost AND type IN (SELECT type FROM rules) AND (type, sl, dl) NOT IN (SELECT (type, s, d) FROM rules)
  UNION ALL SELECT 'missing_grounding', 'edge', id, type FROM x WHERE {_LOST('chunk')} OR {_LOST('file')} UNION ALL SELECT 'invalid_page', 'edge', id, type FROM x WHERE page < 1 UNION ALL SELECT 'low_confidence', 'edge', id, type FROM x WHERE confidence < 0.5
  UNION ALL SELECT 'orphan_node', 'node', id, label FROM nodes WHERE id NOT IN (SELECT src FROM ed UNION SELECT dst FROM ed) UNION ALL SELECT 'missing_grounding', 'node', id, label FROM nodes WHERE {_LOST('chunk')} OR {_LOST('file')} OR trim(coalesce(evidence, '')) = ''
  UNION ALL SELECT 'invalid_page', 'node', id, label FROM nodes WHERE page < 1 UNION ALL SELECT 'invalid_year', 'node', id, label FROM nodes WHERE year < 1900 OR year > 2030 UNION ALL SELECT 'low_confidence', 'node', id, label FROM nodes WHERE confidence < 0.5
  UNION ALL SELECT 'conflicting_data', 'node', 'company:' || t, 'Company' FROM (SELECT upper(regexp_extract(id, '^company:([A-Za-z0-9._-]+)', 1)) AS t, count(DISTINCT name) AS k FROM nodes WHERE label = 'Company' AND trim(name) <> '' GROUP BY 1) WHERE t <> '' AND k > 1),
iss AS (SELECT * FROM found JOIN kinds USING (category))"""


def _mentions(spark, sf):
    return A.mention_graph(table(spark, sf, "input_entities"), table(spark, sf, "chunks"), table(spark, sf, "companies"))


@query(_AUDIT + " SELECT category, severity, repairable, item, item_type, count(*) AS issues FROM iss GROUP BY ALL")
def audit_categories(spark, sf):
    return A.audit_counts(A.audit_rows(*_mentions(spark, sf)))


@query(_AUDIT + " SELECT 'rev_' || category || '_' || item_id AS review_id, category, severity, item_id, item_type FROM iss WHERE NOT repairable")
def review_queue(spark, sf):
    return A.review_queue(A.audit_rows(*_mentions(spark, sf)))


@query(_AUDIT + """ SELECT count(*) FILTER (WHERE repairable) AS repaired, count(*) FILTER (WHERE category = 'dangling_relation') AS dangling_removed, count(*) FILTER (WHERE category = 'missing_grounding') AS grounding_patched,
count(*) FILTER (WHERE category = 'low_confidence') AS low_confidence_tagged, count(*) FILTER (WHERE NOT repairable) AS for_review FROM iss""")
def repair_summary(spark, sf):
    return A.repair_summary(A.audit_rows(*_mentions(spark, sf)))


@query(_MENTIONS + """ SELECT id, type, src, dst, coalesce(chunk, 'chunk_unknown') AS chunk, coalesce(file, 'source_unknown.pdf') AS file, CASE WHEN page >= 1 THEN page ELSE 1 END AS page, confidence < 0.5 AS low_confidence_flag
FROM ed WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)""")
def repaired_edges(spark, sf):
    return A.repaired_edges(*_mentions(spark, sf))


@query(_AUDIT + """, c AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM ed) AS relations, count(*) FILTER (WHERE category = 'duplicate_relation') AS duplicates, count(*) FILTER (WHERE category = 'orphan_node') AS orphans,
count(*) FILTER (WHERE category = 'missing_grounding') AS g, count(*) FILTER (WHERE category = 'schema_violation') AS s, count(*) FILTER (WHERE severity = 'critical') AS k FROM iss),
r AS (SELECT *, round(100.0::DOUBLE * (1.0::DOUBLE - g / greatest(1, nodes + relations)::DOUBLE), 2) AS lineage_rate, round(100.0::DOUBLE * (1.0::DOUBLE - s / greatest(1, relations)::DOUBLE), 2) AS schema_rate FROM c)
SELECT nodes, relations, duplicates, orphans, lineage_rate, schema_rate, k = 0 AND lineage_rate >= 90 AS signed_off FROM r""")
def final_rates(spark, sf):
    n, s = _mentions(spark, sf)
    return A.final_rates(A.audit_rows(n, s), n, s)


@query(_MENTIONS + " SELECT id, label, name FROM nodes WHERE label <> 'Chunk' ORDER BY id LIMIT 10")
def graph_sample(spark, sf):
    return A.ordered_sample(_mentions(spark, sf)[0].where("label <> 'Chunk'").select("id", "label", "name"), "id")
