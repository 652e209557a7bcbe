"""Queries of the graph, entity resolution, workflow and streaming, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.operators import graph as G
from reportloom.operators import ranking as K
from reportloom.operators import resolve as R
from reportloom.operators import workflow as W
from reportloom.plans import snippets as S
from reportloom.plans.texts import _KIND
from reportloom.session import table
from reportloom.streaming import events as V

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _graph(spark, sf):
    return G.report_graph(table(spark, sf, "companies"), table(spark, sf, "chunks"), table(spark, sf, "canonical_entities"))


_GRAPH = f"""live AS (SELECT * FROM chunks WHERE deleted_at IS NULL), ents AS (SELECT * FROM canonical_entities WHERE deleted_at IS NULL),
nodes AS (SELECT id, label, name FROM (
  SELECT company_id AS id, 'Company' AS label, short_name AS name FROM companies UNION ALL SELECT 'sector:' || sector, 'Sector', sector FROM companies
  UNION ALL SELECT 'report:' || document_id, 'Report', document_id FROM live UNION ALL SELECT chunk_id, 'Chunk', chunk_id FROM live UNION ALL SELECT canonical_id, type, canonical_name FROM ents)
  WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY label, name) = 1),
stated AS (SELECT * FROM (
  SELECT 'OPERATES_IN' AS type, company_id AS src, 'sector:' || sector AS dst, NULL::INT AS page, NULL::DOUBLE AS confidence FROM companies
  UNION ALL SELECT 'PUBLISHED', 'company:' || ticker, 'report:' || document_id, NULL, NULL FROM live
  UNION ALL SELECT 'HAS_CHUNK', 'report:' || document_id, chunk_id, page_number, NULL FROM live
  UNION ALL SELECT 'EVIDENCED_BY', canonical_id, trim(c), NULL, average_confidence FROM (SELECT canonical_id, average_confidence, unnest(source_chunk_ids) AS c FROM ents)
  UNION ALL SELECT 'HOLDS_ROLE_AT', canonical_id, properties['company_id'], NULL, average_confidence FROM ents WHERE type = 'Person') WHERE src IS NOT NULL AND dst IS NOT NULL),
edges AS (SELECT type, src, dst, min(page) AS page, max(confidence) AS confidence, count(*) AS statements, {S.digest(['type', 'src', 'dst'])} AS id FROM stated GROUP BY 1, 2, 3)"""
_WITH = "WITH " + _GRAPH
_RULES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in G.EDGE_RULES)
_ISSUES = f""", rules(type, sl, dl) AS (VALUES {_RULES}), dang AS (SELECT id, type, 'source' AS missing FROM edges WHERE src NOT IN (SELECT id FROM nodes) UNION ALL SELECT id, type, 'target' FROM edges WHERE dst NOT IN (SELECT id FROM nodes)),
orph AS (SELECT * FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)),
viol AS (SELECT e.id, e.type, a.label AS src_label, b.label AS dst_label FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.type IN (SELECT type FROM rules) AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.type = e.type AND r.sl = a.label AND r.dl = b.label)),
issues AS (SELECT 'dangling_edge' AS category, 'critical' AS severity, count(*) AS issues FROM dang UNION ALL SELECT 'orphan_node', 'warning', count(*) FROM orph UNION ALL SELECT 'schema_violation', 'critical', count(*) FROM viol
  UNION ALL SELECT 'invalid_page', 'warning', count(*) FROM edges WHERE page < 1 UNION ALL SELECT 'low_confidence', 'warning', count(*) FROM edges WHERE coalesce(confidence, 1.0) < 0.5
  UNION ALL SELECT 'missing_name', 'warning', count(*) FROM nodes WHERE coalesce(trim(name), '') = '')"""


@query(_WITH + " SELECT id, label, name FROM nodes")
def graph_nodes(spark, sf):
    return _graph(spark, sf)[0]


@query(_WITH + " SELECT id, type, src, dst, page, statements FROM edges")
def graph_edges(spark, sf):
    return _graph(spark, sf)[1].select("id", "type", "src", "dst", "page", "statements")


@query(_WITH + " SELECT 'node' AS what, label AS name, count(*) AS count FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY 2")
def label_counts(spark, sf):
    return G.label_counts(*_graph(spark, sf))


@query(_WITH + _ISSUES + " SELECT id, type, missing FROM dang")
def dangling_edges(spark, sf):
    n, e = _graph(spark, sf)
    return G.dangling_edges(e, n)


@query(_WITH + _ISSUES + " SELECT id, label, name FROM orph")
def orphan_nodes(spark, sf):
    return G.orphan_nodes(*_graph(spark, sf))


@query(_WITH + _ISSUES + " SELECT id, type, src_label, dst_label FROM viol")
def schema_violations(spark, sf):
    n, e = _graph(spark, sf)
    return G.schema_violations(e, n)


@query(_WITH + _ISSUES + " SELECT category, severity, issues FROM issues")
def audit_issues(spark, sf):
    return G.audit_issues(*_graph(spark, sf))


@query(_WITH + _ISSUES + """, t AS (SELECT sum(CASE WHEN severity = 'critical' THEN issues ELSE 0 END)::BIGINT AS critical, sum(CASE WHEN severity = 'warning' THEN issues ELSE 0 END)::BIGINT AS warnings, (SELECT count(*) FROM nodes) AS nodes FROM issues),
s AS (SELECT *, CASE WHEN nodes > 0 THEN greatest(0, least(100, 100 - 5 * critical - warnings)) END AS score FROM t) SELECT nodes, critical, warnings, score, score >= 80 AND critical = 0 AS passed FROM s""")
def quality_score(spark, sf):
    n, e = _graph(spark, sf)
    return G.quality_score(G.audit_issues(n, e), n)


@query(_WITH + " SELECT id, CASE WHEN page < 1 THEN 1 ELSE page END AS page, coalesce(confidence, 1.0) < 0.5 AS flagged FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")
def graph_repair(spark, sf):
    n, e = _graph(spark, sf)
    return G.repair(e, n).select("id", "page", "flagged")


@query("""SELECT 'HAS_CHUNK' AS type, document_id AS src, chunk_id AS dst, count(*) - 1 AS surplus FROM chunks WHERE document_id IS NOT NULL GROUP BY 2, 3 HAVING count(*) > 1""")
def duplicate_edges(spark, sf):
    c = table(spark, sf, "chunks").where("document_id IS NOT NULL").select(F.lit("HAS_CHUNK").alias("type"), F.col("document_id").alias("src"), F.col("chunk_id").alias("dst"))
    return G.duplicate_edges(c)


@query("SELECT ticker, count(DISTINCT trim(company)) AS names FROM chunks WHERE trim(company) <> '' GROUP BY 1 HAVING count(DISTINCT trim(company)) > 1")
def conflicting_names(spark, sf):
    return G.conflicting_names(table(spark, sf, "chunks"), "ticker", "company")


@query("""SELECT coalesce(a.id, b.id) AS id, coalesce(b.name, a.name) AS name, coalesce(b.kind, a.kind) AS kind FROM (SELECT company_id AS id, company_name AS name, sector AS kind FROM companies) a
FULL JOIN (SELECT canonical_id AS id, min(canonical_name) AS name, NULL::VARCHAR AS kind FROM canonical_entities GROUP BY 1) b ON a.id = b.id""")
def node_merge(spark, sf):
    old = table(spark, sf, "companies").select(F.col("company_id").alias("id"), F.col("company_name").alias("name"), F.col("sector").alias("kind"))
    new = table(spark, sf, "canonical_entities").groupBy(F.col("canonical_id").alias("id")).agg(F.min("canonical_name").alias("name")).withColumn("kind", F.lit(None).cast("string"))
    return G.merge_nodes(old, new)


_STARTS = "st AS (SELECT DISTINCT company_id AS id FROM companies)"


def _starts(spark, sf):
    return table(spark, sf, "companies").select(F.col("company_id").alias("id"))


# The query set of a search from rows whose ids are texts: those whose digest is divisible by 50; they are sought among all rows.
def _asked_sql(c: str) -> str:
    return f"('0x' || left(sha256({c}), 8))::BIGINT % 50 = 0"


def _asked(c: str):
    return F.conv(F.substring(F.sha2(F.col(c), 256), 1, 8), 16, 10).cast("bigint") % 50 == 0


@query(_WITH + ", " + _STARTS + " SELECT st.id AS start, e.dst AS n1, e.id AS e1 FROM st JOIN edges e ON e.src = st.id")
def paths_1(spark, sf):
    return G.paths(_graph(spark, sf)[1], _starts(spark, sf), 1)


@query(_WITH + ", " + _STARTS + " SELECT st.id AS start, e.dst AS n1, f.dst AS n2, e.id AS e1, f.id AS e2 FROM st JOIN edges e ON e.src = st.id JOIN edges f ON f.src = e.dst AND f.id <> e.id")
def paths_2(spark, sf):
    return G.paths(_graph(spark, sf)[1], _starts(spark, sf), 2)


@query(_WITH + " SELECT e.src AS start, e.dst AS n1, f.dst AS n2, g.dst AS n3, e.id AS e1, f.id AS e2, g.id AS e3 FROM edges e JOIN edges f ON f.src = e.dst JOIN edges g ON g.src = f.dst WHERE e.type = 'HOLDS_ROLE_AT' AND f.type = 'PUBLISHED' AND g.type = 'HAS_CHUNK' AND e.src IN (SELECT canonical_id FROM ents WHERE type = 'Person' AND " + _asked_sql("canonical_id") + ")")
def paths_3(spark, sf):
    c = table(spark, sf, "canonical_entities").where("deleted_at IS NULL AND type = 'Person'")
    s = c.where(_asked("canonical_id")).select(F.col("canonical_id").alias("id"))
    return G.paths(_graph(spark, sf)[1], s, 3, [["HOLDS_ROLE_AT"], ["PUBLISHED"], ["HAS_CHUNK"]])


@query("SELECT a.company_id AS a, b.company_id AS b, count(*) AS shared FROM companies a JOIN companies b ON a.sector = b.sector AND a.company_id < b.company_id GROUP BY 1, 2")
def shared_neighbour(spark, sf):
    return G.shared_neighbours(_graph(spark, sf)[1], "OPERATES_IN")


@query(_WITH + ", " + _STARTS + """, p AS (SELECT st.id AS start, e.dst AS n1, f.dst AS n2 FROM st JOIN edges e ON e.src = st.id JOIN edges f ON f.src = e.dst AND f.id <> e.id)
SELECT start, n2, round(greatest(0.1, least(1.0, 1.0 - 0.1 * 2 + (CASE WHEN contains(n1, regexp_extract(start, ':(.*)', 1)) THEN 0.1 ELSE 0.0 END) + (CASE WHEN contains(n1, '__2020__') THEN 0.1 ELSE 0.0 END)))::DOUBLE, 2) AS score FROM p""")
def path_score(spark, sf):
    p = G.paths(_graph(spark, sf)[1], _starts(spark, sf), 2)
    return p.select("start", "n2", K.path_relevance(F.lit(2), F.contains("n1", F.regexp_extract("start", ":(.*)", 1)), F.contains("n1", F.lit("__2020__"))).alias("score"))


# --- resolution -------------------------------------------------------------------------------------------------

_ALIAS_MAP = "SELECT source_entity_id AS id, min(lower(trim(canonical_entity_id))) AS canonical FROM aliases WHERE coalesce(trim(canonical_entity_id), '') <> '' GROUP BY 1"


@query(f"""WITH m AS ({_ALIAS_MAP}), e AS (SELECT DISTINCT id, type, source_chunk_id FROM input_entities WHERE source_chunk_id IS NOT NULL)
SELECT 'MENTIONED_IN' AS type, coalesce(canonical, e.id) AS src, source_chunk_id AS dst, count(*) AS statements FROM e LEFT JOIN m USING (id) GROUP BY 2, 3""")
def edge_remap(spark, sf):
    a = table(spark, sf, "aliases").where(F.coalesce(F.trim("canonical_entity_id"), F.lit("")) != "").select(F.col("source_entity_id").alias("id"), F.lower(F.trim("canonical_entity_id")).alias("canonical"))
    e = table(spark, sf, "input_entities").where("source_chunk_id IS NOT NULL").select("id", "type", "source_chunk_id").distinct()
    e = e.select(F.lit("MENTIONED_IN").alias("type"), F.col("id").alias("src"), F.col("source_chunk_id").alias("dst"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("double").alias("confidence"))
    return G.remap_edges(e, a).select("type", "src", "dst", "statements")


_NAMES = "SELECT key, type, company, name, list_distinct(list_filter(string_split(" + S.ascii_key("name") + ", '_'), lambda w: length(w) > 1)) AS ws FROM (SELECT min(id) AS key, type, coalesce(properties['company_id'], '') AS company, canonical_name AS name FROM input_entities WHERE type IN ('Person', 'Company') GROUP BY 2, 3, 4)"


def _mentions(spark, sf):
    e = table(spark, sf, "input_entities")
    return e.groupBy("type", F.coalesce(F.try_element_at("properties", F.lit("company_id")), F.lit("")).alias("company"), F.col("canonical_name").alias("name")).agg(F.min("id").alias("key")).where("name IS NOT NULL")


def mention_pairs(spark, sf):
    return R.similar_pairs(_mentions(spark, sf))


QUERIES["mention_pairs"] = mention_pairs


def pair_class(spark, sf):
    p = R.compared_pairs(_mentions(spark, sf), ["a", "b", "type", "similarity", "same_name"])
    return p.select("a", "b", "type", "similarity", R.pair_class(F.col("type"), F.col("similarity"), F.lit(1.0), F.col("same_name"), F.lit(0)).alias("match_class"))


QUERIES["pair_class"] = pair_class


@query("""WITH RECURSIVE e AS (SELECT DISTINCT left_record_key AS a, right_record_key AS b FROM resolution_decisions WHERE match_class IN ('EXACT_MATCH', 'HIGH_CONFIDENCE_MATCH') AND left_record_key <> right_record_key
  UNION SELECT right_record_key, left_record_key FROM resolution_decisions WHERE match_class IN ('EXACT_MATCH', 'HIGH_CONFIDENCE_MATCH') AND left_record_key <> right_record_key),
r AS (SELECT a AS id, a AS x FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.x) SELECT id, min(x) AS root FROM r GROUP BY 1""")
def components(spark, sf):
    d = table(spark, sf, "resolution_decisions").where("match_class IN ('EXACT_MATCH', 'HIGH_CONFIDENCE_MATCH')")
    return R.components(d, "left_record_key", "right_record_key")


@query(f"""SELECT lower(trim(canonical_entity_id)) AS cid, {S.one_blank('alias')} AS canonical_name FROM aliases WHERE coalesce(trim(canonical_entity_id), '') <> '' AND {S.one_blank('alias')} <> ''
QUALIFY row_number() OVER (PARTITION BY lower(trim(canonical_entity_id)) ORDER BY {S.words(S.one_blank('alias'))}, length({S.one_blank('alias')}), {S.lower_tr(S.one_blank('alias'))}, alias_id, {S.one_blank('alias')}) = 1""")
def representative(spark, sf):
    a = table(spark, sf, "aliases").where(F.coalesce(F.trim("canonical_entity_id"), F.lit("")) != "").select(F.lower(F.trim("canonical_entity_id")).alias("cid"), "alias", "alias_id", F.lit(0.0).alias("c"))
    return R.representative(a, "cid", "alias", "c", "alias_id")


@query("""WITH m AS (SELECT source_chunk_id AS g, canonical_name AS name, confidence, evidence_text FROM input_entities WHERE source_chunk_id IS NOT NULL)
SELECT m.g, count(*) AS mentions, 1::BIGINT AS chunks, round(avg(confidence), 3) AS average_confidence,
list_sort(list(DISTINCT name) FILTER (WHERE trim(name) <> '')) AS aliases, (list_sort(list(DISTINCT evidence_text) FILTER (WHERE trim(evidence_text) <> '')))[1:5] AS samples FROM m GROUP BY 1""")
def canonical_rows(spark, sf):
    m = table(spark, sf, "input_entities").where("source_chunk_id IS NOT NULL").select(F.col("source_chunk_id").alias("g"), F.col("canonical_name").alias("name"), "confidence", "evidence_text", "source_chunk_id")
    return R.canonical_rows(m, "g")


@query(f"""WITH b AS (SELECT DISTINCT alias_id, lower(entity_type) || ':' || {S.ascii_key('alias')} AS base FROM aliases), f AS (SELECT base, min(alias_id) AS f FROM b GROUP BY 1)
SELECT alias_id, base, CASE WHEN alias_id = f THEN base ELSE base || ':variant:' || {S.digest(['alias_id'], 12)} END AS canonical_id FROM b JOIN f USING (base)""")
def variant_ids(spark, sf):
    a = table(spark, sf, "aliases").select("alias_id", F.concat(F.lower("entity_type"), F.lit(":"), T.ascii_key("alias")).alias("base")).where("base IS NOT NULL").distinct()
    return R.variant_ids(a, "base", "alias_id")


@query("""SELECT entity_type, match_class, count(*) AS pairs, count(*) FILTER (WHERE merged) AS merged, count(*) FILTER (WHERE merged IS NULL) AS undecided FROM resolution_decisions GROUP BY 1, 2""")
def resolution_metrics(spark, sf):
    return table(spark, sf, "resolution_decisions").groupBy("entity_type", "match_class").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("merged").alias("merged"), F.count_if(F.col("merged").isNull()).alias("undecided"))


@query("SELECT type, count(*) AS rows, count(DISTINCT id) AS ids, round(avg(confidence), 6) AS mean_confidence FROM input_entities GROUP BY 1")
def extraction_metrics(spark, sf):
    return table(spark, sf, "input_entities").groupBy("type").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"""SELECT decision_id, round(0.8::DOUBLE * (CASE WHEN n > 0 THEN s / n::DOUBLE ELSE 0.0 END) + 0.2::DOUBLE * {S.jaccard('wa', 'wb')}, 6) AS context FROM (SELECT DISTINCT decision_id,
((left_entity_id IS NOT NULL AND right_entity_id IS NOT NULL)::INT + (left_record_key IS NOT NULL AND right_record_key IS NOT NULL)::INT) AS n, (coalesce(left_entity_id = right_entity_id, false)::INT + coalesce(left_record_key = right_record_key, false)::INT) AS s,
{S.blank_words('left_name')} AS wa, {S.blank_words('right_name')} AS wb FROM resolution_decisions)""")
def context_similarity(spark, sf):
    d = table(spark, sf, "resolution_decisions")
    c = R.context_similarity([(F.col("left_entity_id"), F.col("right_entity_id")), (F.col("left_record_key"), F.col("right_record_key"))], K.blank_words("left_name"), K.blank_words("right_name"))
    return d.select("decision_id", c.alias("context"), F.array_sort(K.blank_words("left_name")).alias("_a")).distinct().select("decision_id", "context")


# --- extraction: each person mention as a provider's answer, with the company as second entity and a role between them ---

_EXTRACT = f"""WITH m AS (SELECT DISTINCT id, canonical_name AS name, properties['company_id'] AS cid, source_chunk_id AS chunk_id, regexp_replace(source_file, '^.*[:/]', '') AS f, page_number AS p, evidence_text AS ev, confidence AS c FROM input_entities WHERE type = 'Person'),
c AS (SELECT chunk_id, max(text) AS text, max(source_file) AS f, max(page_number) AS p FROM chunks GROUP BY 1),
j AS (SELECT m.*, c.text, (coalesce(trim(name), '') = '' OR coalesce(trim(m.chunk_id), '') = '' OR coalesce(trim(m.f), '') = '' OR coalesce(trim(ev), '') = '' OR NOT coalesce(m.p >= 1, false) OR NOT coalesce(c BETWEEN 0 AND 1, false)) AS shape,
  NOT (m.f IS NOT DISTINCT FROM c.f AND m.p IS NOT DISTINCT FROM c.p) AS other, NOT coalesce(contains(c.text, ev), false) AS far FROM m LEFT JOIN c USING (chunk_id)),
e AS (SELECT *, CASE WHEN shape THEN 'ENTITY_MODEL_INVALID' WHEN other THEN 'PROVENANCE_MISMATCH' WHEN far THEN 'EVIDENCE_NOT_IN_CHUNK' WHEN NOT coalesce(regexp_matches(cid, '^company:[A-Z]{{4,6}}$'), false) THEN 'SCHEMA_VALIDATION_FAILED' END AS person,
  CASE WHEN shape THEN 'ENTITY_MODEL_INVALID' WHEN other THEN 'PROVENANCE_MISMATCH' WHEN far THEN 'EVIDENCE_NOT_IN_CHUNK' END AS company,
  CASE WHEN shape THEN 'RELATION_MODEL_INVALID' WHEN other THEN 'PROVENANCE_MISMATCH' WHEN far THEN 'EVIDENCE_NOT_IN_CHUNK' WHEN NOT coalesce(regexp_matches(cid, '^company:[A-Z]{{4,6}}$'), false) THEN 'ENTITY_REFERENCE_NOT_FOUND' END AS role FROM j)
SELECT record_kind, coalesce(reason_code, 'accepted') AS outcome, count(*) AS rows FROM (SELECT 'entity' AS record_kind, person AS reason_code FROM e UNION ALL SELECT 'entity', company FROM e UNION ALL SELECT 'relation', role FROM e) GROUP BY 1, 2"""


def _responses(spark, sf):
    e = table(spark, sf, "input_entities").where("type = 'Person'")
    e = e.select("id", F.col("canonical_name").alias("name"), F.try_element_at("properties", F.lit("company_id")).alias("cid"), F.col("source_chunk_id").alias("chunk_id"), F.regexp_replace("source_file", "^.*[:/]", "").alias("f"), F.col("page_number").alias("p"), F.col("evidence_text").alias("ev"), F.col("confidence").alias("c")).distinct()
    proof = [F.col("chunk_id").alias("source_chunk_id"), F.col("f").alias("source_file"), F.col("p").alias("page_number"), F.col("ev").alias("evidence_text"), F.col("c").alias("confidence")]
    one = lambda ref, kind: F.struct(F.lit(ref).alias("ref"), F.lit(kind).alias("type"), F.col("name").alias("canonical_name"), F.create_map(F.lit("name"), F.coalesce("name", F.lit("")), F.lit("company_id"), F.coalesce("cid", F.lit(""))).alias("properties"), *proof)
    role = F.struct(F.lit("HOLDS_ROLE_AT").alias("type"), F.lit("e1").alias("source_ref"), F.lit("e2").alias("target_ref"), *proof)
    answer = F.to_json(F.struct(F.array(one("e1", "Person"), one("e2", "Company")).alias("entities"), F.array(role).alias("relations")))
    return e.select(F.xxhash64(*e.columns).alias("response_id"), "chunk_id", answer.alias("response"))


@query(_EXTRACT)
def extraction(spark, sf):
    from reportloom.operators import extract

    good, rel, bad = extract.accept(_responses(spark, sf), table(spark, sf, "chunks"))
    rows = good.select(F.lit("entity").alias("record_kind"), F.lit("accepted").alias("outcome")).unionByName(rel.select(F.lit("relation").alias("record_kind"), F.lit("accepted").alias("outcome"))).unionByName(bad.select("record_kind", F.col("reason_code").alias("outcome")))
    return rows.groupBy("record_kind", "outcome").agg(F.count(F.lit(1)).alias("rows"))


# --- workflow ---------------------------------------------------------------------------------------------------

_STEPS = ", ".join(f"('{k}', {s}, '{t}', {n}::INT[])" for k, steps in W.PLANS.items() for s, t, n in steps)
_PLAN = f"WITH RECURSIVE st(kind, step, tool, needs) AS (VALUES {_STEPS}), q AS (SELECT id, {_KIND} AS kind FROM golden_test), p AS (SELECT id, q.kind, step, tool, needs FROM q JOIN st USING (kind))"


@query(_PLAN + " SELECT id, kind, step, tool, needs FROM p")
def plan_steps(spark, sf):
    return W.plan_steps(table(spark, sf, "golden_test"), "id", "question")


@query(_PLAN + """, l AS (SELECT kind, step, 1 AS level FROM st WHERE len(needs) = 0 UNION ALL SELECT st.kind, st.step, l.level + 1 FROM st JOIN l ON l.kind = st.kind AND list_contains(st.needs, l.step))
SELECT p.id, p.step, max(level) AS level FROM p JOIN l USING (kind, step) GROUP BY 1, 2""")
def task_levels(spark, sf):
    return W.task_levels(plan_steps(spark, sf), "id").select("id", "step", "level")


@query(_PLAN + """, d AS (SELECT *, step = 1 AS done FROM p) SELECT id, step, tool FROM d WHERE NOT done AND len(list_filter(needs, lambda n: n <> 1)) = 0""")
def ready_levels(spark, sf):
    return W.ready_tasks(plan_steps(spark, sf).withColumn("done", F.col("step") == 1), "id").select("id", "step", "tool")


@query("""SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w <= 3 AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)""".replace("59999999", "3599999999"))
def rate_window(spark, sf):
    return W.rate_windows(table(spark, sf, "events"), "user_id", "ts", 3, 3600).select("event_id", "in_window", "allowed")


@query("SELECT user_id, event_type, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 8) AS mean, count(*) FILTER (WHERE value > 20) AS failures, round(avg(coalesce(value > 20, false)::INT), 6) AS failure_rate FROM events GROUP BY 1, 2")
def trace_metrics(spark, sf):
    return W.trace_metrics(table(spark, sf, "events"), "user_id", "event_type", "value", F.col("value") > 20)


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS spent, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) >= 100 AS exhausted FROM events")
def budget(spark, sf):
    return W.budget_use(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 100).select("event_id", "spent", "exhausted")


@query("""SELECT company_id, sha256('{"name":"' || coalesce(short_name, '') || '","sector":"' || coalesce(sector, '') || '","ticker":"' || coalesce(ticker, '') || '"}') AS config_hash FROM companies""")
def manifest_hash(spark, sf):
    m = F.create_map(F.lit("ticker"), F.col("ticker"), F.lit("name"), F.col("short_name"), F.lit("sector"), F.col("sector"))
    return table(spark, sf, "companies").select("company_id", W.config_hash(m).alias("config_hash"))


@query(f"SELECT id, left(sha256(concat_ws('|', company, {S.lower_tr(S.one_blank('question'))})), 16) AS run_id FROM golden_test")
def run_ids(spark, sf):
    return table(spark, sf, "golden_test").select("id", W.run_id(F.col("company"), F.col("question")).alias("run_id"))


# A mention of a metric as a claim: is it in the chunk that it names, of its company and year?
_CLAIMS = """WITH k AS (SELECT chunk_id, max(text) AS text, max(ticker) AS ticker, max(year) AS year FROM chunks GROUP BY 1),
c AS (SELECT DISTINCT id, source_chunk_id, properties['value'] AS v, regexp_extract(id, ':([A-Z]+):', 1) AS t, TRY_CAST(regexp_extract(properties['date_id'], '(20[0-9]{2})', 1) AS INT) AS y FROM input_entities WHERE type = 'FinancialMetric')"""


@query(_CLAIMS + """ SELECT id, CASE WHEN k.chunk_id IS NULL THEN 'unsupported' WHEN NOT coalesce(k.ticker = t, true) THEN 'wrong_company' WHEN NOT coalesce(k.year = y, true) THEN 'wrong_year' WHEN NOT coalesce(contains(text, v), true) THEN 'value_missing' ELSE 'supported' END AS status FROM c LEFT JOIN k ON k.chunk_id = source_chunk_id""")
def claim_status(spark, sf):
    from reportloom.operators.skew import salted_lookup

    k = table(spark, sf, "chunks").groupBy(F.col("chunk_id").alias("source_chunk_id")).agg(F.max("text").alias("text"), F.max("ticker").alias("kt"), F.max("year").alias("ky")).withColumn("known", F.lit(True))
    p = lambda n: F.try_element_at("properties", F.lit(n))
    c = table(spark, sf, "input_entities").where("type = 'FinancialMetric'").select("id", "source_chunk_id", p("value").alias("v"), F.regexp_extract("id", ":([A-Z]+):", 1).alias("t"), F.regexp_extract(p("date_id"), "(20[0-9]{2})", 1).try_cast("int").alias("y")).distinct()
    j = salted_lookup(c, k, "source_chunk_id")
    return j.select("id", W.claim_status(F.col("known"), F.col("kt") == F.col("t"), F.col("ky") == F.col("y"), F.contains("text", F.col("v")), F.lit(False)).alias("status"))


@query("""SELECT id, string_agg(n || '. ' || c, chr(10) ORDER BY n) AS sources FROM (SELECT id, unnest(range(1, len(source_chunk_ids) + 1)) AS n, unnest(source_chunk_ids) AS c FROM golden_test) WHERE c IS NOT NULL GROUP BY 1""")
def report_sources(spark, sf):
    g = table(spark, sf, "golden_test").select("id", F.posexplode("source_chunk_ids").alias("n", "c")).where("c IS NOT NULL")
    line = F.concat((F.col("n") + 1).cast("string"), F.lit(". "), F.col("c"))
    return g.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda s: s["l"]), "\n").alias("sources"))  # a question's few sources


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY 1, 2")
def event_windows(spark, sf):
    return V.windowed_counts(table(spark, sf, "events"))


@query("""WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def events_stream(spark, sf):
    return V.run_available(spark, V.windowed_counts(V.read_stream(spark, f"{sf}/event[s].parquet")), "events")


@query(_WITH + """, hops AS (SELECT c.ticker, g.dst AS chunk_id FROM companies c JOIN edges f ON f.src = c.company_id AND f.type = 'PUBLISHED' JOIN edges g ON g.src = f.dst AND g.type = 'HAS_CHUNK'),
best AS (SELECT ticker, chunk_id, row_number() OVER (PARTITION BY ticker ORDER BY chunk_id) AS rank FROM hops QUALIFY rank <= 10),
lex AS (SELECT ticker, chunk_id, row_number() OVER (PARTITION BY ticker ORDER BY n DESC, chunk_id) AS rank FROM (SELECT ticker, chunk_id, max(length(text)) AS n FROM chunks WHERE deleted_at IS NULL AND text IS NOT NULL GROUP BY 1, 2) QUALIFY rank <= 10),
u AS (SELECT ticker, chunk_id, rank FROM best UNION ALL SELECT ticker, chunk_id, rank FROM lex)
SELECT ticker AS query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS fusion_score, min(rank)::INT AS best_rank, count(*) AS lists FROM u WHERE ticker IS NOT NULL GROUP BY 1, 2""")
def hybrid_flagship(spark, sf):
    """Chunks of each company found by the graph (company, report, chunk) and by length of text, fused by rank."""
    from pyspark.sql import Window

    n, e = _graph(spark, sf)
    starts = table(spark, sf, "companies").select(F.col("company_id").alias("id"))
    p = G.paths(e, starts, 2, [["PUBLISHED"], ["HAS_CHUNK"]])
    best = p.select(F.regexp_extract("start", ":(.*)", 1).alias("query_id"), F.col("n2").alias("chunk_id")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))).where("rank <= 10")
    c = table(spark, sf, "chunks").where("deleted_at IS NULL AND text IS NOT NULL AND ticker IS NOT NULL").groupBy(F.col("ticker").alias("query_id"), "chunk_id").agg(F.max(F.length("text")).alias("n"))
    lex = c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "chunk_id"))).where("rank <= 10").drop("n")
    return K.rrf([best, lex], "chunk_id")
