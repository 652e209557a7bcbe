"""Queries of documents and the records made from them, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.operators import documents as D
from reportloom.operators import extract
from reportloom.operators import graph as G
from reportloom.operators import resolve as R
from reportloom.plans import graphs, resolution, texts
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


_T, _N = S.lower_tr("coalesce(text, '')"), S.lower_tr("coalesce(name, '')")
_EITHER = lambda w: f"({S.has(_N, w[0])} OR {S.has(_T, w[1])})"
_COUNT = lambda words: f"len(list_filter({S.answer_words('text')}, lambda x: list_contains({words}, x)))"


@query(f"""WITH d AS (SELECT doc_id, text, concat_ws('__', ticker, CAST(year AS VARCHAR), report_type) AS name FROM documents),
y AS (SELECT doc_id, max_by(y, {{'n': n, 'y': y}}) AS y FROM (SELECT doc_id, y::INT AS y, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\\b(202[0-6])\\b', 1)) AS y FROM d) GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, CASE WHEN {_COUNT(D.ENGLISH)} > {_COUNT(D.TURKISH)} + 2 THEN 'en' ELSE 'tr' END AS language,
CASE WHEN {_EITHER(D.PRESENTATION)} THEN 'investor_presentation' WHEN {_EITHER(D.ANNUAL)} THEN CASE WHEN {S.has(_N, ['sürdürülebilirlik raporu', 'sustainability report'])} AND NOT contains({_N}, 'faaliyet') THEN 'sustainability_report' ELSE 'annual_report' END
  WHEN {_EITHER(D.SUSTAINABILITY)} THEN 'sustainability_report' ELSE 'annual_report' END AS kind,
coalesce(CASE {' '.join(f"WHEN contains(name, '{y}') THEN {y}" for y in D.NAME_YEARS)} END, y, {D.DEFAULT_YEAR}) AS year FROM d LEFT JOIN y USING (doc_id)""")
def document_facts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.concat_ws("__", "ticker", F.col("year").cast("string"), "report_type").alias("name"))
    return d.select("doc_id", D.report_language(F.col("text")).alias("language"), D.report_kind(F.col("name"), F.col("text")).alias("kind"), D.report_year(F.col("name"), F.col("text")).alias("year"))


@query(texts._BLOCKS.replace("FROM (SELECT DISTINCT chunk_id, text FROM chunks)", "FROM (SELECT DISTINCT doc_id AS chunk_id, text FROM documents)") + f"""SELECT p.chunk_id AS doc_id, d.ticker, coalesce(company_name, d.ticker) AS company, d.year, chunk_index, left(sha256(p.chunk_id || ':' || chunk_index || ':' || trim(p.text)), 16) AS chunk_id, {S.tokens('p.text')} AS token_count
FROM packed p JOIN documents d ON d.doc_id = p.chunk_id LEFT JOIN (SELECT upper(ticker) AS t, min(company_name) AS company_name FROM companies GROUP BY 1) ON t = upper(d.ticker)""")
def chunk_records(spark, sf):
    r = D.chunk_records(table(spark, sf, "documents"), table(spark, sf, "companies"), "doc_id", "text", "ticker", ["year"])
    return r.select("doc_id", "ticker", "company", "year", "chunk_index", "chunk_id", "token_count")


@query(f"SELECT DISTINCT {', '.join('c.' + k for k in D.PAYLOAD)}, trim(coalesce(text, '')) <> '' AS embeddable, point_id FROM chunks c JOIN ({texts.SQL['uuid5_id']}) USING (chunk_id)")
def payload_rows(spark, sf):
    return D.payload_rows(table(spark, sf, "chunks"))


@query(f"WITH {resolution._CONTEXTS} SELECT id, type, norm, identity, company_id, year, report_id, codes, list_sort(tokens) AS tokens FROM ctx")
def entity_contexts(spark, sf):
    from reportloom.operators.contexts import entity_contexts

    c = entity_contexts(table(spark, sf, "input_entities"), table(spark, sf, "companies"))
    return c.select("id", "type", "norm", "identity", "company_id", "year", "report_id", "codes", F.array_sort("tokens").alias("tokens"))


@query(graphs._WITH + " SELECT e.src AS start, e.dst AS n1, f.dst AS n2, e.id AS e1, f.id AS e2 FROM edges e JOIN edges f ON f.src = e.dst AND f.id <> e.id WHERE e.type = 'PUBLISHED' AND f.type = 'HAS_CHUNK' AND contains(e.dst, '__2020__') AND e.src IN (SELECT company_id FROM companies)")
def paths_of_year(spark, sf):
    # the year is asked of the first edge's target, before the second hop
    e = graphs._graph(spark, sf)[1].where("type IN ('PUBLISHED', 'HAS_CHUNK')").where((F.col("type") != "PUBLISHED") | F.contains("dst", F.lit("__2020__")))
    return G.paths(e, graphs._starts(spark, sf), 2, [["PUBLISHED"], ["HAS_CHUNK"]])


@query("""SELECT entity_type, decision_id, row_number() OVER (PARTITION BY entity_type ORDER BY coalesce(s, -1e300) DESC, coalesce(l, ''), decision_id) AS place FROM (SELECT entity_type, decision_id, max(name_similarity) AS s, min(left_entity_id) AS l FROM resolution_decisions GROUP BY 1, 2)""")
def evidence_order(spark, sf):
    d = table(spark, sf, "resolution_decisions").groupBy("entity_type", "decision_id").agg(F.max("name_similarity").alias("s"), F.min("left_entity_id").alias("l"))
    return D.sorted_evidence(d, "entity_type", "s", "l", "decision_id").select("entity_type", "decision_id", "place")


_KEY = ["id", "type", "canonical_name", "source_chunk_id", "page_number", "evidence_text"]


@query(f"SELECT DISTINCT 'record:' || {S.digest(_KEY)} AS record_key, {', '.join(_KEY)} FROM input_entities")
def mention_rows(spark, sf):
    e = table(spark, sf, "input_entities").select(*_KEY).distinct()
    return e.select(R.record_key([F.col(c) for c in _KEY]).alias("record_key"), *_KEY)


@query("""WITH r AS (SELECT ticker, year, document_id, report_type, CASE WHEN bool_or(contains(source_file, '__tr__')) THEN 'tr' ELSE 'en' END AS language, max(page_number) AS pages FROM chunks GROUP BY 1, 2, 3, 4)
SELECT ticker, year, document_id FROM r WHERE report_type IN ('annual_report', 'activity_report') AND year BETWEEN 2016 AND 2023 AND pages >= 3 QUALIFY row_number() OVER (PARTITION BY ticker, year ORDER BY language <> 'tr', pages DESC, document_id) = 1""")
def baseline_reports(spark, sf):
    c = table(spark, sf, "chunks").groupBy("ticker", "year", "document_id", "report_type").agg(F.when(F.max(F.contains("source_file", F.lit("__tr__"))), "tr").otherwise("en").alias("language"), F.max("page_number").alias("pages"))
    return D.baseline_reports(c, ["ticker", "year"], ["annual_report", "activity_report"], (2016, 2023), 3)


@query("SELECT id, row_number() OVER (ORDER BY sha256('seed-7' || '|' || id), id) AS place, CASE WHEN ('0x' || left(sha256(id || '|' || 'seed-7'), 8))::BIGINT % 2 = 0 THEN 'A' ELSE 'B' END AS label FROM golden_test")
def blind_package(spark, sf):
    return D.blind_package(table(spark, sf, "golden_test"), "id", "seed-7")


@query(graphs._WITH + """ SELECT 'label' AS what, label AS name, count(*) AS count FROM nodes GROUP BY 2 UNION ALL SELECT 'type', type, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges
UNION ALL SELECT 'total', 'orphans', count(*) FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges) UNION ALL SELECT 'total', 'with_provenance', count(*) FROM edges WHERE page IS NOT NULL OR confidence IS NOT NULL""")
def graph_totals(spark, sf):
    return D.graph_totals(*graphs._graph(spark, sf))


@query("""WITH c AS (SELECT DISTINCT chunk_id, sha256(coalesce(text, '') || '|' || 'v1') AS fingerprint, year FROM chunks) SELECT chunk_id, fingerprint FROM c WHERE fingerprint NOT IN (SELECT fingerprint FROM c WHERE year < 2018)""")
def extraction_resume(spark, sf):
    c = table(spark, sf, "chunks").select("chunk_id", "text", "year").distinct()
    cache = c.where("year < 2018").select(extract.fingerprint(F.col("text"), "v1").alias("fingerprint"))
    return extract.uncached(c, cache, "text", "v1").select("chunk_id", "fingerprint").distinct()
