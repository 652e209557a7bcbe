"""Queries of lineage, inventories, evidence bookkeeping and grounding, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.operators import lineage as L
from reportloom.plans import snippets as S
from reportloom.plans.graphs import _WITH, _graph
from reportloom.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH s AS (SELECT chunk_id, min(document_id) AS document_id FROM chunks GROUP BY 1 ORDER BY sha256('lineage|' || chunk_id) LIMIT 15)
SELECT s.chunk_id, document_id, (SELECT count(DISTINCT id) FROM input_entities e WHERE {S.strip('e.source_chunk_id')} = s.chunk_id) AS mentions,
(SELECT count(DISTINCT canonical_id) FROM (SELECT canonical_id, unnest(source_chunk_ids) AS x FROM canonical_entities) WHERE {S.strip('x')} = s.chunk_id) AS canonical_rows,
(SELECT count(DISTINCT id) FROM (SELECT id, unnest(source_chunk_ids) AS x FROM golden_test) WHERE {S.strip('x')} = s.chunk_id) AS questions FROM s""")
def data_lineage(spark, sf):
    t = lambda n: table(spark, sf, n)
    return L.chunk_lineage(t("chunks"), t("input_entities"), t("canonical_entities"), t("golden_test"))


@query("""SELECT coalesce(a.ticker, b.ticker) AS ticker, left_rows, right_rows, left_rows IS NOT DISTINCT FROM right_rows AS equal FROM (SELECT ticker, count(*) AS left_rows FROM chunks GROUP BY 1) a FULL JOIN (SELECT ticker, count(*) AS right_rows FROM documents GROUP BY 1) b ON a.ticker IS NOT DISTINCT FROM b.ticker""")
def inventory_compare(spark, sf):
    return L.compare_inventories(table(spark, sf, "chunks"), table(spark, sf, "documents"), "ticker")


@query(_WITH + " SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, (SELECT count(DISTINCT label) FROM nodes) AS labels, count(DISTINCT type) AS types, count(*) FILTER (WHERE page IS NOT NULL OR confidence IS NOT NULL) AS with_provenance FROM edges")
def graph_inventory(spark, sf):
    return L.inventory(*_graph(spark, sf))


@query("""SELECT entity_type, item, max(name_similarity) AS name_similarity, count(*) AS copies FROM (SELECT entity_type, coalesce('path:' || left_canonical_id, 'chunk:' || left_entity_id) AS item, name_similarity FROM resolution_decisions) WHERE item IS NOT NULL GROUP BY 1, 2""")
def evidence_dedupe(spark, sf):
    return L.best_evidence(table(spark, sf, "resolution_decisions"), "entity_type", "left_entity_id", "left_canonical_id", "name_similarity")


@query("""SELECT id, c AS source, row_number() OVER (PARTITION BY id ORDER BY p, c)::INT AS number FROM (SELECT id, c, min(p) AS p FROM (SELECT id, unnest(source_chunk_ids) AS c, unnest(range(0, len(source_chunk_ids))) AS p FROM golden_test) WHERE c IS NOT NULL GROUP BY 1, 2)""")
def citation_numbers(spark, sf):
    g = table(spark, sf, "golden_test").select("id", F.posexplode("source_chunk_ids").alias("p", "source"))
    return L.number_citations(g, "id", "p", "source")


@query("""SELECT left_entity_id, right_entity_id AS candidate, name_similarity FROM resolution_decisions WHERE match_class = 'REVIEW_REQUIRED' AND left_entity_id IS NOT NULL AND right_entity_id IS NOT NULL AND name_similarity IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY left_entity_id ORDER BY name_similarity DESC, right_entity_id) = 1""")
def review_candidates(spark, sf):
    return L.best_candidate(table(spark, sf, "resolution_decisions"), "left_entity_id", "right_entity_id", "name_similarity", F.col("match_class") == "REVIEW_REQUIRED")


@query("""SELECT id, CASE WHEN coalesce(answerable, false) THEN coalesce(trim(expected_answer), '') <> '' AND coalesce(trim(source_file), '') <> '' AND coalesce(len(source_pages), 0) > 0 ELSE NOT coalesce(len(source_chunk_ids), 0) > 0 END AS grounded FROM golden_test""")
def grounding(spark, sf):
    g = table(spark, sf, "golden_test")
    return g.select("id", L.grounded(g).alias("grounded"))


@query(f"""WITH t AS (SELECT golden_id AS id, string_agg(text, ' ' ORDER BY item_id) AS text FROM eval_items GROUP BY 1), g AS (SELECT id, list_distinct(list_filter(coalesce(expected_entities, []), lambda x: coalesce(trim(x), '') <> '')) AS e, {S.fold("coalesce(text, '')")} AS t FROM golden_test LEFT JOIN t USING (id))
SELECT id, CASE WHEN len(e) > 0 THEN round(len(list_filter(e, lambda x: contains(t, {S.fold('x')}))) / len(e)::DOUBLE, 6) ELSE 1.0 END AS recall FROM g""")
def entity_recall(spark, sf):
    t = table(spark, sf, "eval_items").groupBy(F.col("golden_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda s: s["text"]), " ").alias("text"))  # a question's few items
    return table(spark, sf, "golden_test").join(t, "id", "left").select("id", L.name_recall(F.col("expected_entities"), F.col("text")).alias("recall"))


@query("SELECT id FROM golden_test WHERE id NOT IN (SELECT golden_id FROM eval_items WHERE golden_id IS NOT NULL AND item_kind = 'question_answer')")
def resume_items(spark, sf):
    # done are the questions that an item of question and answer was made of
    i = table(spark, sf, "eval_items").where("item_kind = 'question_answer'").select(F.col("golden_id").alias("id"))
    return table(spark, sf, "golden_test").select("id").join(i, "id", "left_anti")


@query(f"SELECT DISTINCT id, x AS chunk_id FROM (SELECT id, {S.strip('x')} AS x FROM (SELECT id, unnest(source_chunk_ids) AS x FROM golden_test)) WHERE x IN (SELECT chunk_id FROM chunks)")
def valid_citations(spark, sf):
    g = table(spark, sf, "golden_test").select("id", F.explode("source_chunk_ids").alias("x")).select("id", T.strip("x").alias("chunk_id")).distinct()
    return g.join(table(spark, sf, "chunks").select("chunk_id"), "chunk_id", "left_semi").select("id", "chunk_id")


@query("SELECT company_id, CASE WHEN ticker < 'F' THEN 'valid' WHEN ticker < 'N' THEN 'missing' ELSE 'changed' END AS state FROM companies")
def prompt_registry(spark, sf):
    c = table(spark, sf, "companies")
    stored = F.when(F.col("ticker") < "F", F.sha2("company_name", 256)).when(F.col("ticker") >= "N", F.sha2(F.lit("another"), 256))
    return c.select("company_id", L.registry_state(F.col("company_name"), stored).alias("state"))


@query("SELECT sha256(string_agg(company_id || ':' || sha256(company_name), '|' ORDER BY company_id)) AS bundle FROM companies")
def bundle_fingerprint(spark, sf):
    c = table(spark, sf, "companies").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("company_id", F.sha2("company_name", 256).alias("h")))), lambda s: F.concat(s["company_id"], F.lit(":"), s["h"])), "|").alias("x"))  # a fixed registry
    return c.select(F.sha2("x", 256).alias("bundle"))


@query("SELECT chunk_id, page_number, token_count FROM (SELECT DISTINCT chunk_id, page_number, token_count FROM chunks) WHERE chunk_id IN (SELECT min(chunk_id) FROM chunks UNION SELECT max(chunk_id) FROM chunks)")
def chunk_by_id(spark, sf):
    c = table(spark, sf, "chunks").select("chunk_id", "page_number", "token_count")
    ids = c.agg(F.min("chunk_id").alias("a"), F.max("chunk_id").alias("b")).select(F.explode(F.array("a", "b")).alias("chunk_id"))
    return c.join(F.broadcast(ids), "chunk_id", "left_semi").distinct()


@query("""SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN n > 1 THEN 'duplicate' ELSE 'kept' END AS state FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS n FROM documents)""")
def report_validation(spark, sf):
    from reportloom.operators.skew import salted_lookup

    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), F.coalesce(F.trim("text") == "", F.lit(True)).alias("blank"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    return salted_lookup(d, first, "h", "inner").select("doc_id", F.when(F.col("blank"), "empty").when(F.col("doc_id") != F.col("first"), "duplicate").otherwise("kept").alias("state"))
