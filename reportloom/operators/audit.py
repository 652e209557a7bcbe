"""Audit of a graph with provenance, issue by issue; its repair, its review queue and its final rates.

nodes: id, label, name, chunk, file, evidence, page, year, confidence. statements: type, src, dst, chunk, file, page, confidence; repeated
statements of one edge are duplicates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.operators.graph import edge_id
from reportloom.operators.ontology import edge_rules
from reportloom.operators.skew import salted_lookup
from reportloom.session import Stash

# What stands for a missing chunk or file, and what repair puts there.
PLACEHOLDERS = ["", "chunk_unknown", "source_unknown.pdf", "none", "null"]
NO_CHUNK, NO_FILE = "chunk_unknown", "source_unknown.pdf"
LOW_CONFIDENCE, FIRST_YEAR, LAST_YEAR = 0.5, 1900, 2030
# Category, severity, whether repair settles it.
CATEGORIES = [
    ("dangling_relation", "critical", True), ("duplicate_relation", "warning", True), ("schema_violation", "critical", False), ("orphan_node", "warning", False),
    ("missing_grounding", "warning", True), ("invalid_page", "warning", True), ("invalid_year", "warning", False), ("low_confidence", "warning", True), ("conflicting_data", "warning", False),
]


def mention_graph(entities: DataFrame, chunks: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and statements of companies, chunks and mentions with their provenance. Rows of one id are one node (least values)."""
    p = lambda k: F.try_element_at("properties", F.lit(k))
    chunk = lambda c: F.concat(F.lit("chunk:"), F.lower(F.trim(c)))
    e = entities.select("id", F.col("type").alias("label"), F.col("canonical_name").alias("name"), F.col("source_chunk_id").alias("chunk"), F.col("source_file").alias("file"), F.col("evidence_text").alias("evidence"), F.col("page_number").alias("page"), F.regexp_extract(p("date_id"), r"(\d{4})", 1).try_cast("int").alias("year"), "confidence", p("company_id").alias("company"))
    none = lambda kind: F.lit(None).cast(kind)
    c = chunks.where("chunk_id IS NOT NULL").select(chunk("chunk_id").alias("id"), F.lit("Chunk").alias("label"), F.lower(F.trim("chunk_id")).alias("name"), F.col("chunk_id").alias("chunk"), F.col("source_file").alias("file"), F.col("document_id").alias("evidence"), F.col("page_number").alias("page"), "year", none("double").alias("confidence"))
    o = companies.select(F.col("company_id").alias("id"), F.lit("Company").alias("label"), F.col("company_name").alias("name"), *[none(k).alias(n) for n, k in (("chunk", "string"), ("file", "string"), ("evidence", "string"), ("page", "int"), ("year", "int"), ("confidence", "double"))])
    n = e.drop("company").unionByName(c).unionByName(o).where("id IS NOT NULL").groupBy("id").agg(*[F.min(x).alias(x) for x in ("label", "name", "chunk", "file", "evidence", "page", "year", "confidence")])
    say = lambda df, kind, s, d: df.select(F.lit(kind).alias("type"), s.alias("src"), d.alias("dst"), "chunk", "file", "page", "confidence")
    s = [
        say(e, "EVIDENCED_BY", F.col("id"), chunk("chunk")), say(e.where("label = 'Product'"), "OFFERS", F.col("company"), F.col("id")),
        say(e.where("label = 'FinancialMetric'"), "REPORTED_METRIC", F.col("company"), F.col("id")), say(e.where("label = 'Person'"), "HOLDS_ROLE_AT", F.col("id"), F.col("company")),
    ]
    return n, reduce(DataFrame.unionByName, s).where("src IS NOT NULL AND dst IS NOT NULL")


def _placeholder(c: str) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).isin(PLACEHOLDERS)


def audit_rows(nodes: DataFrame, statements: DataFrame) -> DataFrame:
    """(category, severity, repairable, item, item_id, item_type): every issue of every node and edge; item is node or edge.

    An edge is judged once, with its best confidence and least page, chunk and file; its further statements are one duplicate_relation.
    A missing confidence counts as 1. Edges of a known type whose ends exist but have labels that no rule allows are schema violations.
    Nodes and edges are written once to the shared folder and each read once more; ends are fetched with hot ends split by salts.
    The nodes' and edges' tables are dropped when the result, a table that belongs to the caller, is written.
    """
    stash = Stash(nodes.sparkSession, "audit")
    n = stash.put(nodes)
    one = statements.groupBy("type", "src", "dst").agg(F.min("chunk").alias("chunk"), F.min("file").alias("file"), F.min("page").alias("page"), F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"), F.count(F.lit(1)).alias("statements"))
    e, seen = stash.put_counted(one, n=F.count(F.lit(1)))
    label = lambda c: n.select(F.col("id").alias(c), F.coalesce("label", F.lit("")).alias(f"_{c}"))
    e = salted_lookup(salted_lookup(e, label("src"), "src", rows=seen["n"]), label("dst"), "dst", rows=seen["n"])
    rules = edge_rules()
    fits = reduce(Column.__or__, [(F.col("type") == k) & (F.col("_src") == s) & (F.col("_dst") == d) for k, s, d in rules])
    known = F.col("type").isin(sorted({k for k, _, _ in rules}))
    low = F.col("confidence") < LOW_CONFIDENCE
    say = lambda pairs: F.explode(F.filter(F.array(*[F.when(c, F.lit(x)) for x, c in pairs]), lambda x: x.isNotNull()))
    lost = F.col("_src").isNull() | F.col("_dst").isNull()
    edge_issues = e.select(
        say([("dangling_relation", lost), ("duplicate_relation", F.col("statements") > 1), ("schema_violation", ~lost & known & ~fits), ("missing_grounding", _placeholder("chunk") | _placeholder("file")), ("invalid_page", F.col("page") < 1), ("low_confidence", low)]).alias("category"),
        F.lit("edge").alias("item"), edge_id(F.col("type"), F.col("src"), F.col("dst")).alias("item_id"), F.col("type").alias("item_type"),
    )
    year = (F.col("year") < FIRST_YEAR) | (F.col("year") > LAST_YEAR)
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("_at", F.lit(True))
    node_issues = n.join(ends, "id", "left").select(
        say([("orphan_node", F.col("_at").isNull()), ("missing_grounding", _placeholder("chunk") | _placeholder("file") | (F.trim(F.coalesce("evidence", F.lit(""))) == "")), ("invalid_page", F.col("page") < 1), ("invalid_year", year), ("low_confidence", low)]).alias("category"),
        F.lit("node").alias("item"), F.col("id").alias("item_id"), F.col("label").alias("item_type"),
    )
    ticker = F.upper(F.regexp_extract("id", "^company:([A-Za-z0-9._-]+)", 1))
    names = n.where("label = 'Company' AND trim(name) <> ''").groupBy(ticker.alias("t")).agg(F.count_distinct("name").alias("k")).where("t <> '' AND k > 1")
    conflicts = names.select(F.lit("conflicting_data").alias("category"), F.lit("node").alias("item"), F.concat(F.lit("company:"), "t").alias("item_id"), F.lit("Company").alias("item_type"))
    kinds = F.broadcast(nodes.sparkSession.createDataFrame(CATEGORIES, "category string, severity string, repairable boolean"))
    return stash.finish(edge_issues.unionByName(node_issues).unionByName(conflicts).join(kinds, "category").select("category", "severity", "repairable", "item", "item_id", "item_type"))


def audit_counts(issues: DataFrame) -> DataFrame:
    """(category, severity, repairable, item, item_type, issues)."""
    return issues.groupBy("category", "severity", "repairable", "item", "item_type").agg(F.count(F.lit(1)).alias("issues"))


def review_queue(issues: DataFrame) -> DataFrame:
    """(review_id, category, severity, item_id, item_type): what repair leaves to people."""
    key = F.concat_ws("_", F.lit("rev"), "category", "item_id")
    return issues.where("NOT repairable").select(key.alias("review_id"), "category", "severity", "item_id", "item_type")


def repaired_edges(nodes: DataFrame, statements: DataFrame) -> DataFrame:
    """(id, type, src, dst, chunk, file, page, low_confidence_flag): one row per edge whose ends exist, with default grounding and page 1 where they lack."""
    one = statements.groupBy("type", "src", "dst").agg(F.min("chunk").alias("chunk"), F.min("file").alias("file"), F.min("page").alias("page"), F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"))
    ids = lambda c: nodes.select(F.col("id").alias(c)).distinct()
    kept = salted_lookup(salted_lookup(one, ids("src"), "src", "inner"), ids("dst"), "dst", "inner")
    page = F.when(F.col("page") >= 1, F.col("page")).otherwise(1)
    return kept.select(edge_id(F.col("type"), F.col("src"), F.col("dst")).alias("id"), "type", "src", "dst", F.coalesce("chunk", F.lit(NO_CHUNK)).alias("chunk"), F.coalesce("file", F.lit(NO_FILE)).alias("file"), page.alias("page"), (F.col("confidence") < LOW_CONFIDENCE).alias("low_confidence_flag"))


def repair_summary(issues: DataFrame) -> DataFrame:
    """One row: repaired, dangling_removed, grounding_patched, low_confidence_tagged, for_review."""
    of = lambda c: F.count_if((F.col("category") == c) & F.col("repairable"))
    return issues.agg(F.count_if("repairable").alias("repaired"), of("dangling_relation").alias("dangling_removed"), of("missing_grounding").alias("grounding_patched"), of("low_confidence").alias("low_confidence_tagged"), F.count_if(~F.col("repairable")).alias("for_review"))


def final_rates(issues: DataFrame, nodes: DataFrame, statements: DataFrame) -> DataFrame:
    """One row: nodes, relations, duplicates, orphans, lineage_rate and schema_rate in percent (two places), signed_off.

    lineage_rate is the share of nodes and edges without missing grounding, schema_rate that of edges without violation; both are 100 without
    any. signed_off asks for no critical issue and a lineage of 90 or more. All from counts; one row each is joined.
    """
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = statements.select("type", "src", "dst").distinct().agg(F.count(F.lit(1)).alias("relations"))
    of = lambda c: F.count_if(F.col("category") == c)
    i = issues.agg(of("duplicate_relation").alias("duplicates"), of("orphan_node").alias("orphans"), of("missing_grounding").alias("_g"), of("schema_violation").alias("_s"), F.count_if(F.col("severity") == "critical").alias("_c"))
    rate = lambda bad, of: F.round(100.0 * (1.0 - F.col(bad) / F.greatest(F.lit(1), of)), 2)
    return n.join(e).join(i).select("nodes", "relations", "duplicates", "orphans", rate("_g", F.col("nodes") + F.col("relations")).alias("lineage_rate"), rate("_s", F.col("relations")).alias("schema_rate"), ((F.col("_c") == 0) & (rate("_g", F.col("nodes") + F.col("relations")) >= 90)).alias("signed_off"))


def ordered_sample(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The first n rows by key; a top-k report."""
    return rows.orderBy(key).limit(n)
