"""The property graph of reports as two frames: its merge, its paths, its audit and repair.

nodes: id, label, name. edges: id, type, src, dst, page, confidence, evidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.operators.ontology import edge_rules
from reportloom.operators.skew import salted_lookup
from reportloom.session import Stash

EDGE_RULES = edge_rules()
LOW_CONFIDENCE = 0.5


def edge_id(kind: Column, src: Column, dst: Column) -> Column:
    return T.stable_digest([kind, src, dst])


def report_graph(companies: DataFrame, chunks: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of companies, sectors, reports, chunks and canonical entities. Withdrawn rows make none; null ids neither."""
    live, ents = chunks.where("deleted_at IS NULL"), canonical.where("deleted_at IS NULL")
    node = lambda df, i, label, name: df.select(i.alias("id"), F.lit(label).alias("label") if isinstance(label, str) else label.alias("label"), name.alias("name"))
    nodes = reduce(DataFrame.unionByName, [
        node(companies, F.col("company_id"), "Company", F.col("short_name")),
        node(companies, F.concat(F.lit("sector:"), F.col("sector")), "Sector", F.col("sector")),
        node(live, F.concat(F.lit("report:"), F.col("document_id")), "Report", F.col("document_id")),
        node(live, F.col("chunk_id"), "Chunk", F.col("chunk_id")),
        node(ents, F.col("canonical_id"), F.col("type"), F.col("canonical_name")),
    ]).where("id IS NOT NULL").groupBy("id").agg(F.min_by("label", F.struct("label", "name")).alias("label"), F.min_by("name", F.struct("label", "name")).alias("name"))
    edge = lambda df, kind, s, d, page=None, conf=None: df.select(F.lit(kind).alias("type"), s.alias("src"), d.alias("dst"), (F.lit(None) if page is None else page).cast("int").alias("page"), (F.lit(None) if conf is None else conf).cast("double").alias("confidence"))
    evid = ents.select("canonical_id", "average_confidence", F.explode("source_chunk_ids").alias("c"))
    edges = reduce(DataFrame.unionByName, [
        edge(companies, "OPERATES_IN", F.col("company_id"), F.concat(F.lit("sector:"), F.col("sector"))),
        edge(live, "PUBLISHED", F.concat(F.lit("company:"), F.col("ticker")), F.concat(F.lit("report:"), F.col("document_id"))),
        edge(live, "HAS_CHUNK", F.concat(F.lit("report:"), F.col("document_id")), F.col("chunk_id"), F.col("page_number")),
        edge(evid, "EVIDENCED_BY", F.col("canonical_id"), F.trim("c"), None, F.col("average_confidence")),
        edge(ents.where("type = 'Person'"), "HOLDS_ROLE_AT", F.col("canonical_id"), F.try_element_at("properties", F.lit("company_id")), None, F.col("average_confidence")),
    ]).where("src IS NOT NULL AND dst IS NOT NULL")
    return nodes, merge_edges(edges)


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per (type, src, dst): least page, highest confidence, number of statements. Partial aggregates before the shuffle."""
    e = edges.groupBy("type", "src", "dst").agg(F.min("page").alias("page"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("statements"))
    return e.withColumn("id", edge_id(F.col("type"), F.col("src"), F.col("dst")))


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Property-wise upsert by id: a new property replaces the old one unless it is null. Either side may be empty."""
    cols = [c for c in old.columns if c != "id"]
    n = new.select("id", *[F.col(c).alias(f"_{c}") for c in cols])
    return old.join(n, "id", "full").select("id", *[F.coalesce(f"_{c}", c).alias(c) for c in cols])


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist; the others are dropped."""
    ids = nodes.select(F.col("id").alias("_n")).distinct()
    return edges.join(ids, edges.src == ids._n, "left_semi").join(ids, edges.dst == ids._n, "left_semi")


def dangling_edges(edges: DataFrame, nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, type, missing): edges that lack their source or target node, or both. Hubs are split by salts."""
    n = edges.count() if rows is None else rows
    there = lambda c: nodes.select(F.col("id").alias(c), F.lit(True).alias(f"_{c}")).distinct()
    e = salted_lookup(salted_lookup(edges, there("src"), "src", rows=n), there("dst"), "dst", rows=n)
    gone = F.filter(F.array(F.when(F.col("_src").isNull(), F.lit("source")), F.when(F.col("_dst").isNull(), F.lit("target"))), lambda x: x.isNotNull())
    return e.select("id", "type", F.explode(gone).alias("missing"))


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no end of any edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("_n")).distinct()  # a hub is one row per map task
    return nodes.join(ends, nodes.id == ends._n, "left_anti")


def schema_violations(edges: DataFrame, nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, type, src_label, dst_label) of edges of a known type whose ends have labels that no rule allows; dangling edges are left out."""
    spark = edges.sparkSession
    rules = spark.createDataFrame(EDGE_RULES, "type string, src_label string, dst_label string")
    lab = lambda c, out: nodes.select(F.col("id").alias(c), F.col("label").alias(out))
    e = edges.join(F.broadcast(rules.select("type").distinct()), "type")
    e = salted_lookup(e, lab("src", "src_label"), "src", "inner", rows=rows)
    e = salted_lookup(e, lab("dst", "dst_label"), "dst", "inner", rows=rows)
    return e.join(F.broadcast(rules), ["type", "src_label", "dst_label"], "left_anti").select("id", "type", "src_label", "dst_label")


def paths(edges: DataFrame, starts: DataFrame, hops: int, types: list[list[str]] | None = None) -> DataFrame:
    """(start, n1.., e1.., ) directed paths of exactly `hops` edges from the nodes in starts(id); no edge twice on a path.

    `types` names the edge types allowed at each hop, which is what keeps hubs from multiplying; each hop is an equi-join by node. The
    paths so far are a table in the shared folder before each further hop, so that those which meet in a hub are counted and split by salts; the
    last of these tables belongs to the caller. Runs all hops but the last when called.
    """
    stash = Stash(edges.sparkSession, "paths")
    p, n = starts.select(F.col("id").alias("start"), F.col("id").alias("n0")).distinct(), 0  # a start is one row
    for h in range(1, hops + 1):
        e = edges if not types else edges.where(F.col("type").isin(types[h - 1]))
        if h > 1:
            before = p
            p, seen = stash.put_counted(p, n=F.count(F.lit(1)))
            stash.drop(before)
            n = seen["n"]
        last, p = p, salted_lookup(p, e.select(F.col("src").alias(f"n{h - 1}"), F.col("dst").alias(f"n{h}"), F.col("id").alias(f"e{h}")), f"n{h - 1}", "inner", rows=n, shuffled=True)
        for g in range(1, h):
            p = p.where(F.col(f"e{g}") != F.col(f"e{h}"))
    if hops > 1:
        stash.keep(last)
    return p.select("start", *[f"n{h}" for h in range(1, hops + 1)], *[f"e{h}" for h in range(1, hops + 1)])


def shared_neighbours(edges: DataFrame, kind: str) -> DataFrame:
    """(a, b, shared): pairs of nodes with an edge of this type to the same node, a smaller than b, and how many they share."""
    e = edges.where(F.col("type") == kind).select("src", "dst").distinct()
    x, y = e.select(F.col("src").alias("a"), "dst"), e.select(F.col("src").alias("b"), "dst")
    return x.join(y, "dst").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def label_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, name, count) of nodes by label and edges by type."""
    n = nodes.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("count")).withColumn("what", F.lit("node"))
    e = edges.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("count")).withColumn("what", F.lit("edge"))
    return n.unionByName(e)


def audit_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(category, severity, issues): what is wrong with the graph, by category. Nodes and edges are written once, for all checks, when called."""
    stash = Stash(nodes.sparkSession, "audit")
    nodes, (edges, seen) = stash.put(nodes), stash.put_counted(edges, n=F.count(F.lit(1)))
    parts = [
        ("dangling_edge", "critical", dangling_edges(edges, nodes, seen["n"])),
        ("orphan_node", "warning", orphan_nodes(nodes, edges)),
        ("schema_violation", "critical", schema_violations(edges, nodes, seen["n"])),
        ("invalid_page", "warning", edges.where("page IS NOT NULL AND page < 1")),
        ("low_confidence", "warning", edges.where(F.coalesce("confidence", F.lit(1.0)) < LOW_CONFIDENCE)),
        ("missing_name", "warning", nodes.where(F.coalesce(F.trim("name"), F.lit("")) == "")),
    ]
    return stash.finish(reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("issues")).select(F.lit(c).alias("category"), F.lit(s).alias("severity"), "issues") for c, s, df in parts]))


def quality_score(issues: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes, critical, warnings, score (100 - 5 critical - 1 warning, within 0 and 100; null for an empty graph), passed."""
    i = issues.agg(F.coalesce(F.sum(F.when(F.col("severity") == "critical", F.col("issues"))), F.lit(0)).alias("critical"), F.coalesce(F.sum(F.when(F.col("severity") == "warning", F.col("issues"))), F.lit(0)).alias("warnings"))
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    score = F.when(F.col("nodes") > 0, F.greatest(F.lit(0), F.least(F.lit(100), 100 - 5 * F.col("critical") - F.col("warnings"))))
    return n.join(i).select("nodes", "critical", "warnings", score.alias("score"), ((score >= 80) & (F.col("critical") == 0)).alias("passed"))  # one row each


def repair(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without dangling ones; pages below 1 become 1; low confidence is flagged."""
    e = with_both_ends(edges, nodes)
    return e.withColumn("page", F.when(F.col("page") < 1, 1).otherwise(F.col("page"))).withColumn("flagged", F.coalesce("confidence", F.lit(1.0)) < LOW_CONFIDENCE)


def duplicate_edges(statements: DataFrame) -> DataFrame:
    """(type, src, dst, surplus) of edges stated more than once."""
    return statements.groupBy("type", "src", "dst").agg((F.count(F.lit(1)) - 1).alias("surplus")).where("surplus > 0")


def conflicting_names(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, names) of keys with more than one name; null and blank names don't count."""
    return df.where(F.trim(name) != "").groupBy(key).agg(F.count_distinct(F.trim(name)).alias("names")).where("names > 1")


def remap_edges(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges with their ends replaced by the canonical id of aliases(id, canonical), where there is one, and merged."""
    m = lambda c: aliases.groupBy(F.col("id").alias(c)).agg(F.min("canonical").alias(f"_{c}"))
    e = salted_lookup(salted_lookup(edges, m("src"), "src"), m("dst"), "dst")
    return merge_edges(e.select("type", F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"), "page", "confidence"))
