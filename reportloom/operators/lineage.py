"""Lineage of chunks through the stages, inventories, evidence and citation bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.functions import text as T


def chunk_lineage(chunks: DataFrame, entities: DataFrame, canonical: DataFrame, golden: DataFrame, sample: int = 15, seed: str = "lineage") -> DataFrame:
    """(chunk_id, document_id, mentions, canonical_rows, questions): what became of a seeded sample of chunks at each stage.

    The sample is the feature: the `sample` chunks whose digest with the seed is smallest, the same in any order. Each stage is
    reduced to the sampled chunks before it is counted. A chunk that no later stage names has zeros; repeated rows count once.
    """
    one = chunks.groupBy("chunk_id").agg(F.min("document_id").alias("document_id"))
    s = one.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(seed), "chunk_id"), 256)).orderBy("_h").limit(sample).drop("_h")
    count = lambda df, key, out: df.join(F.broadcast(s.select("chunk_id")), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.count_distinct(key).alias(out))  # noqa: E731  the sample is bounded
    m = count(entities.select(T.strip("source_chunk_id").alias("chunk_id"), "id"), "id", "mentions")
    c = count(canonical.select(F.explode("source_chunk_ids").alias("x"), "canonical_id").select(T.strip("x").alias("chunk_id"), "canonical_id"), "canonical_id", "canonical_rows")
    g = count(golden.select(F.explode("source_chunk_ids").alias("x"), "id").select(T.strip("x").alias("chunk_id"), "id"), "id", "questions")
    j = s.join(m, "chunk_id", "left").join(c, "chunk_id", "left").join(g, "chunk_id", "left")
    return j.select("chunk_id", "document_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("mentions", "canonical_rows", "questions")])


def compare_inventories(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """(name, left_rows, right_rows, equal): counts by name of two tables side by side; a missing side is null, which equals nothing but null."""
    x = a.groupBy(F.col(name).alias("_x")).agg(F.count(F.lit(1)).alias("left_rows"))
    y = b.groupBy(F.col(name).alias("_y")).agg(F.count(F.lit(1)).alias("right_rows"))
    return x.join(y, F.col("_x").eqNullSafe(F.col("_y")), "full").select(F.coalesce("_x", "_y").alias(name), "left_rows", "right_rows", F.col("left_rows").eqNullSafe(F.col("right_rows")).alias("equal"))


def inventory(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, labels, types, edges with provenance (a page or a confidence)."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("label").alias("labels"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("type").alias("types"), F.count_if(F.col("page").isNotNull() | F.col("confidence").isNotNull()).alias("with_provenance"))
    return n.join(F.broadcast(e)).select("nodes", "edges", "labels", "types", "with_provenance")  # one row each


def best_evidence(evidence: DataFrame, query: str, chunk: str, path: str, score: str) -> DataFrame:
    """One row per query and evidence item with the highest score; an item is a path if it has one, else a chunk. Items without either are dropped."""
    e = evidence.withColumn("item", F.coalesce(F.concat(F.lit("path:"), F.col(path)), F.concat(F.lit("chunk:"), F.col(chunk)))).where("item IS NOT NULL")
    return e.groupBy(query, "item").agg(F.max(score).alias(score), F.count(F.lit(1)).alias("copies"))


def number_citations(uses: DataFrame, report: str, position: str, source: str) -> DataFrame:
    """(report, source, number): sources numbered from 1 in the order of their first use. A report's few sources are ranked in one row's array."""
    first = uses.where(F.col(source).isNotNull()).groupBy(report, source).agg(F.min(position).alias("p"))
    g = first.groupBy(report).agg(F.array_sort(F.collect_list(F.struct("p", F.col(source).alias("s")))).alias("all"))
    return g.select(report, F.posexplode("all").alias("i", "x")).select(report, F.col("x.s").alias(source), (F.col("i") + 1).alias("number"))


def best_candidate(decisions: DataFrame, left: str, right: str, score: str, wanted: Column) -> DataFrame:
    """(left, candidate, score): of the wanted pairs of each left id the right id of the highest score, then the smallest. A partial reduction."""
    d = decisions.where(wanted & F.col(left).isNotNull() & F.col(right).isNotNull() & F.col(score).isNotNull())
    return d.groupBy(left).agg(F.min_by(right, F.struct(-F.col(score), F.col(right))).alias("candidate"), F.max(score).alias(score))


def grounded(samples: DataFrame) -> Column:
    """A sample that is answerable has an answer, a source and pages; one that isn't has no source chunks."""
    some = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    n = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return F.when(F.coalesce("answerable", F.lit(False)), some("expected_answer") & some("source_file") & n("source_pages")).otherwise(~n("source_chunk_ids"))


def name_recall(expected: Column, text: Column) -> Column:
    """Share of the expected names that occur in a text, without case and accents; 1 if none is expected."""
    e = F.array_distinct(F.filter(F.coalesce(expected, F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))
    t = T.fold_letters(F.coalesce(text, F.lit("")))
    return F.when(F.size(e) > 0, F.round(F.size(F.filter(e, lambda x: F.contains(t, T.fold_letters(x)))) / F.size(e), 6)).otherwise(F.lit(1.0))


def registry_state(content: Column, stored: Column) -> Column:
    """valid if the stored digest is that of the content, else changed; missing without a stored one."""
    return F.when(stored.isNull(), "missing").when(F.sha2(F.coalesce(content, F.lit("")), 256) == stored, "valid").otherwise("changed")
