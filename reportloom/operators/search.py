"""Search over two sides by mode, with fallback; fusion that keeps what matched; intent of graph questions; guard of graph queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.operators.ranking import RRF_K

# Words of a question, the node labels it is then about, the edge types that lead there.
INTENTS = [
    (["ürün", "üretim", "hizmet", "marka", "product"], ["Product"], ["PRODUCES"]),
    (["sektör", "rakip", "aynı sektör", "alan", "sector"], ["Sector", "Company"], ["OPERATES_IN"]),
    (["ciro", "kâr", "gelir", "favök", "ebitda", "bütçe", "metrik", "oran", "artış"], ["FinancialMetric"], ["REPORTED", "CONTAINS_METRIC", "REPORTED_METRIC"]),
    (["yönetici", "ceo", "müdür", "başkana", "yönetim", "person"], ["Person"], ["EXECUTIVE_AT", "HOLDS_ROLE_AT"]),
    (["rapor", "faaliyet raporu", "report"], ["Report"], ["PUBLISHED"]),
]
ANY_LABEL = ["Product", "FinancialMetric", "Sector", "Person"]
# Words of a graph query that change the graph.
MUTATIONS = ["CREATE", "MERGE", "SET", "DELETE", "DETACH", "DROP", "REMOVE", "ALTER", "GRANT", "REVOKE"]


def dispatch(questions: DataFrame, vector: DataFrame, graph: DataFrame, key: str, query: str, top: int, k: int = RRF_K) -> DataFrame:
    """(query, key, asked, executed, score, source, rank): hits of questions(query, asked) from rankings with score and rank.

    asked vector or graph takes that side's first `top`; hybrid fuses the first 2 `top` of both by reciprocal ranks, scores divided by the
    question's best. A question without rows on the side asked, or on one side of two, is answered by the other (executed says by
    which: vector, graph or fused). Each side keeps its own scores then. Ties: the smaller key. Rankings are bounded lists.
    """
    some = lambda d, c: d.select(query).distinct().withColumn(c, F.lit(True))
    q = questions.join(some(vector, "_v"), query, "left").join(some(graph, "_g"), query, "left")
    no_v, no_g = F.col("_v").isNull(), F.col("_g").isNull()
    way = F.when((F.col("asked") == "vector") & ~no_v | no_g, "vector").when(F.col("asked").isin("vector", "graph") | no_v, "graph").otherwise("fused")
    q = q.select(query, "asked", way.alias("executed"))
    v = vector.select(query, key, "rank", F.col("score").alias("v"), F.lit(None).cast("double").alias("g"), F.lit("vector").alias("side"))
    g = graph.select(query, key, "rank", F.lit(None).cast("double").alias("v"), F.col("score").alias("g"), F.lit("graph").alias("side"))
    u = v.unionByName(g).join(q, query).where(F.col("executed").isin("fused") | (F.col("executed") == F.col("side"))).where(F.col("rank") <= F.when(F.col("asked") == "hybrid", 2 * top).otherwise(top))
    u = u.groupBy(query, key, "asked", "executed").agg(F.max("v").alias("v"), F.max("g").alias("g"), F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 6).alias("_s"))
    fused = F.round(F.col("_s") / F.max("_s").over(Window.partitionBy(query)), 4)
    u = u.withColumn("score", F.when(F.col("executed") == "vector", F.col("v")).when(F.col("executed") == "graph", F.col("g")).otherwise(fused))
    source = F.when(F.col("v").isNotNull() & F.col("g").isNotNull(), "fused").when(F.col("v").isNotNull(), "vector").otherwise("graph")
    ranked = u.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))).where(F.col("rank") <= top)
    return ranked.select(query, key, "asked", "executed", "score", source.alias("source"), "rank")


def rrf_matched(lists: list[tuple[str, DataFrame]], key: str, query: str, payload: str, k: int = RRF_K) -> DataFrame:
    """(query, key, fusion_score, best_rank, query_count, matched_queries, first_<payload>): reciprocal rank fusion of named rankings.

    matched_queries are the names of the lists with the row, in the order given; the payload is that of the first of them. A row that
    occurs twice in a list counts twice, as its ranks say; null keys are dropped.
    """
    u = reduce(DataFrame.unionByName, [d.where(F.col(key).isNotNull()).select(query, key, "rank", payload, F.lit(i).alias("_o"), F.lit(name).alias("_l")) for i, (name, d) in enumerate(lists)])
    seen = F.transform(F.array_sort(F.collect_set(F.struct("_o", "_l"))), lambda x: x["_l"])  # as many as there are lists
    return u.groupBy(query, key).agg(
        F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 6).alias("fusion_score"), F.min("rank").alias("best_rank"), F.count_distinct("_l").alias("query_count"), seen.alias("matched_queries"), F.min_by(payload, "_o").alias(f"first_{payload}")
    )


def graph_intent(question: Column, most_hops: int | None = None, limit: int = 10) -> Column:
    """struct(target_labels, edge_types, metric, hops, limit) of a question; hops within 1 and 3, limit within 1 and 50."""
    q = T.lower_tr(F.coalesce(question, F.lit("")))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(q, w))
    none = F.array().cast("array<string>")
    pick = lambda i: F.flatten(F.array(*[F.when(has(x[0]), F.array(*map(F.lit, x[i]))).otherwise(none) for x in INTENTS]))
    labels = F.when(F.size(pick(1)) > 0, pick(1)).otherwise(F.array(*map(F.lit, ANY_LABEL)))
    metric = F.when(has(INTENTS[2][0]), F.when(has(["ciro", "revenue"]), "ciro").when(has(["kâr", "profit"]), "net_kâr"))
    hops = F.when(has(["ürün", "yönetici"]), 1).otherwise(2) if most_hops is None else F.lit(min(3, max(1, most_hops)))
    return F.struct(labels.alias("target_labels"), pick(2).alias("edge_types"), metric.alias("metric"), hops.alias("hops"), F.lit(min(50, max(1, limit))).alias("limit"))


def forbidden_words(statement: Column) -> Column:
    """The words of a graph query, without its comments, that change the graph: sorted, distinct; empty for a read-only one and for null."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(statement, F.lit("")), r"//[^\n]*", ""), r"/\*[\s\S]*?\*/", "")
    words = F.regexp_extract_all(F.upper(bare), F.lit(r"\b[A-Z_]+\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w.isin(MUTATIONS))))
