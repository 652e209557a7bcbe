"""Fusion, scoring and diversification of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.session import Stash

# Weights of the base score, penalty of a chosen neighbour, similarity from which texts repeat each other.
W_VECTOR, W_LEXICAL, W_METADATA = 0.5, 0.3, 0.2
SAME_PAGE, SIMILAR, SIMILAR_WEIGHT = 0.15, 0.6, 0.5
RRF_K = 60
# Words that say nothing about a question.
STOP_WORDS = "ve veya bir ile için de da bu şu nedir nasıldı hakkında göre".split()


def rrf(lists: list[DataFrame], key: str, query: str = "query_id", k: int = RRF_K) -> DataFrame:
    """(query, key, fusion_score, best_rank, lists): reciprocal rank fusion of rankings with a column rank.

    Scores are sums of 1 / (k + rank) over the lists in which a row occurs; one that occurs twice in a list counts with
    its best rank. Null keys are dropped. Partial sums before the shuffle.
    """
    tagged = [x.where(F.col(key).isNotNull()).groupBy(query, key).agg(F.min("rank").alias("rank")).withColumn("_l", F.lit(i)) for i, x in enumerate(lists)]
    u = reduce(DataFrame.unionByName, tagged)
    return u.groupBy(query, key).agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 6).alias("fusion_score"), F.min("rank").alias("best_rank"), F.count_distinct("_l").alias("lists"))


def hybrid_fusion(vector: DataFrame, graph: DataFrame, key: str, query: str = "query_id", top: int = 10, k: int = RRF_K) -> DataFrame:
    """(query, key, score, source, rank): two-sided fusion, scores divided by the query's best, four places.

    source is vector, graph or fused. Ranked by score, then key. A side without rows leaves the other's order.
    """
    both = rrf([vector, graph], key, query, k)
    side = vector.select(query, key).distinct().withColumn("_v", F.lit(1)).join(graph.select(query, key).distinct().withColumn("_g", F.lit(1)), [query, key], "full")
    j = both.join(side, [query, key])
    s = F.round(F.col("fusion_score") / F.max("fusion_score").over(Window.partitionBy(query)), 4)
    src = F.when(F.col("_v").isNotNull() & F.col("_g").isNotNull(), "fused").when(F.col("_v").isNotNull(), "vector").otherwise("graph")
    j = j.select(query, key, s.alias("score"), src.alias("source"))
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def weighted_merge(vector: DataFrame, graph: DataFrame, key: str, query: str = "query_id", wv: float = 0.6, wg: float = 0.4) -> DataFrame:
    """(query, key, score, source): weighted scores of both sides; of a row on both sides the vector side's copy."""
    v = vector.select(query, key, F.round(F.col("score") * wv, 6).alias("score"), F.lit("vector").alias("source"), F.lit(0).alias("_o"))
    g = graph.select(query, key, F.round(F.col("score") * wg, 6).alias("score"), F.lit("graph").alias("source"), F.lit(1).alias("_o"))
    u = v.unionByName(g)
    return u.groupBy(query, key).agg(F.min_by(F.struct("score", "source"), F.struct("_o", -F.col("score"))).alias("x")).select(query, key, "x.score", "x.source")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two word arrays; 0 if a side is empty or null."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def blank_words(c: Column | str) -> Column:
    """Distinct lower-case words between blanks; null gives an empty array."""
    return F.array_distinct(F.filter(F.split(T.lower_tr(F.coalesce(T.col(c), F.lit(""))), "[ \\t\\r\\n]+"), lambda w: w != ""))


def lexical_overlap(question: Column, text: Column) -> Column:
    """Share of the question's words (without stop words and single characters) that the text has, four places; 0 without words."""
    q = F.array_distinct(F.filter(T.answer_words(question), lambda w: (F.length(w) > 1) & ~F.array_contains(F.array(*map(F.lit, STOP_WORDS)), w)))
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, T.answer_words(text))) / F.size(q), 4)).otherwise(F.lit(0.0))


def base_score(vector: Column, lexical: Column, ticker_ok: Column, year_ok: Column) -> Column:
    """0.5 vector (within 0 and 1) + 0.3 lexical + 0.2 metadata; metadata is 1, less a half for each of ticker and year that differs."""
    meta = F.greatest(F.lit(0.0), 1.0 - F.when(ticker_ok, 0.0).otherwise(0.5) - F.when(year_ok, 0.0).otherwise(0.5))
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), vector))
    return F.round(W_VECTOR * v + W_LEXICAL * lexical + W_METADATA * meta, 6)


def diverse_selection(candidates: DataFrame, query: str, key: str, score: str, text: str, page: str, k: int = 5) -> DataFrame:
    """(query, key, pick, final_score): k times the candidate of the highest score less its penalties.

    Penalty: SAME_PAGE for each chosen row of the same page group, and similarity times SIMILAR_WEIGHT for each chosen
    text that is more than SIMILAR alike. Ties: the smaller key. Candidates are a ranked list's head, a bounded number
    per query; they are folded in one row's array, in the JVM. Null texts are like nothing, null pages on no page.
    """
    c = candidates.select(query, F.struct(F.col(key).alias("key"), F.col(score).alias("score"), blank_words(text).alias("words"), F.col(page).alias("page")).alias("c"))
    g = c.groupBy(query).agg(F.array_sort(F.collect_list("c")).alias("all"))  # a bounded list per query
    empty = F.struct(F.array().cast(g.select("all").dtypes[0][1]).alias("chosen"), F.array().cast("array<double>").alias("scores"))

    def value(x: Column, chosen: Column) -> Column:
        def one(acc: Column, y: Column) -> Column:
            sim = jaccard(x["words"], y["words"])
            return acc + F.when(x["page"] == y["page"], SAME_PAGE).otherwise(0.0) + F.when(sim > SIMILAR, sim * SIMILAR_WEIGHT).otherwise(0.0)

        return F.round(x["score"] - F.aggregate(chosen, F.lit(0.0), one), 6)

    def step(s: Column, _: Column) -> Column:
        left = F.filter("all", lambda x: ~F.exists(s["chosen"], lambda y: y["key"] == x["key"]))
        scored = F.transform(left, lambda x: F.struct(value(x, s["chosen"]).alias("v"), x.alias("x")))
        best = F.aggregate(F.slice(scored, F.lit(2), F.greatest(F.size(scored), F.lit(1))), F.try_element_at(scored, F.lit(1)), lambda a, b: F.when(b["v"] > a["v"], b).otherwise(a))
        return F.when(F.size(left) > 0, F.struct(F.array_append(s["chosen"], best["x"]).alias("chosen"), F.array_append(s["scores"], best["v"]).alias("scores"))).otherwise(s)

    picked = g.select(query, F.aggregate(F.sequence(F.lit(1), F.lit(k)), empty, step).alias("p"))
    rows = picked.select(query, F.posexplode(F.arrays_zip(F.col("p.chosen.key").alias("key"), F.col("p.scores").alias("v"))).alias("i", "z"))
    return rows.select(query, F.col("z.key").alias(key), (F.col("i") + 1).alias("pick"), F.col("z.v").alias("final_score"))


def greedy_distinct(rows: DataFrame, group: list[str], key: str, text: str, order: Column, limit: float) -> DataFrame:
    """(group.., key) of rows kept in order unless their words are `limit` or more alike to those of a row kept before.

    Sequential by definition, so it works within a stated group whose size is bounded (one ranked list, one block);
    the group is folded in one row's array, in the JVM.
    """
    g = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(key).alias("key"), blank_words(text).alias("words")))).alias("all"))
    empty = F.array().cast(g.select("all").dtypes[-1][1])
    kept = F.aggregate("all", empty, lambda acc, x: F.when(F.exists(acc, lambda y: jaccard(x["words"], y["words"]) >= limit), acc).otherwise(F.array_append(acc, x)))
    return g.select(*group, F.explode(kept).alias("x")).select(*group, F.col("x.key").alias(key))


def greedy_distinct_all(rows: DataFrame, key: str, text: str, limit: float) -> DataFrame:
    """(key) of the rows kept in the order of their keys unless their words are `limit` or more alike to those of any row kept before.

    As greedy_distinct, over the whole table. Rows of the same words are one node, as only the first of them can stay. Nodes that
    can be alike share one of their rarest words: a node of n words has n - ceil(limit n) + 1 of them, so no pair is lost; upper
    bounds of the words in common leave few pairs for the exact comparison. Then in rounds: nodes without an earlier alike node stay, those alike to them go, until no pair is left. Rows without words all stay.
    Writes its steps to the shared folder when called.
    """
    stash = Stash(rows.sparkSession, "distinct")
    r = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.array_sort(blank_words(text)).alias("words"))
    sets = r.where(F.size("words") > 0).groupBy(F.sha2(F.concat_ws(" ", "words"), 256).alias("hash")).agg(F.min("key").alias("key"), F.first("words").alias("words"))
    nodes = stash.put(sets.select(F.monotonically_increasing_id().alias("id"), "hash", "key", "words", F.size("words").alias("n")))
    w = nodes.select("id", "n", F.explode("words").alias("w"))
    rated = w.join(w.groupBy("w").agg(F.count(F.lit(1)).alias("df")), "w").withColumn("h", F.xxhash64("w"))
    # parities of the words' hashes in 256 bits: two nodes differ in as many words at least as in bits
    bits = [F.bit_xor(F.when(F.expr(f"pmod(h, 256) div 64 = {k}"), F.expr("shiftleft(1L, cast(pmod(h, 64) AS int))")).otherwise(F.lit(0).cast("bigint"))).alias(f"b{k}") for k in range(4)]
    each = rated.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("x"), *bits)
    length = F.col("n") - F.ceil(F.col("n") * F.lit(limit) - F.lit(1e-9)).cast("int") + 1
    each = each.select("id", "n", "b0", "b1", "b2", "b3", F.posexplode(F.slice("x", F.lit(1), length)).alias("at", "x"))
    first = stash.put(each.select("id", "n", "b0", "b1", "b2", "b3", "at", F.xxhash64("x.w").alias("w")))
    x, y = (first.select("w", *[F.col(c).alias(f"{c}_{i}") for c in first.columns if c != "w"]) for i in "xy")
    both = F.col("n_x") + F.col("n_y")
    common = both * F.lit(limit / (1 + limit)) - F.lit(1e-6)  # words in common at least
    differ = sum((F.bit_count(F.col(f"b{k}_x").bitwiseXOR(F.col(f"b{k}_y"))) for k in range(4)), F.lit(0))
    # at the first word in common, the words after it on either side bound those in common
    rest = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    near = (F.col("id_x") < F.col("id_y")) & (F.least("n_x", "n_y") >= common) & (rest >= common) & (differ <= both - 2 * common)
    pairs = x.join(y, "w").where(near).select(F.col("id_x").alias("x"), F.col("id_y").alias("y")).distinct()
    side = lambda i: nodes.select(F.col("id").alias(i), F.struct("key", "hash", "id").alias(f"o_{i}"), F.col("words").alias(f"w_{i}"))
    pairs = pairs.join(side("x"), "x").join(side("y"), "y").where(jaccard(F.col("w_x"), F.col("w_y")) >= limit)
    left = stash.put(pairs.select(F.least("o_x", "o_y")["id"].alias("a"), F.greatest("o_x", "o_y")["id"].alias("b")))
    gone = []
    while left.limit(1).count():
        stays = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone.append(stash.put(left.join(stays, "a", "left_semi").select(F.col("b").alias("id")).distinct()))
        rest = left.join(gone[-1].withColumnRenamed("id", "a"), "a", "left_anti").join(gone[-1].withColumnRenamed("id", "b"), "b", "left_anti")
        rest = stash.put(rest.select("a", "b"))
        stash.drop(left)
        left = rest
    kept = nodes.join(reduce(DataFrame.unionByName, gone), "id", "left_anti") if gone else nodes
    return stash.finish(kept.select(F.col("key").alias(key)).unionByName(r.where(F.size("words") == 0).select(F.col("key").alias(key))))


def within_budget(rows: DataFrame, group: str, order: list, size: Column, budget: int) -> DataFrame:
    """Rows of each group in order while their running size is within the budget; the first is always kept."""
    w = Window.partitionBy(group).orderBy(*order)
    run = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", run).withColumn("_n", F.row_number().over(w)).where((F.col("used") <= budget) | (F.col("_n") == 1)).drop("_n")


def path_relevance(hops: Column, ticker_seen: Column, year_ok: Column) -> Column:
    """1 less a tenth per hop (one at least), a tenth more for ticker and for year, within 0.1 and 1, two places."""
    s = 1.0 - 0.1 * F.greatest(F.lit(1), hops) + F.when(ticker_seen, 0.1).otherwise(0.0) + F.when(year_ok, 0.1).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), s)), 2)


# Phrases that ask for relations, and such that ask for wording; each with what keeps them from deciding.
GRAPH_PHRASES, GRAPH_BUT = ["ürünleri nelerdir", "yöneticileri kimlerdir", "aynı sektördeki", "rakipleri kimlerdir", "sektördeki diğer", "hangi şirketler aynı"], ["açıkla", "neden", "strateji"]
VECTOR_PHRASES, VECTOR_BUT = ["açıkla", "neden", "nasıl bir strateji", "sürdürülebilirlik yaklaşımı", "vizyonu nedir", "değerlendirmesi", "özetle"], ["ciro", "ürün", "yönetici"]


def retrieval_mode(question: Column) -> Column:
    """graph, vector or hybrid, by the phrases a question has."""
    q = T.lower_tr(F.coalesce(question, F.lit("")))
    has = lambda ps: F.exists(F.array(*map(F.lit, ps)), lambda p: F.contains(q, p))
    return F.when(has(GRAPH_PHRASES) & ~has(GRAPH_BUT), "graph").when(has(VECTOR_PHRASES) & ~has(VECTOR_BUT), "vector").otherwise("hybrid")


def is_relevant(hit_ticker: Column, ticker: Column, text: Column, keywords: Column, question: Column) -> Column:
    """Same ticker (or none asked) and a keyword, or two words of more than four letters of the question, in the text."""
    t = T.lower_tr(F.coalesce(text, F.lit("")))
    word = F.exists(keywords, lambda k: F.contains(t, T.lower_tr(k)))
    long = F.array_distinct(F.filter(T.answer_words(question), lambda w: F.length(w) > 4))
    two = F.size(F.filter(long, lambda w: F.contains(t, w))) >= 2
    return (ticker.isNull() | (hit_ticker == ticker)) & (F.coalesce(word, F.lit(False)) | two)
