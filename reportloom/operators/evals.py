"""Metrics of retrieval, answers, citations and agreement: columns for rows, frames for sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.operators.ordering import ranked
from reportloom.operators.ranking import jaccard


def recall_at(got: Column, truth: Column, k: int) -> Column:
    """Share of the distinct true ids among the first k; 1 without truth."""
    t = F.array_distinct(truth)
    return F.when(F.size(t) > 0, F.round(F.size(F.array_intersect(F.slice(got, 1, k), t)) / F.size(t), 6)).otherwise(F.lit(1.0))


def precision_at(got: Column, truth: Column, k: int) -> Column:
    """Share of true ids among the rows returned (k at most); 0 if none is returned."""
    g = F.slice(got, 1, k)
    return F.when(F.size(g) > 0, F.round(F.size(F.filter(g, lambda x: F.array_contains(truth, x))) / F.size(g), 6)).otherwise(F.lit(0.0))


def reciprocal_rank(got: Column, truth: Column) -> Column:
    """1 over the place of the first true id, 0 if there is none."""
    hits = F.filter(F.transform(got, lambda x, i: F.when(F.array_contains(truth, x), i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(hits) > 0, F.round(1.0 / F.array_min(hits), 6)).otherwise(F.lit(0.0))


def ndcg_at(got: Column, truth: Column, k: int) -> Column:
    """Binary gains; the ideal has min(k, true ids) hits first; 0 without truth."""
    g = F.slice(got, 1, k)
    gain = F.aggregate(F.transform(g, lambda x, i: F.when(F.array_contains(truth, x), 1.0 / F.log2(i + 2)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    n = F.least(F.lit(k), F.size(F.array_distinct(truth)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1))
    return F.when(n > 0, F.round(gain / ideal, 6)).otherwise(F.lit(0.0))


def norm_text(c: Column | str) -> Column:
    return F.array_join(T.answer_words(c), " ")


def exact_match(answer: Column, expected: Column, others: Column) -> Column:
    """The normalised answer equals the expected one or one of the others (null: none)."""
    a = norm_text(answer)
    return F.exists(F.concat(F.array(expected), F.coalesce(others, F.array().cast("array<string>"))), lambda x: F.coalesce(norm_text(x) == a, F.lit(False)))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the word multisets; 1 if both are empty, 0 if one is."""
    x, y = T.answer_words(a), T.answer_words(b)
    count = lambda arr, w: F.size(F.filter(arr, lambda z: z == w))
    same = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda s, w: s + F.least(count(x, w), count(y, w)))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.round(2.0 * same / (F.size(x) + F.size(y)), 6))


def normalized_match(a: Column, b: Column) -> Column:
    """1 if one normalised text contains the other, else the Jaccard of their words; 0 if one is empty."""
    x, y = norm_text(a), norm_text(b)
    return F.when((x == "") | (y == ""), 0.0).when(F.contains(x, y) | F.contains(y, x), 1.0).otherwise(F.round(jaccard(F.array_distinct(T.answer_words(a)), F.array_distinct(T.answer_words(b))), 6))


def numeric_accuracy(answer: Column, expected: Column) -> Column:
    """Share of the expected numbers that the answer states; 1 if none is expected."""
    e = T.number_set(expected)
    return F.when(F.size(e) > 0, F.round(F.size(F.array_intersect(e, T.number_set(answer))) / F.size(e), 6)).otherwise(F.lit(1.0))


def completeness(answer: Column, expected: Column) -> Column:
    """Share of the expected distinct words that the answer has; 1 if none is expected."""
    e = F.array_distinct(T.answer_words(expected))
    return F.when(F.size(e) > 0, F.round(F.size(F.array_intersect(e, T.answer_words(answer))) / F.size(e), 6)).otherwise(F.lit(1.0))


def set_scores(got: Column, truth: Column) -> tuple[Column, Column]:
    """(precision, recall) of two id sets; precision without got is 1 if nothing is true else 0, recall without truth is 1."""
    g, t = F.array_distinct(got), F.array_distinct(truth)
    both = F.size(F.array_intersect(g, t))
    p = F.when(F.size(g) > 0, F.round(both / F.size(g), 6)).otherwise(F.when(F.size(t) == 0, 1.0).otherwise(0.0))
    return p, F.when(F.size(t) > 0, F.round(both / F.size(t), 6)).otherwise(F.lit(1.0))


def sentence_support(answer: Column, context: Column) -> Column:
    """Share of the sentences of which at least 30% of the words of four letters or more are in the context; 0 without sentences."""
    words = T.answer_words(context)
    long = lambda s: F.array_distinct(F.filter(T.answer_words(s), lambda w: F.length(w) >= 4))
    s = T.sentences(answer)
    ok = F.filter(s, lambda x: (F.size(long(x)) > 0) & (F.size(F.array_intersect(long(x), words)) >= 0.3 * F.size(long(x))))
    return F.when(F.size(s) > 0, F.round(F.size(ok) / F.size(s), 6)).otherwise(F.lit(0.0))


def uncited_numbers(report: Column) -> Column:
    """Number of sentences that state a number and cite nothing."""
    return F.size(F.filter(T.sentences(report), lambda s: s.rlike("[0-9]") & ~s.rlike(r"\[[^\]]+\]")))


def agreement(pairs: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """One row: n, exact, within_one, mean absolute error, Pearson (1 if undefined), quadratic weighted kappa (1..5). Rows with a null side are left out."""
    p = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"), F.col(key).alias("k"))
    base = p.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("x") == F.col("y")).cast("int")), 6).alias("exact"), F.round(F.avg((F.abs(F.col("x") - F.col("y")) <= 1).cast("int")), 6).alias("within_one"),
        F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 6).alias("mae"), F.round(F.coalesce(F.when((F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0), F.corr("x", "y")), F.lit(1.0)), 6).alias("pearson"),
    )
    clamp = lambda c: F.greatest(F.lit(1), F.least(F.lit(5), F.round(c).cast("int")))
    cells = p.groupBy(clamp(F.col("x")).alias("i"), clamp(F.col("y")).alias("j")).agg(F.count(F.lit(1)).alias("c"))  # 25 rows at most
    ri = cells.groupBy("i").agg(F.sum("c").alias("ci"))
    rj = cells.groupBy("j").agg(F.sum("c").alias("cj"))
    seen = cells.agg(F.sum(F.col("c") * F.pow(F.col("i") - F.col("j"), 2)).alias("seen"), F.sum("c").alias("t"))
    chance = ri.join(F.broadcast(rj)).agg(F.sum(F.col("ci") * F.col("cj") * F.pow(F.col("i") - F.col("j"), 2)).alias("chance"))
    kappa = seen.join(F.broadcast(chance)).select(F.round(F.when(F.col("chance") > 0, 1.0 - F.col("seen") * F.col("t") / F.col("chance")).otherwise(1.0), 6).alias("kappa"))
    return base.join(F.broadcast(kappa)).select("n", "exact", "within_one", "mae", "pearson", "kappa")


def spearman(pairs: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """One row: n, spearman by the closed form over ordinal ranks (ties by key). Ranks are taken in ranges, not in one task. Rows with a null side are left out."""
    p = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, a, b).withColumn("_all", F.lit(0))
    p = ranked(ranked(p, ["_all"], [a, key], "_ra"), ["_all"], [b, key], "_rb")
    n = F.count(F.lit(1)).cast("double")
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.when(n > 1, 1.0 - 6.0 * F.sum(F.pow(F.col("_ra") - F.col("_rb"), 2)) / (n * (n * n - 1.0))).otherwise(1.0), 6).alias("spearman"))


def mode_summary(rows: DataFrame, mode: str, values: list[str], latency: str) -> DataFrame:
    """(mode, rows, mean of each value, p50, p95 of latency by nearest rank from below)."""
    pct = lambda p: F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {latency})"), 6)
    return rows.groupBy(F.col(mode).alias("mode")).agg(F.count(F.lit(1)).alias("rows"), *[F.round(F.avg(v), 6).alias(f"mean_{v}") for v in values], pct(0.5).alias("p50"), pct(0.95).alias("p95"))


def abstention_scores(rows: DataFrame, abstained: Column, answerable: Column) -> DataFrame:
    """One row: rows, accuracy, precision, recall and F1 of abstaining; denominators are at least 0.001."""
    tp, fp, fn = F.count_if(abstained & ~answerable), F.count_if(abstained & answerable), F.count_if(~abstained & ~answerable)
    p, r = tp / F.greatest(tp + fp, F.lit(0.001)), tp / F.greatest(tp + fn, F.lit(0.001))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg((abstained != answerable).cast("int")), 6).alias("accuracy"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.greatest(p + r, F.lit(0.001)), 6).alias("f1"))


def stratified_split(rows: DataFrame, stratum: str, key: str, share: float = 0.7) -> DataFrame:
    """Adds part: dev for the first floor(n * share) keys of each stratum in key order, test for the rest. A stratum of any size is ranked in ranges."""
    sizes = rows.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    r = ranked(rows, [stratum], [key], "_rn")
    j = r.join(sizes, r[stratum].eqNullSafe(sizes["_s"]))
    return j.withColumn("part", F.when(F.col("_rn") <= F.floor(F.col("_n") * share), "dev").otherwise("test")).drop("_rn", "_n", "_s")


def blind_label(key: Column, seed: str, labels: str = "AB") -> Column:
    """A label by the digest of key and seed, the same in any order of rows."""
    n = F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(seed)), 256), 1, 8), 16, 10).cast("bigint")
    return F.substring(F.lit(labels), (F.pmod(n, F.lit(len(labels))) + 1).cast("int"), F.lit(1))


def regression_gate(current: DataFrame, baseline: DataFrame, key: str = "metric") -> DataFrame:
    """(metric, value, floor, passed): current value against baseline * (1 - tolerance); a missing value fails."""
    c = current.select(key, F.col("value").alias("_v"))
    f = F.round(F.col("value") * (1 - F.col("tolerance")), 6)
    return baseline.join(c, key, "left").select(key, F.col("_v").alias("value"), f.alias("floor"), F.coalesce(F.col("_v") >= f, F.lit(False)).alias("passed"))
