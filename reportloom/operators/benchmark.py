"""Benchmark of retrieval and answers: ranked hits, scores per sample, summaries by mode, failures, judge ratings, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.operators import evals as E

# Parts of a method's overall score.
OVERALL = {"mrr": 0.3, "token_f1": 0.3, "citation_precision": 0.2, "path_recall": 0.2}
# What a calibrated judge must reach.
PASS_AGREEMENT, WITHIN_KAPPA, LEAST_RHO, MOST_FALSE = 0.8, 0.6, 0.7, 0.15
# Words that say nothing of a sentence's support.
EMPTY_WORDS = ["sora", "göre", "tarafından", "olup", "ile"]
CITED = r"(?i)\[(?:source\s*)?\d+\]"
CUT_OFFS = (1, 3, 5, 10)


def top_ranked(rows: DataFrame, query: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each query with their rank. Each task keeps k rows of a query before the shuffle (Spark limits row_number's groups)."""
    w = Window.partitionBy(query).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lineage_recall(got: Column, expected: Column) -> Column:
    """Share of the expected distinct items among those got, without case; 1 if none is expected."""
    low = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x.cast("string"))))
    e = low(expected)
    return F.when(F.size(e) > 0, F.round(F.size(F.array_intersect(e, low(got))) / F.size(e), 6)).otherwise(F.lit(1.0))


def path_recall(paths: Column, expected: Column) -> Column:
    """Share of the expected paths that are part of a retrieved one, or of all joined by blanks, without case; 1 if none is expected, 0 without paths."""
    joined = F.lower(F.array_join(paths, " "))
    hits = F.size(F.filter(expected, lambda x: F.contains(joined, F.lower(x))))
    return F.when(F.coalesce(F.size(expected), F.lit(0)) <= 0, 1.0).when(F.coalesce(F.size(paths), F.lit(0)) <= 0, 0.0).otherwise(F.round(hits / F.size(expected), 6))


def score_samples(results: DataFrame) -> DataFrame:
    """Adds the metrics of one sample under one mode to rows with got and truth (chunk ids), sources, pages and entities got, and those expected (with prefix e_)."""
    g, t = F.col("got"), F.col("truth")
    m = {f"recall_{k}": E.recall_at(g, t, k) for k in CUT_OFFS} | {f"precision_{k}": E.precision_at(g, t, k) for k in CUT_OFFS}
    m |= {"mrr": E.reciprocal_rank(g, t), "ndcg_5": E.ndcg_at(g, t, 5), "ndcg_10": E.ndcg_at(g, t, 10), "chunk_recall": lineage_recall(g, t)}
    m |= {"source_recall": lineage_recall(F.col("sources"), F.col("e_sources")), "page_recall": lineage_recall(F.col("pages"), F.col("e_pages"))}
    m |= {"entity_recall": lineage_recall(F.col("entities"), F.col("e_entities")), "relation_recall": lineage_recall(F.col("relations"), F.col("e_relations")), "path_recall": path_recall(F.col("entities"), F.col("e_entities"))}
    return results.withColumns(m)


METRICS = [f"{m}_{k}" for m in ("recall", "precision") for k in CUT_OFFS] + "mrr ndcg_5 ndcg_10 chunk_recall source_recall page_recall entity_recall relation_recall path_recall".split()


def summarise(scored: DataFrame, by: list[str], metrics: list[str], latency: str | None = None) -> DataFrame:
    """(by.., samples, mean of each metric to four places, and of `latency` mean, p50 and p95 by nearest rank)."""
    pct = lambda p, out: F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {latency})"), 2).alias(out)
    more = [pct(0.5, "latency_p50"), pct(0.95, "latency_p95"), F.round(F.avg(latency), 2).alias("mean_latency")] if latency else []
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), *[F.round(F.avg(m), 4).alias(f"mean_{m}") for m in metrics], *more)


def failure_examples(scored: DataFrame, order: list[str], most: int = 15) -> DataFrame:
    """The first `most` samples that no hit of the first five answers, with the reason: source_missed or chunk_missed. A top-k report."""
    failed = scored.where((F.col("recall_5") == 0) & (F.size("truth") > 0))
    return failed.withColumn("reason", F.when(F.col("source_recall") < 0.5, "source_missed").otherwise("chunk_missed")).orderBy(*order).limit(most)


def overall_score(parts: dict[str, Column]) -> Column:
    return F.round(sum((w * parts[k] for k, w in OVERALL.items()), F.lit(0.0)), 4)


def hit_quality(first: Column, hits: Column, company_ok: Column, year_ok: Column, valid: Column, answerable: Column) -> list[Column]:
    """Aggregates over questions: hit@1, @3, @5, MRR, shares of questions whose best hit is of the company and year, valid ones, and whether the targets are met."""
    rate = lambda c: F.round(F.avg(F.when(answerable, F.coalesce(c, F.lit(False)).cast("int"))), 6)
    at = lambda k: rate(F.coalesce(first <= k, F.lit(False)))
    return [
        F.count(F.lit(1)).alias("questions"), *[at(k).alias(f"hit_{k}") for k in (1, 3, 5)], F.round(F.avg(F.when(answerable, F.coalesce(1.0 / first, F.lit(0.0)))), 6).alias("mrr"),
        rate(company_ok).alias("company_match"), rate(year_ok).alias("year_match"), F.round(F.avg(valid.cast("int")), 6).alias("valid"), F.round(F.avg(hits), 6).alias("mean_hits"), ((at(3) >= 0.8) & (rate(company_ok) >= 0.9)).alias("targets_met"),
    ]


def citation_coverage(cited: Column, claims: Column) -> Column:
    """Citations per claim, 1 at most; 1 without claims."""
    return F.when(claims <= 0, 1.0).otherwise(F.round(F.least(F.lit(1.0), F.size(cited) / claims), 6))


def page_accuracy(cited: Column, expected: Column) -> Column:
    """Share of the cited pages that are expected; 1 if none is expected, 0 if none is cited."""
    hits = F.size(F.filter(cited, lambda p: F.array_contains(expected, p)))
    return F.when(F.coalesce(F.size(expected), F.lit(0)) <= 0, 1.0).when(F.coalesce(F.size(cited), F.lit(0)) <= 0, 0.0).otherwise(F.round(hits / F.size(cited), 6))


def cited_support(answer: Column, context: Column) -> Column:
    """struct(sentences, cited, supported, support, coverage): sentences with a citation whose words of four letters or more occur to 30 % at least in the context.

    A cited sentence without such words counts as supported; support is 1 if nothing is cited, 0 without sentences.
    """
    s = T.sentences(answer)
    cited = F.filter(s, lambda x: x.rlike(CITED))
    text = T.lower_tr(F.coalesce(context, F.lit("")))
    plain = lambda x: F.regexp_replace(x, r"\[[^\]]*\]", "")
    words = lambda x: F.filter(T.answer_words(plain(x)), lambda w: (F.length(w) >= 4) & ~w.isin(EMPTY_WORDS))
    good = F.filter(cited, lambda x: (F.size(words(x)) == 0) | (F.size(F.filter(words(x), lambda w: F.contains(text, w))) >= 0.3 * F.size(words(x))))
    support = F.when(F.size(s) == 0, 0.0).when(F.size(cited) == 0, 1.0).otherwise(F.round(F.size(good) / F.size(cited), 6))
    return F.struct(F.size(s).alias("sentences"), F.size(cited).alias("cited"), F.size(good).alias("supported"), support.alias("support"), F.when(F.size(s) == 0, 0.0).otherwise(F.round(F.size(cited) / F.size(s), 6)).alias("coverage"))


def confusion(pairs: DataFrame, passed: Column, judged: Column) -> DataFrame:
    """One row: tp, fp, tn, fn, accuracy, precision, recall, f1 (1 where undefined), accepted: whether agreement and false passes are as a judge must have them."""
    n = pairs.agg(F.count_if(passed & judged).alias("tp"), F.count_if(~passed & judged).alias("fp"), F.count_if(~passed & ~judged).alias("tn"), F.count_if(passed & ~judged).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    p, r = share(tp, tp + fp), share(tp, tp + fn)
    acc, f1 = share(tp + tn, tp + fp + tn + fn), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(1.0)
    false = F.when(fp + tn > 0, fp / (fp + tn)).otherwise(0.0)
    return n.select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(k) for k, c in (("accuracy", acc), ("precision", p), ("recall", r), ("f1", f1), ("false_pass_rate", false))], ((acc >= PASS_AGREEMENT) & (false <= MOST_FALSE)).alias("accepted"))


# Ratings of an answer that the rule takes for sound, and of another.
SOUND = {"correctness": 4.5, "completeness": 4.0, "faithfulness": 5.0, "relevance": 4.5, "citation_support": 4.5}
POOR = {"correctness": 2.0, "completeness": 2.0, "faithfulness": 3.0, "relevance": 2.0, "citation_support": 2.0}
REFUSAL = "yeterli kanıt bulunamadı"


def judge_key(question: Column, expected: Column, answer: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (question, expected, answer)]), 256)


def judge(answers: DataFrame, cache: DataFrame) -> DataFrame:
    """answers(key, answer, ..) with ratings and judge_cached: from cache(key, ratings..), one row per key, else by rule.

    The rule takes a refusal, or an answer of more than ten characters, for sound. Null answers are poor.
    """
    a = F.coalesce("answer", F.lit(""))
    sound = F.contains(T.lower_tr(a), F.lit(REFUSAL)) | (F.length(a) > 10)
    c = cache.groupBy("key").agg(*[F.max(k).alias(f"_{k}") for k in SOUND])
    j = answers.join(c, "key", "left")
    return j.select(*answers.columns, *[F.coalesce(f"_{k}", F.when(sound, SOUND[k]).otherwise(POOR[k])).alias(k) for k in SOUND], F.col("_correctness").isNotNull().alias("judge_cached"))
