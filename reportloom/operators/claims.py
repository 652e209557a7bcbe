"""Claims against the evidence they cite and against what else is known of their company and year."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.operators.skew import salted_lookup


#: Chunks of a company and year that one task searches, about.
PART = 2000


def _holding(texts: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    """(company, year, value, n): how many of the texts hold each of the values."""
    import ahocorasick

    if not len(texts) or not len(values):
        return pd.DataFrame(columns=["company", "year", "value", "n"], dtype=object)
    found = ahocorasick.Automaton()
    for v in values["value"]:
        found.add_word(v, v)
    found.make_automaton()
    n = Counter(v for t in texts["text"] for v in {x for _, x in found.iter(t)})
    company, year = values["company"].iloc[0], values["year"].iloc[0]
    return pd.DataFrame([(company, year, v, k) for v, k in n.items()], columns=["company", "year", "value", "n"], dtype=object)


def check_claims(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """claims(claim_id, chunk_id, company, year, value, unit), each once, with outcome, status and the number of contradicting chunks.

    outcome is the first that holds: no_evidence, unknown_evidence, company_mismatch (neither part of the other), year_mismatch,
    value_mismatch and unit_mismatch (not in the chunk's text, in lower case), contradicted, verified. status is unsupported,
    contradicted or verified. What is null in a claim is not checked. A chunk contradicts a sound claim if it is another one of the same
    company and year that has a number but not the claim's value.

    Contradictions are counted without pairing claims and chunks: from the chunks with a number of a company and year, those that hold the
    value are taken. The values of a company and year are sought in its chunks all at once (Aho-Corasick), chunks in parts of about PART, so a
    company with a third of all chunks is spread over tasks, and the work is linear in the texts. Claims of one value share it.
    """
    k = chunks.where("chunk_id IS NOT NULL").groupBy(F.lower(F.trim("chunk_id")).alias("chunk_id")).agg(F.max("ticker").alias("_ticker"), F.max("company").alias("_company"), F.max("year").alias("_year"), T.lower_tr(F.max("text")).alias("_text"), F.lit(True).alias("_known"))
    c = salted_lookup(claims.distinct(), k, "chunk_id")
    text, named, short = F.coalesce("_text", F.lit("")), F.upper(F.coalesce("_company", F.lit(""))), F.upper(F.coalesce("_ticker", F.lit("")))
    apart = (F.col("company") != "") & ~(F.contains(named, F.col("company")) | F.contains(short, F.col("company")) | F.contains(F.col("company"), short))
    fault = (
        F.when(F.col("chunk_id").isNull(), "no_evidence").when(F.col("_known").isNull(), "unknown_evidence").when(apart, "company_mismatch").when(F.col("year") != F.col("_year"), "year_mismatch")
        .when(~F.contains(text, F.col("value")), "value_mismatch").when(~F.contains(text, F.col("unit")), "unit_mismatch")
    )
    c = c.withColumn("_fault", fault).drop("_ticker", "_company", "_year", "_text", "_known")
    numbers = k.where("_ticker IS NOT NULL AND _year IS NOT NULL").where(F.col("_text").rlike("[0-9]")).select(F.upper("_ticker").alias("company"), F.col("_year").alias("year"), F.col("_text").alias("text"))
    group = ["company", "year"]
    sizes = numbers.groupBy(*group).agg(F.count(F.lit(1)).alias("_all"))
    parts = sizes.select(*group, F.ceil(F.col("_all") / PART).cast("int").alias("_parts"))
    texts = numbers.join(parts, group).select(*group, F.pmod(F.xxhash64("text"), F.col("_parts")).cast("int").alias("part"), "text")
    values = c.where("_fault IS NULL AND value IS NOT NULL").select(*group, "value").distinct().join(parts, group)
    values = values.select(*group, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), "value")
    keys = [*group, "part"]
    found = texts.groupBy(*keys).cogroup(values.groupBy(*keys)).applyInPandas(_holding, "company string, year int, value string, n bigint")
    holding = found.groupBy(*group, "value").agg(F.sum("n").alias("_holding"))
    c = c.join(sizes, group, "left").join(holding, [*group, "value"], "left")
    against = F.when(F.col("_fault").isNull() & F.col("value").isNotNull(), F.coalesce("_all", F.lit(0)) - F.coalesce("_holding", F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    c = c.withColumn("contradicting", against)
    outcome = F.coalesce("_fault", F.when(F.col("contradicting") > 0, "contradicted").otherwise("verified"))
    status = F.when(F.col("_fault").isNotNull(), "unsupported").otherwise(F.when(F.col("contradicting") > 0, "contradicted").otherwise("verified"))
    return c.withColumns({"outcome": outcome, "status": status}).drop("_fault", "_all", "_holding")


def claim_summary(checked: DataFrame) -> DataFrame:
    """(outcome, claims, share)."""
    n = checked.groupBy("outcome").agg(F.count(F.lit(1)).alias("claims"))
    return n.select("outcome", "claims", F.round(F.col("claims") / F.sum("claims").over(Window.partitionBy()), 6).alias("share"))  # eight outcomes at most
