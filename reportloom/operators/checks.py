"""Validation of records: shape, provenance, evidence, data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.operators.skew import salted_lookup

# Properties that an entity type must have, and the pattern its value must match.
PROPERTY_RULES = [
    ("Person", "name", True, r"\S"), ("Person", "company_id", True, "^company:[A-Z]{4,6}$"), ("FinancialMetric", "company_id", True, "^company:[A-Z]{4,6}$"),
    ("FinancialMetric", "date_id", True, r"^date:\d{4}(-Q[1-4]|-\d{2}(-\d{2})?)?$"), ("FinancialMetric", "scope", True, "^(CONSOLIDATED|STANDALONE)$"),
    ("FinancialMetric", "metric_key", True, r"\S"), ("Product", "name", True, r"\S"), ("Company", "name", True, r"\S"),
]


def property_violations(entities: DataFrame, rules: list[tuple[str, str, bool, str]] = PROPERTY_RULES) -> DataFrame:
    """(id, property, problem): missing_required or pattern of each broken rule; unknown types break none. Repeated rows count once."""
    spark = entities.sparkSession
    r = F.broadcast(spark.createDataFrame([(a, b, c, d) for a, b, c, d in rules], "type string, property string, required boolean, pattern string"))
    v = F.try_element_at("properties", F.col("property"))
    e = entities.select("id", "type", "properties").join(r, "type")
    problem = F.when(F.coalesce(F.trim(v), F.lit("")) == "", F.when(F.col("required"), "missing_required")).when(~F.regexp(v, F.col("pattern")), "pattern")
    return e.select("id", "property", problem.alias("problem")).where("problem IS NOT NULL").distinct()


def candidate_shape(page: Column, confidence: Column, name: Column, evidence: Column) -> Column:
    """The first reason against a candidate record, or null: blank_name, blank_evidence, page, confidence."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(blank(name), "blank_name").when(blank(evidence), "blank_evidence").when(~F.coalesce(page >= 1, F.lit(False)), "page").when(~F.coalesce((confidence >= 0) & (confidence <= 1), F.lit(False)), "confidence")


def evidence_state(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, state) of each distinct entity row: contained, not_contained, or no_chunk; and (same_file, same_page) against the chunk.

    A chunk that occurs with several texts contains evidence if any of them does. Chunks cited by a third of the rows are split by salts.
    """
    e = entities.select("id", "source_chunk_id", "evidence_text", "source_file", "page_number").distinct().withColumn("_k", F.lower(T.strip("source_chunk_id")))
    c = chunks.groupBy(F.lower(T.strip("chunk_id")).alias("_k")).agg(F.max("text").alias("_text"), F.max("source_file").alias("_file"), F.max("page_number").alias("_page"))
    j = salted_lookup(e, c, "_k")
    inside = F.contains("_text", F.col("evidence_text"))
    state = F.when(F.col("_text").isNull(), "no_chunk").when(inside, "contained").otherwise("not_contained")
    plain = F.regexp_replace("source_file", "^.*[:/]", "")
    return j.select("id", state.alias("state"), plain.eqNullSafe(F.col("_file")).alias("same_file"), F.col("page_number").eqNullSafe(F.col("_page")).alias("same_page"))


def document_status(text: Column, company: Column, year: Column, least: int = 200) -> Column:
    """struct(status, reason): quarantined (empty, too_short), suspect (company or year not in the text) or verified."""
    t = F.coalesce(text, F.lit(""))
    reason = F.when(F.trim(t) == "", "empty").when(F.length(t) < least, "too_short").when(~F.coalesce(F.contains(T.fold_letters(t), T.fold_letters(company)), F.lit(False)), "company_not_found").when(~F.coalesce(F.contains(t, year.cast("string")), F.lit(False)), "year_not_found")
    return F.struct(F.when(reason.isin("empty", "too_short"), "quarantined").when(reason.isNotNull(), "suspect").otherwise("verified").alias("status"), reason.alias("reason"))


def dataset_report(samples: DataFrame) -> DataFrame:
    """One row: samples, duplicate questions (without case and blanks), answerable samples without answer, source or pages, and ungrounded ones."""
    q = T.lower_tr(T.one_blank("question"))
    no = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    a = F.coalesce("answerable", F.lit(False))
    return samples.agg(
        F.count(F.lit(1)).alias("samples"), (F.count(q) - F.count_distinct(q)).alias("duplicate_questions"), F.count_if(a & blank("expected_answer")).alias("no_answer"),
        F.count_if(a & blank("source_file")).alias("no_source"), F.count_if(a & no("source_pages")).alias("no_pages"), F.count_if(a & (blank("expected_answer") | blank("source_file") | no("source_pages"))).alias("ungrounded"),
    )
