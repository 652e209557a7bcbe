"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.session import table


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    from reportloom.llm.splitting import split_chunks

    return split_chunks(table(spark, sf, "chunks")).where("oversized").distinct()


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_pieces(spark, sf).select("chunk_id").distinct()


def p2_entities(spark: SparkSession, sf: str) -> DataFrame:
    from reportloom.llm.names import link_names

    return link_names(spark, table(spark, sf, "aliases"), table(spark, sf, "canonical_entities"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    from reportloom.llm.names import linked_pairs

    return linked_pairs(p2_entities(spark, sf))


def p4_languages(spark: SparkSession, sf: str) -> DataFrame:
    from reportloom.llm.languages import label_languages

    return label_languages(spark, table(spark, sf, "chunks"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from reportloom.llm.languages import label_languages, mislabelled

    return mislabelled(label_languages(spark, table(spark, sf, "chunks"), segments=False))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    from reportloom.llm.components import connected_groups

    return connected_groups(table(spark, sf, "resolution_decisions").where("merged"), "left_entity_id", "right_entity_id")


def p5_sizes(spark: SparkSession, sf: str) -> DataFrame:
    sizes = p5_found(spark, sf).groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))
    return sizes.groupBy("members").agg(F.count(F.lit(1)).alias("groups"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    from reportloom.llm.encoding import encode_corpus

    return encode_corpus(table(spark, sf, "documents"))


def _leaks(spark: SparkSession, sf: str, edited: bool = True) -> DataFrame:
    from reportloom.llm.leaks import find_leaks

    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), edited=edited)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    from reportloom.llm.leaks import RUN

    return _leaks(spark, sf, edited=False).where(F.col("longest_run") >= RUN).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    from reportloom.llm.leaks import MIN_SCORE

    return _leaks(spark, sf).where(F.col("score") >= MIN_SCORE)


def _truncated(spark: SparkSession, sf: str) -> DataFrame:
    from reportloom.llm.truncation import find_truncated

    return find_truncated(table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _truncated(spark, sf).where("truncated").select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    from reportloom.llm.truncation import truncation_rates

    return truncation_rates(_truncated(spark, sf))


def queries():
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


_GROUPS = """
WITH RECURSIVE e AS (
  SELECT DISTINCT left_entity_id AS a, right_entity_id AS b FROM resolution_decisions WHERE merged AND left_entity_id <> right_entity_id
  UNION SELECT DISTINCT right_entity_id, left_entity_id FROM resolution_decisions WHERE merged AND left_entity_id <> right_entity_id),
r AS (SELECT a AS entity_id, a AS reached FROM e UNION SELECT r.entity_id, e.b FROM r JOIN e ON e.a = r.reached),
g AS (SELECT entity_id, min(reached) AS group_id FROM r GROUP BY 1)
"""
SQL = {
    "p1_found": r"SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 4000 OR floor(len(regexp_extract_all(text, '[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) * 1.3::DOUBLE) > 500",
    "p5_found": _GROUPS + "SELECT entity_id, group_id FROM g",
    "p5_sizes": _GROUPS + "SELECT members, count(*) AS groups FROM (SELECT group_id, count(*) AS members FROM g GROUP BY 1) GROUP BY 1",
}


def oracle_sql():
    return dict(SQL)
