"""Acceptance of extracted candidates: JSON text of a provider becomes entities, relations and rejections.

A provider is any function from a column of chunk texts to a column of JSON texts with two lists, entities and
relations; `with_provider` applies one as an Arrow-batched function.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from reportloom.functions import text as T
from reportloom.operators.checks import PROPERTY_RULES
from reportloom.operators.graph import EDGE_RULES
from reportloom.operators.skew import salted_lookup

# The node types.
NODE_TYPES = ["Company", "Report", "Chunk", "Person", "Product", "Sector", "FinancialMetric", "Event", "Date"]
_PROOF = "properties: map<string,string>, source_chunk_id: string, source_file: string, page_number: int, evidence_text: string, confidence: double"
ENTITY = f"ref: string, type: string, canonical_name: string, {_PROOF}"
RELATION = f"type: string, source_ref: string, target_ref: string, {_PROOF}"
RESPONSE = f"entities array<struct<{ENTITY}>>, relations array<struct<{RELATION}>>"


def with_provider(chunks: DataFrame, provider: Callable[[pd.Series], pd.Series], text: str = "text") -> DataFrame:
    """Adds response, what the provider returns for each batch of texts, and error, the message of the exception that it raised for a text.

    A batch that fails is asked again text by text, so one bad text costs no other its response; a failed text has a null response. If that
    is not wanted, the provider's own retries are its own matter.
    """

    def ask(batch: pd.Series) -> pd.DataFrame:
        try:
            got, failed = list(provider(batch)), [None] * len(batch)
        except Exception:  # noqa: BLE001  whatever a provider raises is its answer
            got, failed = [], []
            for i in range(len(batch)):
                try:
                    got.append(provider(batch.iloc[i : i + 1]).iloc[0])
                    failed.append(None)
                except Exception as err:  # noqa: BLE001
                    got.append(None)
                    failed.append(f"{type(err).__name__}: {err}"[:500])
        return pd.DataFrame({"response": pd.Series(got, dtype=object), "error": pd.Series(failed, dtype=object)})

    return chunks.withColumn("_p", F.pandas_udf(ask, "response string, error string")(F.col(text))).select(*chunks.columns, "_p.response", "_p.error")


def uncached(chunks: DataFrame, cache: DataFrame, text: str, version: str) -> DataFrame:
    """The chunks, with their fingerprint, that no row of cache(fingerprint, ..) answers: what a resumed run still has to ask for."""
    return chunks.withColumn("fingerprint", fingerprint(F.col(text), version)).join(cache.select("fingerprint").distinct(), "fingerprint", "left_anti")


def fingerprint(text: Column, version: str) -> Column:
    """Key of a cached result: the chunk's text and the versions it was made with."""
    return F.sha2(F.concat_ws("|", F.coalesce(text, F.lit("")), F.lit(version)), 256)


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _badly_shaped(c: str, names: list[str]) -> Column:
    bad = ~F.coalesce(F.col(f"{c}.page_number") >= 1, F.lit(False)) | ~F.coalesce(F.col(f"{c}.confidence").between(0, 1), F.lit(False))
    for n in (*names, "source_chunk_id", "source_file", "evidence_text"):
        bad = bad | _blank(F.col(f"{c}.{n}"))
    return bad


def _elsewhere(c: str) -> Column:
    return ~(F.col(f"{c}.source_chunk_id").eqNullSafe(F.col("chunk_id")) & F.col(f"{c}.source_file").eqNullSafe(F.col("_file")) & F.col(f"{c}.page_number").eqNullSafe(F.col("_page")))


def accept(responses: DataFrame, chunks: DataFrame, version: str = "v1") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, rejections) of responses(response_id, chunk_id, response).

    A candidate is rejected for the first of: its shape, a ref used before in the response, an unknown type, provenance
    other than the chunk's, evidence that isn't part of the chunk's text, references to no accepted entity, properties or
    ends that the ontology forbids. A response with an error (column error, if there is one) is a PROVIDER_ERROR. A response that is no JSON, or lacks a list, is rejected as a whole; one of an unknown
    chunk has no text, so its candidates fail on provenance. Null responses count as no JSON; repeated responses repeat.
    """
    c = chunks.groupBy("chunk_id").agg(F.max("text").alias("_text"), F.max("source_file").alias("_file"), F.max("page_number").alias("_page"))
    failed = F.col("error").isNotNull() if "error" in responses.columns else F.lit(False)
    r = responses.select("response_id", "chunk_id", "response", failed.alias("_failed"), F.try_parse_json(F.coalesce("response", F.lit("?"))).isNotNull().alias("_json"), F.from_json("response", RESPONSE).alias("_r"))
    whole = F.when(F.col("_failed"), "PROVIDER_ERROR").when(~F.col("_json"), "LLM_JSON_INVALID").when(F.col("_r.entities").isNull() | F.col("_r.relations").isNull(), "LLM_SHAPE_INVALID")
    r = salted_lookup(r.withColumn("reason_code", whole), c, "chunk_id")
    bad = r.where("reason_code IS NOT NULL").select("response_id", "chunk_id", F.lit("chunk").alias("record_kind"), F.lit(None).cast("int").alias("candidate_index"), "reason_code")
    r = r.where("reason_code IS NULL").drop("reason_code", "response", "_json", "_failed")

    e = r.select("*", F.posexplode("_r.entities").alias("i", "e"))
    before = F.array_position(F.transform("_r.entities", lambda x: x["ref"]), F.col("e.ref")) < F.col("i") + 1
    broken = F.lit(False)
    for kind, prop, required, pattern in PROPERTY_RULES:
        v = F.try_element_at("e.properties", F.lit(prop))
        broken = broken | ((F.col("e.type") == kind) & F.when(_blank(v), F.lit(required)).otherwise(~v.rlike(pattern)))
    why = (
        F.when(_badly_shaped("e", ["ref", "type", "canonical_name"]), "ENTITY_MODEL_INVALID").when(before, "DUPLICATE_REF").when(~F.col("e.type").isin(NODE_TYPES), "UNKNOWN_NODE_TYPE")
        .when(_elsewhere("e"), "PROVENANCE_MISMATCH").when(~F.coalesce(F.contains("_text", F.col("e.evidence_text")), F.lit(False)), "EVIDENCE_NOT_IN_CHUNK").when(broken, "SCHEMA_VALIDATION_FAILED")
    )
    e = e.withColumn("reason_code", why)
    node = F.concat(F.lower("e.type"), F.lit(":"), T.stable_digest([F.col("e.type"), T.ascii_key("e.canonical_name"), F.try_element_at("e.properties", F.lit("company_id"))]))
    good = e.where("reason_code IS NULL").select("response_id", "chunk_id", "e.ref", node.alias("id"), "e.type", "e.canonical_name", "e.properties", "e.evidence_text", "e.page_number", "e.confidence", F.lit(version).alias("extraction_version"))

    q = r.select("*", F.posexplode("_r.relations").alias("i", "e"))
    end = lambda side: good.groupBy("response_id", F.col("ref").alias(f"_{side}ref")).agg(F.min("id").alias(f"{side}_entity_id"), F.min("type").alias(f"_{side}type"))
    q = q.withColumn("_sourceref", F.col("e.source_ref")).withColumn("_targetref", F.col("e.target_ref"))
    q = q.join(end("source"), ["response_id", "_sourceref"], "left").join(end("target"), ["response_id", "_targetref"], "left")
    fits = F.lit(False)
    for kind, s, t in EDGE_RULES:
        fits = fits | ((F.col("e.type") == kind) & (F.col("_sourcetype") == s) & (F.col("_targettype") == t))
    why = (
        F.when(_badly_shaped("e", ["type", "source_ref", "target_ref"]), "RELATION_MODEL_INVALID").when(~F.col("e.type").isin([k for k, _, _ in EDGE_RULES]), "UNKNOWN_RELATION_TYPE")
        .when(_elsewhere("e"), "PROVENANCE_MISMATCH").when(~F.coalesce(F.contains("_text", F.col("e.evidence_text")), F.lit(False)), "EVIDENCE_NOT_IN_CHUNK")
        .when(F.col("source_entity_id").isNull() | F.col("target_entity_id").isNull(), "ENTITY_REFERENCE_NOT_FOUND").when(~F.coalesce(fits, F.lit(False)), "SCHEMA_VALIDATION_FAILED")
    )
    q = q.withColumn("reason_code", why)
    rel = q.where("reason_code IS NULL").select("response_id", "chunk_id", T.stable_digest([F.col("e.type"), F.col("source_entity_id"), F.col("target_entity_id")]).alias("id"), "e.type", "source_entity_id", "target_entity_id", "e.evidence_text", "e.page_number", "e.confidence", F.lit(version).alias("extraction_version"))
    no = lambda df, kind: df.where("reason_code IS NOT NULL").select("response_id", "chunk_id", F.lit(kind).alias("record_kind"), F.col("i").alias("candidate_index"), "reason_code")
    return good, rel, bad.unionByName(no(e, "entity")).unionByName(no(q, "relation"))
