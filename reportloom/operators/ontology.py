"""The ontology of the report graph as rules: properties of node types, ends of edge types, recipes of ids; and checks by them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.functions import text as T

# Node type, property, value type, required or optional; then a pattern the whole value must match (~), the allowed values (=), or least and most.
PROPERTIES = r"""
Company id STRING required ~^company:[A-Z0-9._-]+$
Company name STRING required
Company ticker STRING required ~^[A-Z0-9._-]{2,12}$
Company legal_name STRING optional
Company aliases STRING_LIST optional
Company country STRING optional
Company website STRING optional
Company source_report_id STRING optional
Company source_chunk_id STRING optional
Company source_page INTEGER optional 1
Report id STRING required ~^report:[A-Z0-9._-]+__\d{4}__[a-z0-9_]+__[a-z]{2}(-[A-Z]{2})?$
Report document_id STRING required
Report ticker STRING required ~^[A-Z0-9._-]{2,12}$
Report year INTEGER required 1900 2100
Report report_type STRING required =annual_report,integrated_report,sustainability_report,investor_presentation,financial_statement
Report language STRING required ~^[a-z]{2}(-[A-Z]{2})?$
Report source_file STRING required
Report sha256 STRING required ~^[0-9a-f]{64}$
Report source_url STRING optional
Report source_domain STRING optional
Report total_pages INTEGER optional 1
Report validation_status STRING optional =verified,pending,quarantined
Chunk id STRING required ~^chunk:[0-9a-f]{16}$
Chunk chunk_id STRING required ~^[0-9a-f]{16}$
Chunk report_id STRING required ~^report:.+$
Chunk document_id STRING required
Chunk source_file STRING required
Chunk page_number INTEGER required 1
Chunk chunk_index INTEGER required 0
Chunk company STRING optional
Chunk ticker STRING optional
Chunk year INTEGER optional 1900 2100
Chunk report_type STRING optional
Chunk language STRING optional
Chunk token_count INTEGER optional 0
Chunk text STRING optional
Person id STRING required ~^person:[A-Z0-9._-]+:[a-z0-9_]+$
Person name STRING required
Person normalized_name STRING required ~^[a-z0-9_]+$
Person company_id STRING required ~^company:.+$
Person source_report_id STRING required
Person source_chunk_id STRING required
Person source_page INTEGER required 1
Person aliases STRING_LIST optional
Product id STRING required ~^product:[A-Z0-9._-]+:[a-z0-9_]+$
Product name STRING required
Product normalized_name STRING required ~^[a-z0-9_]+$
Product company_id STRING required ~^company:.+$
Product source_report_id STRING required
Product source_chunk_id STRING required
Product source_page INTEGER required 1
Product category STRING optional
Product description STRING optional
Product brand STRING optional
Sector id STRING required ~^sector:[a-z0-9_]+$
Sector name STRING required
Sector normalized_name STRING required ~^[a-z0-9_]+$
Sector classification_system STRING optional
Sector classification_code STRING optional
Sector source_report_id STRING optional
Sector source_chunk_id STRING optional
Sector source_page INTEGER optional 1
FinancialMetric id STRING required ~^metric:[A-Z0-9._-]+:[0-9a-f]{24}$
FinancialMetric metric_key STRING required ~^[a-z0-9_]+$
FinancialMetric name STRING required
FinancialMetric value FLOAT required
FinancialMetric unit STRING required
FinancialMetric company_id STRING required ~^company:.+$
FinancialMetric date_id STRING required ~^date:.+$
FinancialMetric scope STRING required =CONSOLIDATED,STANDALONE,SEGMENT
FinancialMetric source_report_id STRING required
FinancialMetric source_chunk_id STRING required
FinancialMetric source_page INTEGER required 1
FinancialMetric reported_value STRING optional
FinancialMetric scale INTEGER optional 1
FinancialMetric statement STRING optional
FinancialMetric notes STRING optional
FinancialMetric confidence FLOAT optional 0 1
Event id STRING required ~^event:[A-Z0-9._-]+:[0-9a-f]{24}$
Event title STRING required
Event normalized_title STRING required ~^[a-z0-9_]+$
Event event_type STRING required =MILESTONE,LAUNCH,INVESTMENT,TRANSACTION,AWARD,APPOINTMENT,OTHER
Event company_id STRING required ~^company:.+$
Event date_id STRING required ~^date:.+$
Event source_report_id STRING required
Event source_chunk_id STRING required
Event source_page INTEGER required 1
Event description STRING optional
Event status STRING optional
Event confidence FLOAT optional 0 1
Date id STRING required ~^date:\d{4}(-Q[1-4]|-\d{2}(-\d{2})?)?$
Date value STRING required ~^\d{4}(-Q[1-4]|-\d{2}(-\d{2})?)?$
Date granularity STRING required =YEAR,QUARTER,MONTH,DAY
Date start_date STRING optional ~^\d{4}-\d{2}-\d{2}$
Date end_date STRING optional ~^\d{4}-\d{2}-\d{2}$
Date fiscal_year INTEGER optional 1900 2100
Date quarter INTEGER optional 1 4
"""
# Edge type, labels of its source, label of its target.
EDGES = """
PUBLISHED Company Report
HAS_CHUNK Report Chunk
COVERS_DATE Report Date
OPERATES_IN Company Sector
OFFERS Company Product
HOLDS_ROLE_AT Person Company
REPORTED_METRIC Company FinancialMetric
CONTAINS_METRIC Report FinancialMetric
FOR_DATE FinancialMetric Date
EXPERIENCED Company Event
DESCRIBES_EVENT Report Event
OCCURRED_ON Event Date
OWNS Company Company
EVIDENCED_BY Person,Product,Sector,FinancialMetric,Event Chunk
"""
# Node type, pattern of its id, and what is digested where the pattern says {sha256}.
IDS = """
Company company:{TICKER}
Report report:{document_id}
Chunk chunk:{chunk_id}
Person person:{TICKER}:{normalized_name}
Product product:{TICKER}:{normalized_name}
Sector sector:{normalized_name}
FinancialMetric metric:{TICKER}:{sha256} company_id,metric_key,date_id,scope,source_report_id
Event event:{TICKER}:{sha256} company_id,date_id,normalized_title,source_report_id
Date date:{value}
"""
RULE = "type string, property string, kind string, required boolean, pattern string, allowed array<string>, least double, most double"
#: A text as a value of a type; a list is text in brackets.
KINDS = {"STRING": r"(?s).*", "INTEGER": r"[+-]?\d+", "FLOAT": r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", "BOOLEAN": "true|false", "STRING_LIST": r"(?s)\[.*\]"}


def property_rules(text: str = PROPERTIES) -> list[tuple]:
    """Rows of RULE from lines as in PROPERTIES."""
    out = []
    for line in text.strip().splitlines():
        owner, prop, kind, need, *more = line.split(" ")
        pattern = next((m[1:] for m in more if m[0] == "~"), None)
        allowed = next((m[1:].split(",") for m in more if m[0] == "="), None)
        bounds = [float(m) for m in more if m[0] not in "~="]
        out.append((owner, prop, kind, need == "required", pattern, allowed, bounds[0] if bounds else None, bounds[1] if len(bounds) > 1 else None))
    return out


def edge_rules(text: str = EDGES) -> list[tuple[str, str, str]]:
    """(edge type, source label, target label), a row for each source label."""
    return [(kind, s, target) for kind, sources, target in map(str.split, text.strip().splitlines()) for s in sources.split(",")]


def id_recipes(text: str = IDS) -> dict[str, tuple[str, list[str]]]:
    """Pattern and digested properties by node type."""
    return {p[0]: (p[1], p[2].split(",") if len(p) > 2 else []) for p in map(str.split, text.strip().splitlines())}


def property_problems(nodes: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """(id, property, problem) of nodes(id, type, properties): each rule of its type that a node breaks, once.

    problem is unknown_type (property null), missing_required, unknown_property, type, blank, pattern, allowed, minimum or maximum; the
    first of these for a property. Properties are texts; a null value counts as missing, null properties as empty. A null type is unknown.
    Repeated rows count once; no rows give none. The rules are the caller's list, so their table is small and broadcast.
    """
    r = nodes.sparkSession.createDataFrame(property_rules() if rules is None else rules, RULE)
    known = F.broadcast(r.select("type").distinct().withColumn("_known", F.lit(True)))
    n = nodes.select("id", "type", F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull()).alias("p")).join(known, "type", "left")
    stranger = n.where("_known IS NULL").select("id", F.lit(None).cast("string").alias("property"), F.lit("unknown_type").alias("problem"))
    need = F.broadcast(r.where("required").groupBy("type").agg(F.collect_list("property").alias("_need")))
    gone = n.join(need, "type").select("id", F.explode(F.array_except("_need", F.map_keys("p"))).alias("property"), F.lit("missing_required").alias("problem"))
    each = n.where("_known").select("id", "type", F.explode("p").alias("property", "v")).join(F.broadcast(r), ["type", "property"], "left")
    number, kind = F.col("v").try_cast("double"), F.col("kind")
    fits = F.coalesce(*[F.when(kind == k, F.regexp_like("v", F.lit(f"^(?:{p})$"))) for k, p in KINDS.items()])
    numeric = kind.isin("INTEGER", "FLOAT")
    problem = (
        F.when(kind.isNull(), "unknown_property").when(~fits, "type").when(F.trim("v") == "", "blank").when(~F.regexp_like("v", F.col("pattern")), "pattern")
        .when(~F.array_contains("allowed", F.col("v")), "allowed").when(numeric & (number < F.col("least")), "minimum").when(numeric & (number > F.col("most")), "maximum")
    )
    broken = each.select("id", "property", problem.alias("problem")).where("problem IS NOT NULL")
    return stranger.unionByName(gone).unionByName(broken).distinct()


def node_id(label: Column, properties: Column, length: int = 24) -> Column:
    """Id of a node by the recipe of its type; null if the type has none or an input is missing or empty.

    TICKER is the property ticker, else what follows company: in company_id; normalized_name is made from name if it is missing.
    """
    p = lambda k: F.nullif(F.try_element_at(properties, F.lit(k)), F.lit(""))
    value = {"TICKER": F.coalesce(p("ticker"), F.nullif(F.regexp_extract(p("company_id"), "^company:(.+)$", 1), F.lit("")))}
    value["normalized_name"] = F.coalesce(p("normalized_name"), F.nullif(T.ascii_key(p("name")), F.lit("")))
    cases = []
    for kind, (pattern, digested) in id_recipes().items():
        full = F.lit(True)
        for d in digested:
            full = full & p(d).isNotNull()
        value["sha256"] = F.when(full, T.stable_digest([p(d) for d in digested], length)) if digested else F.lit(None)
        parts = [F.lit(x) if i % 2 == 0 else value.get(x, p(x)) for i, x in enumerate(re.split(r"\{(\w+)\}", pattern)) if x]
        cases.append(F.when(label == kind, F.concat(*parts)))
    return F.coalesce(*cases)


def edge_properties_id(kind: Column, source: Column, target: Column, more: list[Column], length: int = 24) -> Column:
    """Id of an edge: the digest of its type, its ends and further properties, in the declared order."""
    return F.concat(F.lit("rel:"), T.stable_digest([kind, source, target, *more], length))


def ontology_problems(rules: list[tuple] | None = None, edges: list[tuple[str, str, str]] | None = None, ids: dict[str, tuple[str, list[str]]] | None = None) -> list[tuple[str, str, str]]:
    """(check, owner, what) of what is wrong with an ontology itself; empty if nothing is.

    declared_twice: a property of a type; key_not_required: a type whose id isn't a required property; undeclared_input: an id made
    from a property the type doesn't have; unknown_label: an edge whose end is no node type; bad_bounds: least above most.
    A check of the rules on the driver; they are a list, not data.
    """
    rules = property_rules() if rules is None else rules
    edges, ids = edge_rules() if edges is None else edges, id_recipes() if ids is None else ids
    names = [(r[0], r[1]) for r in rules]
    types, required = {t for t, _ in names}, {(r[0], r[1]) for r in rules if r[3]}
    out = [("declared_twice", *n) for n in sorted(set(names)) if names.count(n) > 1]
    out += [("key_not_required", t, "id") for t in sorted(types) if (t, "id") not in required]
    for t, (pattern, digested) in ids.items():
        for x in [*re.findall(r"\{(\w+)\}", pattern), *digested]:
            if x not in ("TICKER", "sha256") and (t, x) not in names:
                out.append(("undeclared_input", t, x))
    out += [("unknown_label", kind, end) for kind, *ends in edges for end in ends if end not in types]
    out += [("bad_bounds", r[0], r[1]) for r in rules if r[6] is not None and r[7] is not None and r[6] > r[7]]
    return sorted(set(out))
