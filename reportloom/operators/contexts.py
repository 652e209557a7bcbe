"""What a mention says about its entity, the comparison of two mentions by it, and the rows that record the outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.operators.ranking import jaccard
from reportloom.operators.resolve import components
from reportloom.operators.skew import salted_lookup

# Words of address that are left out of a person's name.
PERSON_TITLES = ["bay", "bayan", "doc", "docent", "dr", "mr", "mrs", "ms", "prof", "profesor", "sayin"]
# Names of sectors and metrics, as words without accents, and the key they stand for.
SECTOR_NAMES = {
    "savunma endustrisi": "savunma_sanayii", "savunma sanayi": "savunma_sanayii", "savunma sanayii": "savunma_sanayii", "defence industry": "savunma_sanayii", "defense industry": "savunma_sanayii",
    "telekom": "telekomunikasyon", "telecommunications": "telekomunikasyon", "telekomunikasyon": "telekomunikasyon", "otomotiv endustrisi": "otomotiv", "otomotiv sanayi": "otomotiv", "otomotiv sanayii": "otomotiv",
}
METRIC_NAMES = {
    "ciro": "total_revenue", "hasilat": "total_revenue", "net sales": "total_revenue", "revenue": "total_revenue", "satis gelirleri": "total_revenue", "toplam hasilat": "total_revenue",
    "donem net kari": "net_profit", "net income": "net_profit", "net kar": "net_profit", "net kari": "net_profit", "net profit": "net_profit", "ebitda": "ebitda", "favok": "ebitda",
    "toplam aktifler": "total_assets", "total assets": "total_assets",
}
#: Fields that two contexts are compared by.
FIELDS = ["company_id", "year", "report_id", "date_id", "scope", "unit"]
ACCEPTED = ["EXACT_MATCH", "HIGH_CONFIDENCE_MATCH"]


def renamed(key: Column, names: dict[str, str]) -> Column:
    """The key that names has for a key of ASCII words, else the key itself."""
    return F.coalesce(*[F.when(key == k.replace(" ", "_"), F.lit(v)) for k, v in names.items()], key)


def normal_name(kind: Column, name: Column, properties: Column) -> Column:
    """The name as its type compares it: ticker of a company, a person without titles, the key of a sector or metric, a date in capitals."""
    p = lambda k: F.nullif(F.trim(F.try_element_at(properties, F.lit(k))), F.lit(""))
    person = F.array_join(F.filter(F.split(T.ascii_key(name), "_"), lambda w: ~w.isin(PERSON_TITLES)), "_")
    return (
        F.when(kind == "Company", F.coalesce(F.upper(p("ticker")), T.ascii_key(name))).when(kind == "Person", person).when(kind == "Sector", renamed(T.ascii_key(name), SECTOR_NAMES))
        .when(kind == "FinancialMetric", renamed(T.ascii_key(F.coalesce(p("metric_key"), name)), METRIC_NAMES)).when(kind == "Date", F.trim(F.upper(F.coalesce(p("value"), name))))
        .when(kind == "Report", F.trim(F.coalesce(p("document_id"), name))).when(kind == "Chunk", F.trim(F.lower(F.coalesce(p("chunk_id"), name)))).when(kind == "Event", T.ascii_key(F.coalesce(p("title"), name)))
        .otherwise(T.ascii_key(name))
    )


def entity_contexts(entities: DataFrame, companies: DataFrame) -> DataFrame:
    """One row per id: type, name, norm, identity, company_id, year, report_id, date_id, scope, unit, value, class_code, codes, tokens.

    identity is a company's ticker in the registry `companies`: of its ticker, its company_id, its report, or a name that only one company
    has; null for other types. year is the first of 1900 to 2099 that stands by itself in date_id, report_id or file. codes are the
    digits in the name, tokens the words of the evidence. Of an id's rows each field is the least; null ids are left out.
    """
    p = lambda k: F.nullif(F.trim(F.try_element_at("properties", F.lit(k))), F.lit(""))
    stem = F.regexp_replace("source_file", r"^.*[:/]|\.pdf$", "")
    e = entities.where("id IS NOT NULL").select(
        "id", "type", F.col("canonical_name").alias("name"), normal_name(F.col("type"), F.col("canonical_name"), F.col("properties")).alias("norm"), p("ticker").alias("ticker"), p("company_id").alias("own"),
        F.coalesce(p("source_report_id"), F.concat(F.lit("report:"), stem)).alias("report_id"), p("date_id").alias("date_id"), F.upper(p("scope")).alias("scope"), F.upper(p("unit")).alias("unit"),
        p("value").try_cast("double").alias("value"), p("classification_code").alias("class_code"), F.col("source_file").alias("file"), F.col("evidence_text").alias("evidence"),
    )
    e = e.groupBy("id").agg(*[F.min(c).alias(c) for c in e.columns if c != "id"])
    of_report = F.nullif(F.upper(F.regexp_extract("report_id", "^report:(.*?)__", 1)), F.lit(""))
    year = lambda c: F.nullif(F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    company = F.coalesce("own", F.when(F.col("type") == "Company", F.concat(F.lit("company:"), F.upper("ticker"))), F.concat(F.lit("company:"), of_report))
    e = e.select(
        "id", "type", "name", "norm", company.alias("company_id"), F.coalesce(year("date_id"), year("report_id"), year("file")).cast("int").alias("year"), "report_id", "date_id", "scope", "unit", "value", "class_code",
        F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("name", F.lit("")), F.lit(r"\d+"), F.lit(0)))).alias("codes"),
        F.filter(F.array_distinct(F.split(T.ascii_key(F.coalesce("evidence", F.lit(""))), "_")), lambda w: w != "").alias("tokens"),
        F.when(F.col("type") == "Company", F.upper("ticker")).alias("_t1"), F.when(F.col("type") == "Company", F.upper(F.regexp_extract("own", "^company:(.*)$", 1))).alias("_t2"), F.when(F.col("type") == "Company", of_report).alias("_t3"),
        F.when(F.col("type") == "Company", T.ascii_key("name")).alias("_k"),
    )
    tickers = companies.select(F.upper("ticker").alias("t")).distinct()
    keys = companies.select(F.upper("ticker").alias("t"), F.explode(F.array(T.ascii_key("ticker"), T.ascii_key("company_name"), T.ascii_key("short_name"))).alias("_k")).distinct()
    for c in ("_t1", "_t2", "_t3"):
        e = e.join(tickers.select(F.col("t").alias(c), F.col("t").alias(f"_i{c}")), c, "left")
    e = e.join(keys.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.min("t").alias("_i_k")).where("_n = 1").drop("_n"), "_k", "left")
    return e.select("id", "type", "name", "norm", F.coalesce("_i_t1", "_i_t2", "_i_t3", "_i_k").alias("identity"), *FIELDS, "value", "class_code", "codes", "tokens")


def with_contexts(pairs: DataFrame, contexts: DataFrame) -> DataFrame:
    """pairs(a, b, ..) with the contexts of both ends as structs l and r; pairs without either are left out. Hot ends are split by salts."""
    side = lambda end, s: contexts.select(F.col("id").alias(end), F.struct(*[c for c in contexts.columns if c != "id"]).alias(s))
    return salted_lookup(salted_lookup(pairs, side("a", "l"), "a", "inner"), side("b", "r"), "b", "inner")


def compare_contexts(pairs: DataFrame) -> DataFrame:
    """Adds context_similarity (four places), signals and conflicts to pairs with l and r.

    0.8 times the share of equal fields among those both sides have, model codes included, and 0.2 times the Jaccard of the evidence's words.
    """
    l, r = F.col("l"), F.col("r")
    fields = [(f, l[f].isNotNull() & r[f].isNotNull(), l[f] == r[f]) for f in FIELDS] + [("model_codes", (F.size(l["codes"]) > 0) & (F.size(r["codes"]) > 0), l["codes"] == r["codes"])]
    both = sum((F.when(b, 1).otherwise(0) for _, b, _ in fields), F.lit(0))
    same = sum((F.when(b & s, 1).otherwise(0) for _, b, s in fields), F.lit(0))
    words = jaccard(l["tokens"], r["tokens"])
    list_of = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    return pairs.withColumns({
        "context_similarity": F.round(F.least(F.lit(1.0), 0.8 * F.when(both > 0, same / both).otherwise(0.0) + 0.2 * words), 4),
        "signals": list_of([*[F.when(b & s, F.lit(f"same_{f}")) for f, b, s in fields], F.when(words >= 0.25, F.lit("evidence_context_overlap"))]),
        "conflicts": list_of([F.when(b & ~s, F.lit(f"different_{f}")) for f, b, s in fields]),
    })


def values_match(a: Column, b: Column) -> Column:
    """Whether two numbers agree up to rounding; null if one is missing."""
    return F.abs(a - b) <= F.greatest(F.lit(1e-9), 1e-6 * F.greatest(F.abs(a), F.abs(b)))


def classify(kind: Column, l: Column, r: Column, similarity: Column) -> Column:
    """struct(match_class, rationale) of two mentions of one type, by the rules of that type.

    match_class is EXACT_MATCH, HIGH_CONFIDENCE_MATCH, REVIEW_REQUIRED or DIFFERENT_ENTITY; rationale a code for the rule that decided.
    """
    out = lambda c, why: F.struct(F.lit(c).alias("match_class"), F.lit(why).alias("rationale"))
    exact, high, review, other = (lambda why, c=c: out(c, why) for c in ("EXACT_MATCH", "HIGH_CONFIDENCE_MATCH", "REVIEW_REQUIRED", "DIFFERENT_ENTITY"))
    differ = lambda f: F.coalesce(l[f] != r[f], F.lit(False))
    alike = lambda f: l[f].eqNullSafe(r[f])
    same, s = F.coalesce(l["norm"] == r["norm"], F.lit(False)), similarity
    scoped = l["company_id"].isNotNull() & r["company_id"].isNotNull()
    coded = (F.size(l["codes"]) > 0) & (F.size(r["codes"]) > 0)
    company = (
        F.when(l["identity"].isNotNull() & r["identity"].isNotNull(), F.when(l["identity"] == r["identity"], exact("one_registered_company")).otherwise(other("two_registered_companies")))
        .when(same, review("same_name_unregistered")).when(s >= 0.92, review("similar_name_unregistered")).otherwise(other("names_differ"))
    )
    person = (
        F.when(differ("company_id"), other("other_company")).when(~scoped, F.when(s >= 0.78, review("no_company")).otherwise(other("names_differ"))).when(same, exact("same_name_and_company"))
        .when((s >= 0.86) & alike("report_id"), high("similar_name_in_report")).when((s >= 0.9) & alike("year"), high("similar_name_in_year")).when(s >= 0.78, review("similar_name")).otherwise(other("names_differ"))
    )
    product = (
        F.when(differ("company_id"), other("other_company")).when(coded & (l["codes"] != r["codes"]), other("other_model")).when(~scoped, F.when(s >= 0.75, review("no_company")).otherwise(other("names_differ")))
        .when(same, exact("same_name_and_company")).when((s >= 0.88) & (F.arrays_overlap(l["codes"], r["codes"]) | alike("report_id")), high("similar_name_same_model")).when(s >= 0.7, review("similar_name")).otherwise(other("names_differ"))
    )
    class_code = (l["class_code"] == r["class_code"])
    sector = F.when(~class_code, other("other_class_code")).when(same, exact("same_sector")).when((s >= 0.9) & class_code, high("similar_name_same_code")).when(s >= 0.75, review("similar_name")).otherwise(other("names_differ"))
    fit = values_match(l["value"], r["value"])
    clash = differ("company_id") | differ("date_id") | differ("scope") | differ("unit") | differ("report_id")
    metric = (
        F.when(clash, other("other_observation")).when(~same & (s < 0.85), other("names_differ")).when(~fit, review("values_differ")).when(same & fit, exact("same_observation"))
        .when(same, high("value_missing")).when((s >= 0.85) & fit, high("similar_name_same_value")).otherwise(review("similar_name"))
    )
    rest = F.when(differ("company_id"), other("other_company")).when(differ("date_id"), other("other_date")).when(same, exact("same_key")).when(s >= 0.85, review("similar_name")).otherwise(other("names_differ"))
    return F.when(kind == "Company", company).when(kind == "Person", person).when(kind == "Product", product).when(kind == "Sector", sector).when(kind == "FinancialMetric", metric).otherwise(rest)


def resolution_pairs(pairs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(a, b, type, name_similarity, context_similarity, signals, conflicts, match_class, rationale) of pairs(a, b, name_similarity); pairs across types are left out."""
    j = compare_contexts(with_contexts(pairs, contexts)).where("l.type = r.type")
    j = j.withColumn("_c", classify(F.col("l.type"), F.col("l"), F.col("r"), F.col("name_similarity")))
    return j.select("a", "b", F.col("l.type").alias("type"), "name_similarity", "context_similarity", "signals", "conflicts", "_c.match_class", "_c.rationale")


def _canonical(outcomes: DataFrame) -> DataFrame:
    """(id, canonical) of every id in accepted pairs; others are their own canonical id."""
    return components(outcomes.where(F.col("match_class").isin(ACCEPTED)), "a", "b").select("id", F.col("root").alias("canonical"))


def decision_rows(outcomes: DataFrame, version: str) -> DataFrame:
    """outcomes with decision_id, left_canonical_id, right_canonical_id and merged: whether both ends came into one group, by whatever pairs."""
    c = _canonical(outcomes)
    end = lambda e, out: c.select(F.col("id").alias(e), F.col("canonical").alias(out))
    j = salted_lookup(salted_lookup(outcomes, end("a", "_l"), "a"), end("b", "_r"), "b")
    left, right = F.coalesce("_l", "a"), F.coalesce("_r", "b")
    key = F.concat(F.lit("decision:"), T.stable_digest([F.lit(version), F.col("a"), F.col("b"), F.col("match_class")], 24))
    return j.select(key.alias("decision_id"), *outcomes.columns, left.alias("left_canonical_id"), right.alias("right_canonical_id"), (left == right).alias("merged"))


def alias_rows(contexts: DataFrame, outcomes: DataFrame, version: str) -> DataFrame:
    """One row per id of `contexts`: alias_id, id, type, alias, normalized_alias, canonical_id, candidate_canonical_id, match_class, auto_merged.

    match_class is the best of the id's accepted pairs, else REVIEW_REQUIRED with the group of its most similar pair for review as candidate (ties:
    the larger id), else DIFFERENT_ENTITY. auto_merged: its group has more than one member. Reductions per id, before the shuffle where Spark can.
    """
    c = _canonical(outcomes)
    both = outcomes.select("a", "b", "match_class", "name_similarity").unionByName(outcomes.select(F.col("b").alias("a"), F.col("a").alias("b"), "match_class", "name_similarity"))
    cls = F.col("match_class")
    best = both.groupBy(F.col("a").alias("id")).agg(
        F.max(cls == ACCEPTED[0]).alias("_exact"), F.max(cls == ACCEPTED[1]).alias("_high"), F.max(F.when(cls == "REVIEW_REQUIRED", F.struct("name_similarity", F.col("b").alias("b")))).alias("_review")
    )
    sizes = c.groupBy("canonical").agg((F.count(F.lit(1)) > 1).alias("_many"))
    c = salted_lookup(c, sizes, "canonical")
    n = contexts.select("id", "type", F.col("name").alias("alias"), F.col("norm").alias("normalized_alias")).join(best, "id", "left").join(c, "id", "left")
    accepted = F.coalesce(F.col("_exact") | F.col("_high"), F.lit(False))
    n = n.withColumn("_to", F.when(~accepted, F.col("_review.b"))).withColumn("canonical_id", F.coalesce("canonical", "id"))
    n = salted_lookup(n, c.select(F.col("id").alias("_to"), F.col("canonical").alias("_candidate")), "_to")
    found = F.when(accepted, F.when(F.col("_exact"), ACCEPTED[0]).otherwise(ACCEPTED[1])).when(F.col("_to").isNotNull(), "REVIEW_REQUIRED").otherwise("DIFFERENT_ENTITY")
    key = F.concat(F.lit("alias:"), T.stable_digest([F.lit(version), F.col("id"), F.col("canonical_id")], 24))
    return n.select(key.alias("alias_id"), "id", "type", "alias", "normalized_alias", "canonical_id", F.coalesce("_candidate", "_to").alias("candidate_canonical_id"), found.alias("match_class"), F.coalesce("_many", F.lit(False)).alias("auto_merged"))
