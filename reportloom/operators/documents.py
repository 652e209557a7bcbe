"""What a document is, and the records made from it: kind, year, language, chunk records, payload rows, baseline reports, packages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.operators.chunking import chunk_documents
from reportloom.operators.ordering import ranked
from reportloom.operators.skew import salted_lookup

# Words that tell a report's language.
TURKISH = ["faaliyet", "raporu", "sürdürülebilirlik", "yılı", "yonetici", "özeti", "bağımsız"]
ENGLISH = ["annual", "sustainability", "report", "integrated", "financial", "summary", "statement"]
# What names a presentation, an annual and a sustainability report, in the file's name and in the text.
PRESENTATION = (["presentation", "sunum"], ["yatırımcı sunumu", "investor presentation"])
ANNUAL = (["faaliyet", "annual", "entegre"], ["faaliyet raporu", "annual report", "entegre faaliyet", "yıllık rapor"])
SUSTAINABILITY = (["sustainability", "surdurulebilirlik"], ["sürdürülebilirlik raporu", "sustainability report"])
# Years sought in a file's name, and the year where nothing says another.
NAME_YEARS, DEFAULT_YEAR = [2023, 2024, 2025, 2026], 2025
PAYLOAD = "chunk_id document_id company ticker year report_type language page_number chunk_index text source_file".split()


def _has(c: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(c, F.lit(w)) for w in words])


def report_language(text: Column) -> Column:
    """en if the text has more than two words more that tell English than such as tell Turkish, else tr; null text gives tr."""
    w = T.answer_words(F.coalesce(text, F.lit("")))
    n = lambda words: F.size(F.filter(w, lambda x: x.isin(words)))
    return F.when(n(ENGLISH) > n(TURKISH) + 2, "en").otherwise("tr")


def report_kind(name: Column, text: Column) -> Column:
    """investor_presentation, annual_report or sustainability_report, by the file's name first; annual_report if nothing tells."""
    n, t = T.lower_tr(F.coalesce(name, F.lit(""))), T.lower_tr(F.coalesce(text, F.lit("")))
    either = lambda words: _has(n, words[0]) | _has(t, words[1])
    told = _has(n, ["sürdürülebilirlik raporu", "sustainability report"]) & ~F.contains(n, F.lit("faaliyet"))
    return F.when(either(PRESENTATION), "investor_presentation").when(either(ANNUAL), F.when(told, "sustainability_report").otherwise("annual_report")).when(either(SUSTAINABILITY), "sustainability_report").otherwise("annual_report")


def report_year(name: Column, text: Column) -> Column:
    """The first of NAME_YEARS in the file's name, else the year 2020 to 2026 that the text has most often (ties: the later), else DEFAULT_YEAR."""
    years = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(202[0-6])\b"), F.lit(1))
    often = F.transform(F.array_distinct(years), lambda y: F.struct(F.size(F.filter(years, lambda x: x == y)).alias("n"), y.cast("int").alias("y")))
    named = F.coalesce(*[F.when(F.contains(F.coalesce(name, F.lit("")), F.lit(str(y))), y) for y in NAME_YEARS])
    return F.coalesce(named, F.array_max(often)["y"], F.lit(DEFAULT_YEAR))


def chunk_records(docs: DataFrame, companies: DataFrame, key: str, text: str, ticker: str, keep: list[str]) -> DataFrame:
    """(key, keep.., ticker, company, chunk_index, chunk_id, text, token_count): the chunks of each document with its company's name.

    A ticker that the registry doesn't know is its own company name. Documents of one key with several texts each give their chunks.
    """
    c = chunk_documents(docs, key, text)
    names = companies.groupBy(F.upper("ticker").alias("_t")).agg(F.min("company_name").alias("_name"))
    of = docs.groupBy(key).agg(*[F.min(k).alias(k) for k in (ticker, *keep)]).withColumn("_t", F.upper(ticker)).join(names, "_t", "left")
    of = of.select(key, *keep, F.col(ticker).alias("ticker"), F.coalesce("_name", ticker).alias("company"))
    return salted_lookup(c, of, key, "left")


def payload_rows(chunks: DataFrame) -> DataFrame:
    """(point_id, the eleven fields of PAYLOAD, embeddable) of each distinct chunk row; rows without text can't be embedded. The vector is the encoder's to add."""
    return chunks.select(T.uuid5("chunk_id").alias("point_id"), *PAYLOAD, (F.trim(F.coalesce("text", F.lit(""))) != "").alias("embeddable")).distinct()


def baseline_reports(reports: DataFrame, group: list[str], kinds: list[str], years: tuple[int, int], least_pages: int) -> DataFrame:
    """One of reports(group.., document_id, report_type, language, pages) per group: Turkish first, then most pages, then the smallest id; only such of a kind, year and size wanted."""
    r = reports.where(F.col("report_type").isin(kinds) & F.col("year").between(*years) & (F.col("pages") >= least_pages))
    return r.groupBy(*group).agg(F.min_by("document_id", F.struct((F.col("language") != "tr").alias("o"), -F.col("pages"), F.col("document_id"))).alias("document_id"))


def blind_package(rows: DataFrame, key: str, seed: str, labels: str = "AB") -> DataFrame:
    """(key, place, label): rows in an order that depends on the seed alone, each under a label that does; places are ranked in ranges, not in one task."""
    from reportloom.operators.evals import blind_label

    d = rows.select(key).distinct().withColumn("_all", F.lit(0)).withColumn("_h", F.sha2(F.concat_ws("|", F.lit(seed), F.col(key)), 256))
    return ranked(d, ["_all"], ["_h", key], "place").select(key, "place", blind_label(F.col(key), seed, labels).alias("label"))


def sorted_evidence(rows: DataFrame, query: str, score: str, chunk: str, evidence: str) -> DataFrame:
    """Adds place: by score from the highest, then chunk and evidence; null scores come last. A query of any size is ranked in ranges."""
    d = rows.withColumn("_score", -F.coalesce(score, F.lit(-1e300))).withColumn("_chunk", F.coalesce(chunk, F.lit("")))
    return ranked(d, [query], ["_score", "_chunk", evidence], "place").drop("_score", "_chunk")


def graph_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, name, count): nodes by label, edges by type, totals, orphans, and edges with provenance."""
    count = F.count(F.lit(1)).alias("count")
    by = lambda d, what, c: d.groupBy(F.col(c).alias("name")).agg(count).select(F.lit(what).alias("what"), "name", "count")
    total = lambda d, name: d.agg(count).select(F.lit("total").alias("what"), F.lit(name).alias("name"), "count")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    parts = [by(nodes, "label", "label"), by(edges, "type", "type"), total(nodes, "nodes"), total(edges, "edges"), total(nodes.join(ends, "id", "left_anti"), "orphans"), total(edges.where("page IS NOT NULL OR confidence IS NOT NULL"), "with_provenance")]
    return reduce(DataFrame.unionByName, parts)
