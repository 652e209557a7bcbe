"""Quantities stated in many units and scales, converted to the common unit of their metric.

Method: extract number and unit text by pattern, normalise the unit text by a join with an alias
table, take number, unit and scale from the first place that states them, else the metric's own unit, apply offset and factor.
Only built-in columns and joins with tables of fixed size; no shuffle but the distinct ones.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.functions.text import strip

# Spellings of units in lower case, by dimension, common unit and factor to it.
UNITS = [
    ("money", "TRY", "1", "try|tl|₺|türk lirası"),
    ("money", "USD", "1", "usd|$|us$|abd doları"),
    ("money", "EUR", "1", "eur|€|euro|avro"),
    ("energy", "kWh", "1", "kwh|kilovatsaat"),
    ("energy", "kWh", "1000", "mwh|mw-h|megavat saat|megavatsaat"),
    ("energy", "kWh", "1000000", "gwh|gigavatsaat"),
    ("energy", "kWh", "1000000000", "twh|teravatsaat"),
    ("mass", "kg", "1", "kg|kilogram"),
    ("mass", "kg", "1000", "t|ton|tonne|tonnes|metrik ton|tco2e"),
    ("mass", "kg", "1000000", "kt|kiloton"),
    ("mass", "kg", "1000000000", "mt"),
    ("area", "m2", "1", "m2|m²|sqm|metrekare"),
    ("area", "m2", "1000", "da|dekar|decare|dönüm"),
    ("area", "m2", "10000", "ha|hektar|hectare|hectares"),
    ("area", "m2", "1000000", "km2|km²"),
    ("length", "m", "1", "m|metre|metres"),
    ("length", "m", "1000", "km|kilometre"),
    ("length", "m", "1609.344", "mi|mil|mile|miles"),
    ("volume", "l", "1", "l|lt|litre"),
    ("volume", "l", "100", "hl|hektolitre"),
    ("volume", "l", "1000", "m3|m³|metreküp"),
    ("volume", "l", "1000000", "ml|megalitre"),
    ("duration", "min", "1", "min|dk|dakika|minutes"),
    ("duration", "min", "60", "h|sa|saat|hour|hours"),
    ("count", "count", "1", "count|kişi|people|employees|çalışan"),
    ("ratio", "bp", "1", "bp|bps|baz puan"),
    ("ratio", "bp", "100", "%|percent|pct|yüzde"),
    ("ratio", "bp", "10", "‰|permille|binde"),
]
# Units with another zero, as above, then what is added to the number before it is multiplied, and a divisor.
AFFINE = [
    ("temperature", "°C", "1", "°c|c|celsius|santigrat|derece", "0", "1"),
    ("temperature", "°C", "1", "k|kelvin", "-273.15", "1"),
    ("temperature", "°C", "5", "°f|f|fahrenheit", "-32", "9"),
]
# Scale words in lower case, without full stops.
SCALES = [
    ("1000", "bin|thousand|ths|k|'000|tsd|tausend|mille|milliers|mil|miles"),
    ("1000000", "milyon|mn|mio|mln|m|million|millions|millionen|millones|mill"),
    ("1000000000", "milyar|mlr|bn|bln|b|billion|mrd|milliarden|mds|md|milliards|mil millones|mil m"),
]
# Characters folded when names are compared.
FOLD = ("çğıöşüâîûéèêáíóñäİ", "cgiosuaiueeeaionai")
GAP = r" \u00a0\u2009\u202f"
NUMBER = rf"\d{{1,3}}(?:[{GAP}]\d{{3}})+(?:[.,]\d+)?|\d[\d.,]*"
BRACKET = rf"[(\[]([^()\[\]]*[^\d\s.,()\[\]{GAP}\-−][^()\[\]]*)[)\]]"
AMOUNT, FACTOR = "decimal(16,4)", "decimal(22,3)"


def known_units() -> list[tuple[str, str, str, str, str, str]]:
    """UNITS and AFFINE in one form: dimension, common unit, factor, spellings, offset, divisor."""
    return [(*u, "0", "1") for u in UNITS] + AFFINE


def alias_table(spark: SparkSession) -> DataFrame:
    """(dimension, phrase, stated_unit, stated_factor, stated_offset, stated_divisor, stated_scale): a unit, a scale word, or both in either order.

    A phrase that is both a unit of the dimension and a scale word is the unit (m is metre for a
    length, million for money). The number of rows is fixed by UNITS, AFFINE and SCALES.
    """
    units = [(d, (u, Decimal(f), Decimal(o), int(v)), w) for d, u, f, names, o, v in known_units() for w in names.split("|")]
    scales = [(Decimal(x), w) for x, names in SCALES for w in names.split("|")]
    table: dict[tuple[str, str], tuple] = {}
    for d, u, w in units:
        table.setdefault((d, w), (*u, None))
    for d in sorted({x[0] for x in units}):
        for x, w in scales:
            table.setdefault((d, w), (None, None, None, None, x))
    for first in (True, False):
        for d, u, w in units:
            for x, v in scales:
                table.setdefault((d, f"{v} {w}" if first else f"{w} {v}"), (*u, x))
    return spark.createDataFrame([(*k, *v) for k, v in table.items()], f"dimension string, phrase string, stated_unit string, stated_factor {FACTOR}, stated_offset {AMOUNT}, stated_divisor int, stated_scale {FACTOR}")


def unit_phrase(text: Column) -> Column:
    """What is left of a stated quantity without its number: lower case, single blanks, no stops, signs or brackets."""
    t = F.lower(F.translate(text, "İ", "i"))
    t = F.regexp_replace(t, "['’´`]000", " thousand ")
    t = F.regexp_replace(t, r"(?<!m|tco)(?:" + NUMBER + ")", " ")
    t = F.regexp_replace(t, r"(?<!w)-(?!h)|[−–—.,()\[\]+]", " ")
    return F.trim(F.regexp_replace(t, rf"[\s{GAP}]+", " "))


def with_number(df: DataFrame, text: str, lang: str, out: str) -> DataFrame:
    """Adds `out`, the number printed in column `text`, signed, read as the language writes numbers; null without one.

    English groups by comma and has a decimal point; the others the other way round, French also
    groups by blank. A lone separator that can't group (not before exactly three digits) is decimal.
    Each step is a column of its own, so that no pattern is run twice.
    """
    en, raw = F.col(lang) == "en", F.col("_raw")
    point = F.when(en, raw.rlike(r"^\d+,(?!\d{3}$)\d+$")).otherwise(raw.rlike(r"^\d+\.(?!\d{3}$)\d+$"))
    df = df.withColumn("_t", F.regexp_replace(text, "['’´`]000", " "))
    df = df.withColumn("_raw", F.regexp_replace(F.regexp_extract("_t", NUMBER, 0), f"[{GAP}]|[.,]+$", ""))
    df = df.withColumn("_en", F.coalesce(en, F.lit(False)) != point)
    df = df.withColumn("_x", F.when(F.col("_en"), F.regexp_replace(raw, ",", "")).otherwise(F.translate(raw, ",.", ".")).try_cast(AMOUNT))
    return df.withColumn(out, F.when(F.col("_t").rlike(r"[-−–]\s*\d|\(\s*\d[^()]*\)"), -F.col("_x")).otherwise(F.col("_x"))).drop("_t", "_raw", "_en", "_x")


def stated_scale(text: Column) -> Column:
    """A scale property as a number: 1000, 1e3, 1.000 or a scale word; else null."""
    t = F.lower(F.translate(strip(text), "İ", "i"))
    words = F.coalesce(*[F.when(t.isin(*names.split("|")), F.lit(x)) for x, names in SCALES])
    grouped = F.when(t.rlike(r"^\d{1,3}([.,]\d{3})+$"), F.regexp_replace(t, "[.,]", ""))
    return F.coalesce(words, grouped, t).try_cast("double").cast(FACTOR)


def _key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.translate(strip(c), "İ", "i")), r"[\s_-]+", "_")


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(F.translate(strip(c), "İ", "i")), *FOLD), "[^a-z0-9]", "")


def convert_quantities(entities: DataFrame, metric_units: DataFrame) -> DataFrame:
    """One row per distinct FinancialMetric statement: entity_id, number, unit, scale, offset, factor and the value in the common unit.

    Input: `entities` with id, type, properties, evidence_text, source_file, canonical_name (others are
    ignored); `metric_units` with metric_key, dimension, common_unit.

    number: reported_value if it is stated, else value. Unit and scale: as reported_value prints them, else
    the bracket in evidence_text, else the properties, else, for the unit, the one that `metric_units` has for the metric if that is
    one (not for money, whose unit is the stated currency); no scale is 1. The dimension comes from metric_key,
    or if that is missing or unknown from a metric of that name, or from what rows of the same name mostly have.
    common_value is scale times number plus offset, times factor, rounded half away from zero; `divides` is what the factor is divided
    by (9 for Fahrenheit, else 1). Rows without number or without unit have null common_value. Null properties, empty
    texts and an empty table give null results or no rows; repeated rows come out once.
    """
    spark = entities.sparkSession
    p = lambda k: F.try_element_at(F.col("properties"), F.lit(k))
    keys = metric_units.select(_key(F.col("metric_key")).alias("_key"), "dimension", "common_unit").groupBy("_key").agg(F.min("dimension").alias("dimension"), F.min("common_unit").alias("metric_unit"))
    m = entities.where(F.col("type") == "FinancialMetric")
    key, name = _key(p("metric_key")), _squeezed(F.coalesce(p("name"), F.col("canonical_name")))
    # what metrics of a name measure: of the keys and names alone, before any pattern is run; one row per name, far fewer than rows
    named = (
        m.select("id", key.alias("_key"), name.alias("_name")).where(F.col("_name") != "").join(keys, "_key").groupBy("_name", "dimension").agg(F.count_distinct("id").alias("n"))
        .groupBy("_name").agg(F.max_by("dimension", F.struct("n", "dimension")).alias("named"))
    )
    e = m.select(
        F.col("id").alias("entity_id"), key.alias("_key"), name.alias("_name"),
        F.when(p("reported_value").rlike(r"\S"), p("reported_value")).alias("_rv"), p("value").alias("_value"), F.lower(strip(p("unit"))).alias("_unit"),
        stated_scale(p("scale")).alias("_scale"), F.regexp_extract("evidence_text", BRACKET, 1).alias("_bracket"),
        F.lower(F.regexp_extract("source_file", r"__([A-Za-z]{2})__", 1)).alias("lang"),
    ).distinct()
    e = with_number(e, "_rv", "lang", "_printed").withColumns({
        "number": F.when(F.col("_rv").isNotNull(), F.col("_printed")).otherwise(F.col("_value").try_cast("decimal(38,10)").try_cast(AMOUNT)),
        "_said": unit_phrase(F.col("_rv")), "_note": unit_phrase(F.col("_bracket")),
    })
    e = e.join(keys, "_key", "left").join(named, "_name", "left").withColumn("dimension", F.coalesce("dimension", "named")).drop("named")
    a = F.broadcast(alias_table(spark))
    stated = ["unit", "factor", "offset", "divisor", "scale"]
    own = F.lower(F.translate("metric_unit", "İ", "i"))
    for c, tag in (("_said", "s"), ("_note", "n"), ("_unit", "u"), ("_own", "d")):
        b = a.select("dimension", F.col("phrase").alias(c), *[F.col(f"stated_{x}").alias(f"{tag}_{x}") for x in stated])
        e = (e.withColumn("_own", own) if c == "_own" else e).join(b, ["dimension", c], "left")
    first = lambda x: F.coalesce(*[F.col(f"{tag}_{x}") for tag in "snud"])
    scale = F.coalesce("s_scale", "n_scale", "_scale", F.lit(1).cast(FACTOR))
    e = e.select("entity_id", "dimension", "number", first("unit").alias("common_unit"), scale.alias("scale"), first("offset").alias("offset"), first("divisor").alias("divides"), F.try_multiply(scale, first("factor")).try_cast(FACTOR).alias("factor"))
    # a scale is part of the number, so what is added to the number is divided by it: scale (number + offset / scale)
    whole = F.try_multiply(F.try_add(F.col("number"), F.when(F.col("offset") == 0, F.lit(0).cast(AMOUNT)).otherwise((F.col("offset") / F.col("scale")).try_cast(AMOUNT))).try_cast(AMOUNT), F.col("factor"))
    whole = F.when(F.col("divides") == 1, whole).otherwise((whole.try_cast("decimal(28,7)") / F.col("divides")).try_cast("decimal(38,7)"))
    return e.withColumn("common_value", F.round(whole, 0).try_cast("bigint"))


def converted_rows(entities: DataFrame, metric_units: DataFrame) -> DataFrame:
    """(entity_id, common_value, common_unit) of the statements that aren't in the common unit as they are printed, each once."""
    q = convert_quantities(entities, metric_units)
    other = (F.col("factor") != 1) | (F.col("divides") != 1) | (F.col("offset") != 0)
    return q.where(other & F.col("common_value").isNotNull()).select("entity_id", "common_value", "common_unit").distinct()
