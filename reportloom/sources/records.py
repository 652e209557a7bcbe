"""Readers and writers of records as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

CHUNK = "chunk_id string, document_id string, company string, ticker string, year int, report_type string, language string, page_number int, chunk_index int, text string, token_count int, source_file string"
ENTITY = "id string, type string, canonical_name string, properties map<string,string>, source_chunk_id string, source_file string, page_number int, evidence_text string, confidence double, extraction_version string"
RELATION = "id string, type string, source_entity_id string, target_entity_id string, properties map<string,string>, source_chunk_id string, source_file string, page_number int, evidence_text string, confidence double, extraction_version string"


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a fixed record type; the first malformed line fails the read. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(good records, rejections): a malformed line becomes (source_file, raw_text, reason_code); blank lines are neither. With `most` at most so many good records."""
    raw = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("_file")).where(F.trim("value") != "")
    full = S.StructType([*S._parse_datatype_string(schema).fields, S.StructField("_corrupt", S.StringType())])
    parsed = raw.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    good = parsed.where(~bad).select(*[F.col(f"r.{f.name}") for f in full.fields[:-1]])
    return good if most is None else good.limit(most), parsed.where(bad).select(F.col("_file").alias("source_file"), F.col("value").alias("raw_text"), F.lit("INVALID_JSON").alias("reason_code"))


def read_pages(spark: SparkSession, path: str, schema: str, glob: str = "*.jsonl") -> DataFrame:
    """JSON lines of all files under a directory."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(path)


def not_yet_written(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose keys `old` doesn't have, each key once (any of its rows); null keys are kept as they never match."""
    return new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at the path, in whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_new(new: DataFrame, path: str, keys: list[str]) -> None:
    """Append to a Parquet table the rows whose keys it doesn't have; a missing table is begun. A table that can't be read is an error."""
    if not exists(new.sparkSession, path):
        new.dropDuplicates(keys).write.parquet(path)
    else:
        not_yet_written(new, new.sparkSession.read.parquet(path), keys).write.mode("append").parquet(path)


def write_by_document(df: DataFrame, path: str, key: str = "document_id", overwrite: bool = False) -> None:
    """One folder of JSON lines per document under `path`; documents that have one are left as they are unless `overwrite`.

    With overwrite only the folders of the documents in `df` are replaced.
    """
    spark = df.sparkSession
    there = spark.read.option("basePath", path).json(path) if exists(spark, path) and not overwrite else None
    new = df.join(there.select(F.col(key).cast(df.schema[key].dataType)).distinct(), key, "left_anti") if there is not None and key in there.columns else df
    new.write.partitionBy(key).mode("overwrite" if overwrite else "append").option("partitionOverwriteMode", "dynamic").json(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    if not exists(spark, path):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    names = [f.getPath().getName() for f in found]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and exists(spark, f"{path}/{n}/_SUCCESS"))


def read_upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that upsert last finished at the path, or None."""
    v = _versions(spark, path)
    return spark.read.parquet(f"{path}/v{v[-1]}") if v else None


def upsert(new: DataFrame, path: str, key: str, version: str) -> DataFrame:
    """Merge rows into a table by key, the highest `version` wins; returns the table.

    A new version of the table is written beside the one that readers use, which counts once it is complete; one version before it is
    kept, so a run that breaks off changes nothing.
    """
    from reportloom.operators.vectors import latest_by_key

    spark = new.sparkSession
    v, old = _versions(spark, path), read_upserted(spark, path)
    merged = latest_by_key(new if old is None else old.unionByName(new), key, F.col(version))
    merged.write.mode("overwrite").parquet(f"{path}/v{(v[-1] if v else 0) + 1}")
    for n in v[:-1]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{n}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return read_upserted(spark, path)


def canonical_first(canonical: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    """The canonical row of each key that has one, else its raw rows; columns of the canonical side, null where the raw side lacks them."""
    rest = raw.join(canonical.select(key).distinct(), key, "left_anti")
    return canonical.unionByName(rest.select(*[c for c in canonical.columns if c in raw.columns]), allowMissingColumns=True)


def first_or(items, single, default: str):
    """The first element of a list column, else the scalar column, else the default: how provenance is read from either form."""
    return F.coalesce(F.try_element_at(items, F.lit(1)), single, F.lit(default))


def read_settings(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    """A list of mappings under `section` of a YAML file on the driver, as rows; missing keys are null. Settings, so small."""
    import yaml  # only this reader needs it

    names = S._parse_datatype_string(schema).fieldNames()
    with open(path, encoding="utf-8") as f:
        rows = (yaml.safe_load(f) or {}).get(section) or []
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


DISTANCES = ("cosine", "dot", "euclid")


def ensure_vectors(spark: SparkSession, path: str, size: int, distance: str = "cosine", reset: bool = False) -> dict:
    """Begin a vector collection, or reset it: what it holds, as `settings` beside its `data`; an unknown distance is cosine. An existing one keeps its settings, and another size is an error."""
    want = {"size": size, "distance": distance if distance in DISTANCES else "cosine"}
    if exists(spark, f"{path}/settings") and not reset:
        have = spark.read.json(f"{path}/settings").first().asDict()
        if have["size"] != size:
            raise ValueError(f"{path} holds vectors of {have['size']} numbers, not {size}")
        return have
    if exists(spark, f"{path}/data"):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    spark.createDataFrame([want]).coalesce(1).write.mode("overwrite").json(f"{path}/settings")
    return want


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; the committer renames files into place, so readers see all or nothing."""
    df.write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str, embedding: str, size: int, reset: bool = False) -> DataFrame:
    """A vector table: rows whose vector has `size` finite numbers are written, the others returned."""
    ok = (F.size(embedding) == size) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x))
    df.where(ok).write.mode("overwrite" if reset else "append").parquet(path)
    return df.where(~F.coalesce(ok, F.lit(False)))


def table_checksum(df: DataFrame, key: str) -> DataFrame:
    """One row: rows and a digest that doesn't depend on order or layout: the sum of the rows' hashes, as exact decimals. Vectors count to six places."""
    numbers = lambda c: F.array_join(F.transform(c, lambda x: F.round(x.cast("double") * 1_000_000).cast("bigint").cast("string")), ",", "")
    text = lambda c, t: numbers(c) if t in ("array<float>", "array<double>") else F.to_json(c) if t.startswith(("map<", "array<", "struct<")) else F.col(c).cast("string")
    cols = [text(c, t) for c, t in df.dtypes]
    h = F.conv(F.substring(F.sha2(F.concat_ws("\x01", *[F.coalesce(c, F.lit("\x02")) for c in cols]), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("digest"), F.count_distinct(key).alias("keys"))


def manifest(reports: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, chunks, pages, tokens) of each report, zero where it has none."""
    c = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("page_number").alias("p"), F.sum("token_count").alias("t"))
    z = lambda x: F.coalesce(F.col(x), F.lit(0))
    return reports.select("document_id").distinct().join(c, "document_id", "left").select("document_id", z("c").alias("chunks"), z("p").alias("pages"), z("t").alias("tokens"))
