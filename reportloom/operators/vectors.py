"""Exact nearest vectors with metadata filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are sent to the executors at a time.
QUERY_BLOCK = 4096
DISTANCES = ("cosine", "dot", "euclid")


def metadata_filter(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns equal the wanted values (a list: any of them); None and empty lists mean no filter.

    Filters are plain comparisons, so they reach the scan. Null never equals a wanted value.
    """
    for c, v in wanted.items():
        if v is None or v == []:
            continue
        df = df.where(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    return df


def _scores(q: np.ndarray, x: np.ndarray, distance: str) -> np.ndarray:
    if distance == "euclid":
        d = np.zeros((len(q), len(x)))
        for i in range(0, len(q), 64):
            d[i : i + 64] = np.sqrt(((q[i : i + 64, None, :] - x[None, :, :]) ** 2).sum(axis=2))
        return np.round(-d, 6)
    s = q @ x.T
    if distance == "cosine":
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        s = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
    return np.round(s, 6)


def vector_topk(queries: DataFrame, vectors: DataFrame, key: str, embedding: str, k: int = 5, distance: str = "cosine", threshold: float | None = None, same: bool = False) -> DataFrame:
    """(query_id, key, score, rank): the k best vectors of each query, by score, then by key.

    score is rounded to six places before it is ranked; Euclidean distance counts negatively. A query isn't matched with
    its own key unless `same`. Scores under `threshold` are left out. Null or empty vectors, and such of another length
    than the query's, match nothing; a zero vector has cosine 0; a key that occurs repeatedly ranks repeatedly.

    Queries are a stated set; they go to the executors in blocks of at most QUERY_BLOCK (about), against all vectors, which
    don't move: each task keeps its own k best per query, and only those are shuffled.
    """
    if distance not in DISTANCES:
        distance = "cosine"
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    q = queries.select(F.col(key).alias("query_id"), F.col(embedding).cast("array<double>").alias("q")).where(F.size("q") > 0)
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    parts = []
    for b in range(blocks):
        some = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toPandas()
        if not len(some):
            continue
        by_size = {n: g for n, g in some.groupby(some["q"].map(len))}
        shared = spark.sparkContext.broadcast({n: (g["query_id"].to_numpy(), np.vstack(g["q"].to_list())) for n, g in by_size.items()})

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            kept: pd.DataFrame | None = None
            for batch in batches:
                frames = [] if kept is None else [kept]
                for n, (ids, m) in shared.value.items():
                    rows = batch[batch["e"].map(len) == n]
                    for i in range(0, len(rows), 2048):
                        part = rows.iloc[i : i + 2048]
                        keys = part[key].to_numpy()
                        s = _scores(m, np.vstack(part["e"].to_list()).astype(float), distance)
                        take = min(k + 1, s.shape[1])
                        # all that reach the k-th best score, so that ties are decided by key below
                        edge = -np.partition(-s, take - 1, axis=1)[:, take - 1 : take]
                        a, c = np.nonzero(s >= edge)
                        frames.append(pd.DataFrame({"query_id": ids[a], key: keys[c], "score": s[a, c]}))
                if frames:
                    f = pd.concat(frames)
                    f = f[(f["query_id"] != f[key]) | same]
                    if threshold is not None:
                        f = f[f["score"] >= threshold]
                    kept = f.sort_values(["query_id", "score", key], ascending=[True, False, True]).groupby("query_id").head(k)
            if kept is not None:
                yield kept

        v = vectors.select(key, F.col(embedding).cast("array<double>").alias("e")).where(F.size("e") > 0)
        parts.append(v.mapInPandas(best, f"query_id {kind}, {key} {kind}, score double"))
    if not parts:
        return spark.createDataFrame([], f"query_id {kind}, {key} {kind}, score double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def latest_by_key(df: DataFrame, key: str, version: Column) -> DataFrame:
    """One row per key, that of the highest version (last write wins); rows without key are dropped.

    A reduction with partial results before the shuffle, not a window, so a hot key is no burden. Ties: the
    greatest row as a struct. Map columns are kept as entries are compared.
    """
    cols = [c for c in df.columns if c != key]
    comparable = [F.map_entries(c).alias(c) if t.startswith("map<") else F.col(c) for c, t in df.select(*cols).dtypes]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(version.alias("_v"), *comparable)).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def context_window(hits: DataFrame, chunks: DataFrame, pages: int = 1) -> DataFrame:
    """(hit_id, chunk_id, distance): other chunks of a hit's ticker and year within `pages` pages.

    A band join: pages are put into bands of `pages + 1`, a hit looks into its own and the neighbouring bands, so
    both sides are hashed by ticker, year and band. Null ticker, year or page match nothing.
    """
    band = F.floor(F.col("page_number") / (pages + 1))
    h = hits.select(F.col("chunk_id").alias("hit_id"), "ticker", "year", F.col("page_number").alias("_p"), F.explode(F.array(band - 1, band, band + 1)).alias("_band"))
    c = chunks.select("chunk_id", "ticker", "year", "page_number", band.alias("_band"))
    d = F.abs(F.col("page_number") - F.col("_p"))
    return h.join(c, ["ticker", "year", "_band"]).where((d <= pages) & (F.col("chunk_id") != F.col("hit_id"))).select("hit_id", "chunk_id", d.alias("distance")).distinct()
