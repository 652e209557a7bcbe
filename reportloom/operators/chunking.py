"""Blocks of a text and their packing into chunks with overlap."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.functions import text as T
from reportloom.session import fan_out

TARGET, OVERLAP, BLOCK = 500, 50, 300
#: Words of the pieces into which a sentence of more than BLOCK tokens is cut: as many as make 200 tokens.
PIECE_WORDS = 154
RANGES = "array<struct<first:int,last:int>>"


def word_pieces(sentence: Column, words: int = PIECE_WORDS) -> Column:
    """Array of the sentence's words, `words` of them joined by blanks in each piece."""
    w = F.regexp_extract_all(sentence, F.lit(f"[^{T.BLANKS}]+"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(words)), lambda i: F.array_join(F.slice(w, i + 1, words), " "))


def text_blocks(text: Column, block: int = BLOCK) -> Column:
    """Array of blocks: paragraphs, those over `block` tokens as their sentences and lines, those over it still as pieces of words; empty ones left out, null gives none."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\n[ \\t\\r]*\\n"), T.strip), lambda p: p != "")
    lines = lambda p: F.filter(F.transform(F.split(p, "(?<=[.!?;])[ ]+|\\n"), T.strip), lambda s: s != "")
    fine = lambda p: F.flatten(F.transform(lines(p), lambda s: F.when(T.token_count(s) > block, word_pieces(s)).otherwise(F.array(s))))
    return F.flatten(F.transform(paragraphs, lambda p: F.when(T.token_count(p) > block, fine(p)).otherwise(F.array(p))))


def ranges_of(tokens: list[int], target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(first, last) block numbers (from 1) of the chunks packed from blocks of these token counts, in one pass.

    Blocks are added until the next would exceed the target; the next chunk begins with the last blocks of the one
    before, up to the overlap but at least one, and takes the block that didn't fit in any case.
    """
    if not tokens:
        return []
    out, first, size = [], 0, 0
    for i, t in enumerate(tokens):
        if i > first and size + t > target:
            out.append((first + 1, i))
            first, size = i - 1, tokens[i - 1]
            while first > out[-1][0] - 1 and size + tokens[first - 1] <= overlap:
                first -= 1
                size += tokens[first]
        size += t
    return [*out, (first + 1, len(tokens))]


def pack_ranges(tokens: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """ranges_of as a column: only token counts go to Python, in Arrow batches, and block numbers come back. Null gives none."""

    @F.pandas_udf(RANGES)
    def pack(batch: pd.Series) -> pd.Series:
        return pd.Series([[{"first": a, "last": b} for a, b in ranges_of([] if t is None else [int(x) for x in t], target, overlap)] for t in batch], dtype=object)

    return pack(tokens)


def chunk_documents(docs: DataFrame, key: str, text: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, chunk_id, text, token_count) of each document: blocks packed to chunks, meaningless ones dropped.

    chunk_index counts a document's chunks from 0. Null and empty texts give no rows; repeated rows repeat theirs.
    """
    d = fan_out(docs.select(key, text)).select(F.col(key), text_blocks(F.col(text)).alias("_b"))
    d = d.withColumn("_r", pack_ranges(F.transform("_b", T.token_count), target, overlap))
    d = d.withColumn("_c", F.transform("_r", lambda r: F.array_join(F.slice("_b", r["first"], r["last"] - r["first"] + 1), "\n\n")))
    c = d.select(key, F.posexplode(F.filter("_c", T.is_meaningful)).alias("chunk_index", "text"))
    return c.select(key, "chunk_index", T.chunk_hash(F.col(key).cast("string"), F.col("chunk_index"), F.col("text")).alias("chunk_id"), "text", T.token_count("text").alias("token_count"))


def chunk_stats(chunks: DataFrame, tokens: str = "token_count") -> DataFrame:
    """One row: chunks, least, most and mean tokens (two places)."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.min(tokens).alias("least"), F.max(tokens).alias("most"), F.round(F.avg(tokens), 2).alias("mean"))
