"""Encoding of a corpus with a public byte-level BPE tokenizer.

Method: tree concatenation. A text is halved down to pieces of a few hundred characters, pieces are encoded, in parallel
where a text is long, and concatenated pairwise, level by level: where two meet, a growing window around the join is encoded
again until it agrees with both sides exactly.

Why agreement is enough: a token sequence is the BPE encoding of its bytes if and only if each pair of
neighbours is the encoding of its own bytes. Left and right are encodings, so their pairs are sound; the
window is one, so its pairs are; and where the window's outer tokens equal those it replaces, the pairs
across its edges are sound too.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.session import fan_out

TOKENIZERS = os.environ.get("REPORTLOOM_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the splitting pattern that belongs to the byte_bpe_50k vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of more characters are halved; most documents are. Characters of the stretches of a long text that different tasks encode.
PIECE, STRETCH = 256, 1 << 16
#: Stretches concatenated in one task of the first level.
FAN_IN = 64
#: Outer tokens on either side in which a window must agree.
AGREE = 4


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """(encode, bytes of each token) of a vocabulary of ranks; kept by each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    of = {i: t for t, i in ranks.items()}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, of


def _continues(byte: int) -> bool:
    return byte & 0xC0 == 0x80


def concatenate(left: list[int], right: list[int], encode, of: dict[int, bytes]) -> list[int]:
    """The encoding of the text of which `left` and `right` encode two parts cut at any character."""
    if not left or not right:
        return left or right
    k = 16
    while True:
        i, j = max(0, len(left) - k), min(len(right), k)
        while i and _continues(of[left[i]][0]):
            i -= 1
        while j < len(right) and _continues(of[right[j]][0]):
            j += 1
        a, b = left[i:], right[:j]
        w = encode(b"".join(of[t] for t in a + b).decode("utf-8"))
        fits = lambda whole, x, y: whole or (len(x) >= AGREE and x == y)
        if fits(i == 0, w[:AGREE], a[:AGREE]) and fits(j == len(right), w[-AGREE:], b[-AGREE:]):
            return left[:i] + w + right[j:]
        k *= 2


def encode_tree(text: str, encode, of: dict[int, bytes], piece: int = PIECE) -> list[int]:
    """The encoding of a text by halves: pieces of at most `piece` characters are encoded, halves are concatenated."""
    if len(text) <= piece:
        return encode(text)
    mid = len(text) // 2
    return concatenate(encode_tree(text[:mid], encode, of, piece), encode_tree(text[mid:], encode, of, piece), encode, of)


def cut(text: str, size: int) -> list[str]:
    """Stretches of at most `size` characters and about equal length."""
    n = max(1, -(-len(text) // size))
    at = [len(text) * i // n for i in range(n + 1)]
    return [text[a:b] for a, b in zip(at, at[1:])]


def merge_pieces(pieces: list[list[int]], encode, of) -> list[int]:
    """Tree concatenation of the encodings of consecutive pieces."""
    while len(pieces) > 1:
        pieces = [concatenate(pieces[i], pieces[i + 1], encode, of) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0] if pieces else []


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, piece: int = PIECE, stretch: int = STRETCH) -> DataFrame:
    """(key, ids) of each row of `docs`: ids without special tokens; what looks like one is ordinary text.

    Empty and null texts give an empty list; an empty table gives no rows; repeated rows and null keys are
    kept as they are. Other columns are ignored. Every text of more than `piece` characters is encoded by tree concatenation.
    Texts up to `stretch` characters are so encoded where they are read, without a shuffle; longer ones are parted into stretches
    that tasks encode in the same way, and the tree goes on over the stretches.
    """
    path = vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    kind = docs.schema[key].dataType.simpleString()
    d = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    near = d.where(F.length("_text") <= stretch)
    far = d.where(F.length("_text") > stretch)

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, of = encoder(path)
        for b in batches:
            ids = [encode_tree(t, encode, of, piece) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], names=[key, "ids"])

    def to_stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, k, t in b.itertuples(index=False):
                parts = cut(t, stretch)
                yield pd.DataFrame({"_row": n, key: k, "_no": range(len(parts)), "_text": parts}).astype({key: b[key].dtype})

    def encode_stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, of = encoder(path)
        for b in batches:
            yield b.drop(columns="_text").assign(ids=[encode_tree(t, encode, of, piece) for t in b["_text"]])

    def join(b: pd.DataFrame) -> pd.DataFrame:
        encode, of = encoder(path)
        b = b.sort_values("_no")
        out = b.iloc[:1].copy()
        out["ids"] = [merge_pieces([list(map(int, x)) for x in b["ids"]], encode, of)]
        return out

    first = fan_out(near).mapInArrow(encode_rows, f"{key} {kind}, ids array<int>")
    cols = f"_row bigint, {key} {kind}, _no int"
    # the row number only tells repeated keys apart; texts are parted once, before anything depends on it
    rows = far.select(F.xxhash64(F.col(key), F.col("_text"), F.monotonically_increasing_id()).alias("_row"), key, "_text")
    parts = rows.mapInPandas(to_stretches, cols + ", _text string").repartition("_row", "_no")
    done = parts.mapInPandas(encode_stretches, cols + ", ids array<int>")
    level = done.withColumn("_g", (F.col("_no") / FAN_IN).cast("int")).groupBy("_row", "_g").applyInPandas(join, cols + ", ids array<int>, _g int")
    whole = level.drop("_g").groupBy("_row").applyInPandas(join, cols + ", ids array<int>")
    return first.unionByName(whole.select(key, "ids"))
