"""Splitting oversized texts at natural boundaries.

Method: balanced targets. The minimum number of pieces is computed, equal targets are placed, each is moved to
the strongest boundary nearby, and pieces are added while any of them breaks a limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.functions.text import token_count
from reportloom.session import fan_out

MAX_TOKENS, MAX_CHARS, OVERLAP = 500, 4000, 50
#: The overlap takes at most this share of MAX_CHARS.
OVERLAP_CHARS = 0.1
BLANK = r"[\s\x1c-\x1f]"
WORDS = re.compile(r"[^\s\x1c-\x1f]+")
#: Boundaries from the strongest: paragraph, sentence, line, clause, blank, joint of unspaced text.
BOUNDARIES = [
    (6, re.compile(r"(?:\r?\n[ \t]*){2,}")),
    (5, re.compile(r"(?<=[^\W\d_]{3}[.!?…])[\"'”’»)\]]*[ \t]*(?=\r?\n)|(?<=[^\W\d_]{3}[.!?…])[\"'”’»)\]]*\s+(?=[^\W\d_a-zçğıöşüáéíóúñäßèàê])|(?<=[%)\d][.!?…])\s+(?=[^\W\d_a-z])")),
    (4, re.compile(r"\r?\n")),
    (3, re.compile(r"(?<=[;:,])\s+")),
    (2, re.compile(r"\s+")),
    (1, re.compile(r"(?<=[.!?;:,…)])(?=[^\s\d.!?;:,…)])")),
]


def tokens(words: int) -> int:
    return max(1, int(words * 1.3)) if words else 0


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a piece may start, in order, and the strength of each."""
    best: dict[int, int] = {}
    for strength, pattern in BOUNDARIES:
        for m in pattern.finditer(text):
            best.setdefault(m.end(), strength)
    best.pop(0, None)
    best.pop(len(text), None)
    at = np.array(sorted(best), np.int64)
    return at, np.array([best[p] for p in at.tolist()], np.int64)


def split_text(text: str, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, first) of each piece in characters; the piece's own part begins at `first`, what is before it overlaps.

    Own parts follow one another without gap and make up the whole text. Every piece, overlap included, has at most
    `max_tokens` tokens and `max_chars` characters; the overlap has at most `overlap` tokens. Limits
    that are too small for an overlap do without; a cut never parts a character from its combining marks, unless
    nothing else fits.
    """
    spans = [m.span() for m in WORDS.finditer(text)]
    if len(text) <= max_chars and tokens(len(spans)) <= max_tokens:
        return [(0, len(text), 0)]
    starts, ends = (np.array([s[i] for s in spans], np.int64) for i in (0, 1))
    most_words = next(w for w in range(int((max_tokens + 1) / 1.3) + 1, 0, -1) if tokens(w) <= max_tokens or w == 1)
    over_words = max((w for w in range(int((overlap + 1) / 1.3) + 2) if tokens(w) <= overlap), default=0)
    over_words, over_chars = min(over_words, most_words // 4), int(min(max_chars * OVERLAP_CHARS, max_chars // 4))
    before = lambda p: np.searchsorted(starts, p, "left")  # noqa: E731  words that start before p
    count = lambda a, b: before(b) - np.searchsorted(ends, a, "right")  # noqa: E731  words in [a, b), cut ones included
    at, strength = boundaries(text)
    # equal targets in what the limits measure, so dense and loose stretches get pieces of like load
    word_at = np.zeros(len(text) + 1)
    word_at[starts + 1 if len(starts) else []] = 1.0 / most_words
    load = np.cumsum(word_at) + np.arange(len(text) + 1) / max_chars
    own_words, own_chars = max(1, most_words - over_words), max(1, max_chars - over_chars)
    n = max(2, -(-(len(text) - over_chars) // own_chars), -(-(len(spans) - over_words) // own_words))

    def overlap_start(cut: int, low: int) -> int:
        """The earliest strong place before `cut` from which the overlap keeps its limits."""
        if not over_words:
            return cut
        k = before(cut) - over_words
        floor = max(low, cut - over_chars, int(starts[k]) if k > 0 else 0)
        lo, hi = np.searchsorted(at, [floor, cut])
        if lo == hi:
            return cut
        s = strength[lo:hi].copy()
        s[s < 2] = 0
        if not s.any():
            return cut
        return int(at[lo + int(np.argmax(np.minimum(s, 5)))])

    while True:
        for share in (0.3, 0.12, 0.0):
            targets = np.searchsorted(load, load[-1] * np.arange(1, n) / n)
            cuts = [0]
            for t in targets.tolist():
                t = min(max(t, cuts[-1] + 1), len(text))
                reach = int(len(text) / n * share)
                lo, hi = np.searchsorted(at, [max(cuts[-1] + 1, t - reach), t + reach + 1])
                if hi > lo:
                    near = at[lo:hi]
                    i = int(np.lexsort((np.abs(near - t), -strength[lo:hi]))[0])
                    t = int(near[i])
                else:
                    while t < len(text) and (0x300 <= ord(text[t]) < 0x370 or text[t] in "‍️") and share:
                        t += 1
                cuts.append(t)
            cuts = [c for i, c in enumerate(cuts) if i == 0 or cuts[i - 1] < c < len(text)] + [len(text)]
            out = [(overlap_start(a, cuts[i - 1] if i else 0) if i else 0, b, a) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            if all(b - s <= max_chars and tokens(int(count(s, b))) <= max_tokens for s, b, _ in out):
                return out
        n += max(1, n // 50)


def split_chunks(chunks: DataFrame, key: str = "chunk_id", text: str = "text", index: str = "chunk_index", max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(key, source_index, oversized, chunk_index, pieces, text, token_count, first): one row per piece.

    Texts within both limits, empty and null ones are one piece, untouched (null text: token_count 0), and stay in the
    JVM; only oversized ones go through Python, spread over all cores. chunk_index counts the pieces of
    a chunk from 0; source_index is the index the chunk had. first is where in `text` the piece's own
    part begins. Repeated rows come out repeatedly; other columns are ignored; an empty table gives no rows.
    """
    kind = chunks.schema[key].dataType.simpleString()
    c = chunks.select(F.col(key), F.col(index).cast("int").alias("source_index"), F.col(text).alias("text"), token_count(text).alias("token_count"))
    # so many words need so many characters and blanks: shorter texts' words aren't counted to find the big ones
    least = next(w for w in range(1, max_tokens + 2) if tokens(w) > max_tokens) * 2 - 1
    big = (F.length("text") > max_chars) | F.when(F.length("text") >= least, F.col("token_count") > max_tokens).otherwise(F.lit(False))
    fine = c.where(~F.coalesce(big, F.lit(False))).select(
        key, "source_index", F.lit(False).alias("oversized"), F.lit(0).alias("chunk_index"), F.lit(1).alias("pieces"), "text", "token_count", F.lit(0).alias("first")
    )

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, i, t in b.itertuples(index=False):
                parts = split_text(t, max_tokens, max_chars, overlap)
                rows += [(k, i, True, n, len(parts), t[s:e], tokens(len(WORDS.findall(t[s:e]))), f - s) for n, (s, e, f) in enumerate(parts)]
            out = pd.DataFrame(rows, columns=[key, "source_index", "oversized", "chunk_index", "pieces", "text", "token_count", "first"])
            yield out.astype({key: b[key].dtype, "source_index": "Int32"})

    cols = f"{key} {kind}, source_index int, oversized boolean, chunk_index int, pieces int, text string, token_count int, first int"
    cut = fan_out(c.where(big).select(key, "source_index", "text")).mapInPandas(pieces, cols)
    return fine.unionByName(cut)
