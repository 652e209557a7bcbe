"""Evaluation texts inside a corpus.

Method: rare n-gram seeds join corpus passages to test items, then Smith-Waterman alignment scores
paraphrased or edited copies. Of every window of `run` consecutive words of an item, the n-gram that is rarest
among the documents is a seed, so any document that holds such a window holds a seed of it: no exact leak is lost. For
edited copies, which may keep none of those, every n-gram of an item is a seed, however many items and documents hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.words import batch_grams, batch_words
from reportloom.operators.skew import salted_lookup
from reportloom.session import Stash, fan_out

#: Words that count as a leak when consecutive, and words of a seed.
RUN, SEED = 12, 5
#: Bits of the filter that spares the corpus' n-grams the shuffle: so many a seed, and so many at most; with more than four times the
#: seeds that this would fill there is no filter, and every n-gram goes on.
SEED_BITS, MOST_BITS = 16, 1 << 27
#: Alignment: a word that agrees, one that differs, one left out; reported from this score on.
MATCH, MISMATCH, GAP, MIN_SCORE = 1.0, -0.6, -0.4, 8.0
#: Cells of the tables that alignments of one step share.
CELLS = 1 << 17


def _padded(parts: list[np.ndarray], pad: int) -> np.ndarray:
    out = np.full((len(parts), max(map(len, parts))), pad, np.uint64)
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


def smith_waterman(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each two sequences of word hashes: its score, and the longest common run of words.

    One pass over the second sequences, vectorised over the first ones and over pairs of about equal length (gaps in the first by a
    running maximum). What pads the shorter ones agrees with nothing, so it adds to no score.
    """
    score, longest = np.zeros(len(pairs)), np.zeros(len(pairs), np.int32)
    order = sorted((i for i, (a, b) in enumerate(pairs) if len(a) and len(b)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    while order:
        take = max(1, CELLS // max(len(pairs[i][0]) for i in order[-256:]))
        now, order = order[-min(256, take) :], order[: -min(256, take)]
        a, b = _padded([pairs[i][0] for i in now], 1), _padded([pairs[i][1] for i in now], 2)
        h, run = np.zeros((len(now), a.shape[1] + 1)), np.zeros((len(now), a.shape[1] + 1), np.int32)
        best, most = np.zeros(len(now)), np.zeros(len(now), np.int32)
        steps = -GAP * np.arange(a.shape[1] + 1)
        for w in b.T:
            same = a == w[:, None]
            n = np.zeros_like(h)
            n[:, 1:] = np.maximum(0.0, np.maximum(h[:, :-1] + np.where(same, MATCH, MISMATCH), h[:, 1:] + GAP))
            h = np.maximum.accumulate(n + steps, axis=1) - steps
            np.maximum(best, h.max(axis=1), out=best)
            run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            np.maximum(most, run.max(axis=1), out=most)
        score[now], longest[now] = best, most
    return score, longest


def stretches(places: np.ndarray, item: int, seed: int) -> list[tuple[int, int]]:
    """Where a document can align with an item of `item` words: around seeds, as far as the item reaches."""
    cuts = np.flatnonzero(np.diff(places) > item)
    first, last = places[np.concatenate([[0], cuts + 1])], places[np.concatenate([cuts, [len(places) - 1]])]
    return [(max(0, int(a) - item), int(b) + seed + item) for a, b in zip(first, last)]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", run: int = RUN, seed: int = SEED, edited: bool = True) -> DataFrame:
    """(doc_key, item_key, score, longest_run, item_words) of each document and item that share a seed.

    score is the best Smith-Waterman alignment by words around the shared seeds, longest_run the most consecutive
    words in common. Without `edited` only the seeds for `run` words running are used: those leaks are complete, copies with
    shorter runs are not. Words are runs of letters and digits, without case and accents. Texts that are null,
    empty or shorter than `seed` words leak nothing; items of fewer than `run` words are seeded as one window.
    Repeated rows and repeated keys with other texts count once per key (best score); a null key is a key. Empty tables give no rows.
    Runs when called; the result is a table in the shared folder that belongs to the caller.

    The documents are read and hashed once; of those without a seed's n-gram nothing is kept. The filter that tells is broadcast,
    of a size that follows the seeds and is bounded. Candidates are pairs of document and item with a seed in common; only the
    stretch of a document around its seeds goes to the alignment. Frequent n-grams, items and documents are split by salts.
    """
    spark = docs.sparkSession
    dkind, ikind = docs.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    stash = Stash(spark, "leaks")

    def hashed(name: str, kept=None):
        """Rows of (key, hash of the text, words, n-grams, their places, the n-gram one place before each or 0), without texts that have no n-gram that `kept` lets through."""

        def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words, ends = batch_words(b.column(2).to_pylist())
                of, at, g = batch_grams(words, ends, seed)
                pre = np.where(at > 0, np.roll(g, 1), np.uint64(0))
                if kept is not None:
                    ok = kept(g)
                    of, at, g, pre = of[ok], at[ok], g[ok], pre[ok]
                some = np.unique(of)
                inside = np.zeros(len(ends) - 1, bool)
                inside[some] = True
                sizes = np.diff(ends)
                take = pa.array(some)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), _lists(words[np.repeat(inside, sizes)].view(np.int64), sizes[some]), _lists(g.view(np.int64), np.bincount(of, minlength=len(sizes))[some]), _lists(at.astype(np.int32), np.bincount(of, minlength=len(sizes))[some]), _lists(pre.view(np.int64), np.bincount(of, minlength=len(sizes))[some])],
                    names=[name, "h", "words", "g", "at", "pre"],
                )

        return run_batches

    cols = "h bigint, words array<bigint>, g array<bigint>, at array<int>, pre array<bigint>"
    it = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("k"), F.xxhash64(item_text).alias("h"), F.col(item_text).alias("_t")).dropDuplicates(["k", "h"])
    it, seen = stash.put_counted(it.mapInArrow(hashed("k"), f"k {ikind}, {cols}"), grams=F.sum(F.size("g")))
    grams = it.select(F.struct("k", "h").alias("i"), F.explode(F.arrays_zip("g", "at", "pre")).alias("x")).select("i", "x.g", F.col("x.at").alias("pos"), "x.pre")

    kept, shared = None, None
    if SEED_BITS * seen["grams"] <= 4 * MOST_BITS:
        bits = min(MOST_BITS, 1 << max(16, (SEED_BITS * max(1, seen["grams"]) - 1).bit_length()))

        def places(g: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for x in (g & np.uint64(bits - 1), (g >> np.uint64(32)) & np.uint64(bits - 1)):
                yield (x >> np.uint64(3)).astype(np.int64), np.uint8(1) << (x & np.uint64(7)).astype(np.uint8)

        def to_filter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mask = np.zeros(bits // 8, np.uint8)
            for b in batches:
                for byte, bit in places(b["g"].to_numpy().view(np.uint64)):
                    np.bitwise_or.at(mask, byte, bit)
            yield pd.DataFrame({"bits": [mask.tobytes()]})

        mask = np.zeros(bits // 8, np.uint8)
        for p in grams.select("g").coalesce(4).mapInPandas(to_filter, "bits binary").collect():  # at most four filters of bounded size
            mask |= np.frombuffer(p.bits, np.uint8)
        shared = spark.sparkContext.broadcast(mask.tobytes())

        def kept(g: np.ndarray) -> np.ndarray:
            own, ok = np.frombuffer(shared.value, np.uint8), np.ones(len(g), bool)
            for byte, bit in places(g):
                ok &= own[byte] & bit > 0
            return ok

    d = docs.where(F.col(doc_text).isNotNull()).select(F.col(doc_key).alias("k"), F.xxhash64(doc_text).alias("h"), F.col(doc_text).alias("_t"))
    d = stash.put(fan_out(d).mapInArrow(hashed("k", kept), f"k {dkind}, {cols}"))
    hits = d.select(F.struct("k", "h").alias("d"), F.explode(F.arrays_zip("g", "at", "pre")).alias("x")).select("d", "x.g", F.col("x.at").alias("pos"), "x.pre")
    # how many documents and items hold a gram; windows choose the rarest, ties by the gram's hash, the same in all texts
    docs_with = d.select(F.explode(F.array_distinct("g")).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    items_with = it.select(F.explode(F.array_distinct("g")).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    known = items_with.join(docs_with, "g", "left").select("g", F.coalesce("n", F.lit(0)).alias("n"), "df")
    rated = salted_lookup(grams, known, "g", "inner", rows=seen["grams"])
    if edited:
        # of a run of words in common only the first n-gram goes on: the others follow one that both texts have before them
        seeds = rated.where("n > 0").select("g", "i", F.col("pre").alias("_pre")).distinct()
    else:
        lists = rated.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "df", "g"))).alias("x"))  # one text's own words
        width = run - seed + 1
        windows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("x") - F.lit(width - 1))), lambda i: F.array_min(F.transform(F.slice("x", i, width), lambda w: F.struct(w["n"].alias("n"), w["df"].alias("df"), w["g"].alias("g")))))
        # a gram that no document has makes no pair; its window isn't in the corpus then
        seeds = lists.select("i", F.explode(F.array_distinct(windows)).alias("x")).where("x.n > 0").select(F.col("x.g").alias("g"), "i")
    met_at = salted_lookup(hits, seeds, "g", "inner")
    if edited:
        met_at = met_at.where((F.col("pre") != F.col("_pre")) | (F.col("pre") == 0))
    pairs = met_at.groupBy("d", "i").agg(F.array_sort(F.collect_set("pos")).alias("at"))  # one document's own places
    pairs, met = stash.put_counted(pairs, n=F.count(F.lit(1)))
    pairs = salted_lookup(pairs, it.select(F.struct("k", "h").alias("i"), F.col("words").alias("item")), "i", "inner", rows=met["n"])
    own = d.select(F.struct("k", "h").alias("d"), "words").dropDuplicates(["d"])
    met_words = salted_lookup(pairs, own, "d", "inner", rows=met["n"])
    begin = F.greatest(F.lit(0), F.element_at("at", 1) - F.size("item"))
    window = F.slice("words", begin + 1, F.element_at("at", -1) - begin + F.lit(seed) + F.size("item"))
    texts = met_words.select(F.col("d.k").alias("_d"), F.col("i.k").alias("_i"), "item", window.alias("part"), F.transform("at", lambda p: p - begin).alias("at"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def split(column: pa.ListArray, kind: str) -> list[np.ndarray]:
            flat, offsets = column.flatten().to_numpy(zero_copy_only=False).view(kind), column.offsets.to_numpy()
            return np.split(flat, (offsets - offsets[0])[1:-1]) if len(column) else []

        for b in batches:
            of, todo = [], []
            iw = split(b.column(2), np.uint64)
            for n, (item, part, at) in enumerate(zip(iw, split(b.column(3), np.uint64), split(b.column(4), np.int32))):
                for x, y in stretches(at, len(item), seed):
                    of.append(n)
                    todo.append((item, part[x:y]))
            s, r = smith_waterman(todo)
            score, longest = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int32)
            np.maximum.at(score, of, np.round(s, 6))
            np.maximum.at(longest, of, r)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array(longest), pa.array(np.array(list(map(len, iw)), np.int32))], names=[doc_key, item_key, "score", "longest_run", "item_words"])

    out = f"{doc_key} {dkind}, {item_key} {ikind}, score double, longest_run int, item_words int"
    scored = texts.mapInArrow(align, out).groupBy(doc_key, item_key)
    return stash.finish(scored.agg(F.max("score").alias("score"), F.max("longest_run").alias("longest_run"), F.max("item_words").alias("item_words")))
