"""Texts that lost their end at a field limit or in transfer.

Method: intact values are cut artificially to make positives; a logistic regression over hashed features
of the closing characters, of punctuation and of the length against the source's limits is trained on them and scores every record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.operators.skew import salted_lookup
from reportloom.session import Stash, fan_out

#: Rows from which the classifier is fitted, about; weights; features of a text at most.
SAMPLE, BITS, WIDTH = 8000, 18, 64
#: A length is a limit of a source if it is that many times as frequent as the lengths around it, and that isn't chance: the logarithm of
#: the odds against as many rows (Poisson) is at least this. Both are the same whatever the number of texts or sources.
LIMIT_TIMES, LIMIT_ODDS = 30.0, 20.0
#: Sources with limits whose table is broadcast; more are joined.
BROADCAST_SOURCES = 50_000
#: Score from which a text counts as cut off, and the share of cut texts the scores are corrected to.
THRESHOLD, PRIOR = 0.5, 0.15

# What cutting may leave behind, by kind.
TRACES = [
    ("zero", re.compile(r"[\x00]+$")),
    ("broken", re.compile(r"�+$")),
    ("dots", re.compile(r"\s*(?:…|\.\.\.|\[…\]|\[\.\.\.\]|\(…\))$")),
    ("entity", re.compile(r"&(?:[a-zA-Z]{0,8}|#\w{0,6})$")),
    ("escape", re.compile(r"\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?$")),
    ("tag", re.compile(r"</?[a-zA-Z]{0,10}$")),
    ("hyphen", re.compile(r"(?<=[^\W\d_])-$")),
    ("blank", re.compile(r"(?<=\S)[ \t]+$")),
]
MARKS = ["…", "...", " […]", " ...", "\x00", "\x00\x00\x00", "�", "&am", "&", "&quo", "<b", "<", "</", "\\u01", "\\u", "-", " "]
_STOP = re.compile(r"[.!?][\"'”’»)\]]*$")
_LIST = re.compile(r"^\s*[-*•–—]\s+.*:\s*[\d.,]+$")
_URL = re.compile(r"^\s*\w+://\S+$")
_SENTENCE = re.compile(r"(?<=[^\W\d_]{3})[.!?][\"'”’»)]*(?=\s)|(?<=[%)\d])[.!?](?=\s+[^\W\d_a-z])")
_WORD = re.compile(r"\S+")
_DIGITS = re.compile(r"\d+")


def _columns(line: str) -> int:
    return max(line.count("\t"), line.count(" | "), line.count(" ; "))


_WHOLE = re.compile(r"^(stop|list|row|url)$|^open(-head|comma|line)-\d-(capital|most)$")


def _kind(lines: list[str]) -> str:
    """What the last line looks like."""
    last = lines[-1]
    if _URL.match(last):
        return "url"
    if _LIST.match(last):
        return "list"
    if n := _columns(last):
        before = next((x for x in reversed(lines[:-1]) if x.strip()), "")
        return "row" if n == _columns(before) and last[-1:].isdigit() else "partrow"
    if _STOP.search(last):
        return "stop"
    words = last.split()
    capital = sum(w[:1].isupper() or not w[:1].isalpha() for w in words)
    head = len(lines) > 1 and not lines[-2].strip()
    after = "" if head else "only" if len(lines) < 2 else "comma" if lines[-2].rstrip().endswith(",") else "line"
    return f"open{'-head' if head else ''}{after}-{min(len(words), 7)}-{'capital' if capital == len(words) else 'most' if capital * 2 > len(words) else 'few'}"


def features(text: str, char_limits: tuple[int, ...] = (), byte_limits: tuple[int, ...] = ()) -> list[int]:
    """Hashed features of the end of a text, of fixed count at most WIDTH; row 0 is the constant."""
    tail = text[-400:]  # features are of the closing characters; the length is of the whole text
    trace, body = "none", tail
    for name, pattern in TRACES:
        if m := pattern.search(body):
            trace, body = name, body[: m.start()]
            break
    body = body.rstrip(" \t\x00�")
    lines = body.split("\n")
    kind = _kind(lines)
    words = body.split()[-3:]
    w = [x.lower() for x in words[::-1]] + ["", "", ""]
    shape = _DIGITS.sub("9", body[-24:])
    n, b = len(text), len(text.encode("utf-8", "surrogatepass"))
    limit = "at" if n in char_limits or any(0 <= x - b <= 3 for x in byte_limits) else "near" if any(0 < x - n <= 15 for x in char_limits) else "off"
    stop = bool(_STOP.search(body))
    last = lines[-1].strip().lower()
    f = [f"t:{trace}", f"k:{kind}", f"tk:{trace}:{kind.split('-')[0]}", f"l:{limit}", f"lk:{limit}:{kind.split('-')[0]}", f"lt:{limit}:{trace}", f"st:{stop}:{trace}"]
    f += [f"c{i}:{shape[-i:]}" for i in range(1, 9)] + [f"r{i}:{trace != 'none'}:{tail[-i:]}" for i in (1, 2, 3)]
    f += [f"w:{_DIGITS.sub('9', w[0])}", f"wk:{kind.split('-')[0]}:{_DIGITS.sub('9', w[0])}", f"w2:{_DIGITS.sub('9', w[1] + ' ' + w[0])}", f"w3:{_DIGITS.sub('9', ' '.join(w[2::-1]))}"]
    f += [f"line:{_DIGITS.sub('9', last)}" if len(last) < 80 else "longline", f"lw:{min(len(last.split()), 12)}:{stop}", f"wl:{min(len(w[0]), 12)}:{stop}"]
    f += [f"up:{words[-1][:1].isupper() if words else ''}:{kind.split('-')[0]}", f"open:{body.count('(') > body.count(')')}:{stop}", f"short:{min(n, 120) // 20}:{kind.split('-')[0]}"]
    before = next((x.strip().lower() for x in lines[-2:-4:-1] if x.strip()), "")
    f += [f"first:{kind.split('-')[0]}:{last.split(' ')[0]}", f"above:{_DIGITS.sub('9', before)}" if len(before) < 40 else "longabove"]
    return [0, *(1 + crc32(x.encode("utf-8", "surrogatepass")) % ((1 << BITS) - 1) for x in f[: WIDTH - 1])]


def length_counts(docs: DataFrame, source: str, text: str) -> DataFrame:
    """(source, m, n, rows): how many different texts of a source have a length, in characters and in bytes (m); short texts left out."""
    d = docs.select(F.coalesce(F.col(source), F.lit("")).alias("source"), F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("h")).where("chars > 60").distinct()
    m = d.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("m"), F.col("chars").alias("n")), F.struct(F.lit("bytes").alias("m"), F.col("bytes").alias("n")))).alias("x"))
    return m.groupBy("source", F.col("x.m").alias("m"), F.col("x.n").alias("n")).agg(F.count(F.lit(1)).alias("rows"))


def field_limits(counts: DataFrame) -> DataFrame:
    """(source, chars, bytes): the lengths at which texts of each source pile up, of the result of length_counts; only sources with any."""
    near = counts.groupBy("source", "m", F.floor(F.col("n") / 200).alias("g")).agg(F.sum("rows").alias("all"))
    j = counts.withColumn("g", F.floor(F.col("n") / 200)).join(near, ["source", "m", "g"])
    usual = (F.col("all") - F.col("rows") + 0.5) / 199
    times = F.col("rows") / usual
    peaks = j.where((times >= LIMIT_TIMES) & (F.col("rows") * (F.log(times) - 1) + usual >= LIMIT_ODDS))
    of = lambda m: F.array_sort(F.collect_list(F.when(F.col("m") == m, F.col("n")))).alias(m)  # noqa: E731  at most a few in each stretch of lengths
    return peaks.groupBy("source").agg(of("chars"), of("bytes"))


def with_limits(docs: DataFrame, limits: DataFrame, sources: int, rows: int) -> DataFrame:
    """Adds chars and bytes, the limits of the column `source`; null where it has none."""
    of = limits.withColumnRenamed("source", "_known")
    d = docs.withColumn("_known", F.coalesce("source", F.lit("")))
    return (d.join(F.broadcast(of), "_known", "left") if sources <= BROADCAST_SOURCES else salted_lookup(d, of, "_known", rows=rows)).drop("_known")


def examples(text: str, limits: tuple[tuple[int, ...], tuple[int, ...]], seed: int) -> list[tuple[str, int]]:
    """Artificial cases from one text that ends as it should: cut ones (1) and such as end at a sentence, a line or with it (0)."""
    r = np.random.default_rng(seed)
    out = [(text, 0)]
    sentences = [m.end() for m in _SENTENCE.finditer(text)]
    breaks = [m.start() for m in re.finditer(r"\n\s*\n", text)]
    for ends in (sentences, breaks):
        if ends:
            out.append((text[: ends[int(r.integers(len(ends)))]], 0))
    if sentences and r.random() < 0.5:  # a writer's own dots after a whole sentence, and a stop of another kind
        t = text[: sentences[int(r.integers(len(sentences)))]]
        out.append((t[:-1] + ("…", "...", "!", "…")[int(r.integers(4))], 0))
    if sentences and r.random() < 0.5:  # or none at all
        t = text[: sentences[int(r.integers(len(sentences)))]]
        out.append((t[:-1] + ("", "", " ", "  ")[int(r.integers(4))], 0))
    chars, byts = limits
    for k in range(5):
        long = [x for x in chars if x < len(text)]
        if k == 0 and long:
            at, mark = long[int(r.integers(len(long)))], ""
        elif k == 1 and byts and byts[0] < len(text.encode("utf-8", "surrogatepass")):
            t = text.encode("utf-8", "surrogatepass")[: byts[int(r.integers(len(byts)))]].decode("utf-8", "replace" if r.random() < 0.5 else "ignore")
            at, mark = len(t.rstrip("�")), "�" if t.endswith("�") else ""
        else:
            at = int(r.integers(max(1, len(text) // 6), max(2, len(text))))
            mark = MARKS[int(r.integers(len(MARKS)))] if k > 2 else ""
        head = text[:at]
        if mark in ("…", "...", " […]", " ...", " ") or (k == 2 and not mark):  # such cutters step back to the end of a word
            head = head[: head.rfind(" ")] if head.rfind(" ") > 0 else head
        line = head[head.rfind("\n") + 1 :]
        following = text[len(head) : len(head) + 1]
        inner = following.isalnum() or (not _STOP.search(head.rstrip()) and following not in ("\n", ""))
        if not head.strip() or not line.strip() or (_columns(line) and not re.search(r"[^\W\d_]$", head)) or (_LIST.match(line) and line[-1:].isdigit()):
            continue
        if inner:
            out.append((head + mark, 1))
    return out


def train(x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.15, l2: float = 1e-6) -> np.ndarray:
    """Weights of a logistic regression by AdaGrad; x has feature rows, padded with the last weight's row, which stays 0."""
    w, g = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-6)
    r = np.random.default_rng(7)
    for _ in range(epochs):
        order = r.permutation(len(y))
        for i in range(0, len(order), 256):
            k = order[i : i + 256]
            p = 1 / (1 + np.exp(-np.clip(w[x[k]].sum(axis=1), -30, 30)))
            rows, err = x[k].ravel(), np.repeat(p - y[k], x.shape[1])
            u, inv = np.unique(rows, return_inverse=True)
            grad = np.bincount(inv, err, len(u)) / len(k) + l2 * w[u]
            g[u] += grad * grad
            w[u] -= rate * grad / np.sqrt(g[u])
            w[-1] = 0.0
    w[0] += np.log(PRIOR / (1 - PRIOR)) - np.log(max(1e-9, y.mean()) / max(1e-9, 1 - y.mean())) if 0 < y.mean() < 1 else 0.0
    return w


def _limits(x) -> tuple[int, ...]:
    return () if x is None else tuple(int(v) for v in x)


def _pad(rows: list[list[int]]) -> np.ndarray:
    out = np.full((len(rows), WIDTH), 1 << BITS, np.int32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def find_truncated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", sample: int = SAMPLE) -> DataFrame:
    """(key, source, score, truncated) of each row; score is the probability that the text was cut off.

    Null and blank texts and single words (placeholders) have score 0. Without a text to learn from, all scores are 0. Repeated rows come out
    repeatedly; a null source is a source of its own in the limits and stays null. The classifier is fitted when the operator is called:
    on about `sample` different texts chosen by a hash of the text; limits and scores come from all rows. Repeating
    texts, under the same or other keys, changes no score.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "truncation")
    counts, seen = stash.put_counted(length_counts(docs, source, text), n=F.sum(F.when(F.col("m") == "chars", F.col("rows"))))
    limits, known = stash.put_counted(field_limits(counts), n=F.count(F.lit(1)))
    stash.drop(counts)
    h = F.xxhash64(F.col(text), F.lit("truncation sample"))
    rows = docs.where(F.regexp_like(F.col(text), F.lit(r"\S"))).select(F.col(source).alias("source"), F.col(text).alias("text"), h.alias("h"))
    rows = rows.where(F.pmod("h", F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(1, seen["n"])))))
    rows = with_limits(rows.dropDuplicates(["source", "h"]), limits, known["n"], sample)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for s, t, seed, chars, byts in b.itertuples(index=False):
                own = _limits(chars), _limits(byts)
                size = len(t.encode("utf-8", "surrogatepass"))
                if len(t) in own[0] or any(0 <= v - size <= 3 for v in own[1]) or any(p.search(t) for _, p in TRACES) or not _WHOLE.match(_kind(t.rstrip().split("\n"))):
                    continue
                out += [(s or "", seed, n, np.array(features(e, *own), np.int32), y) for n, (e, y) in enumerate(examples(t, own, seed & 0x7FFFFFFF))]
            if out:
                yield pd.DataFrame(out, columns=["s", "h", "n", "x", "y"])

    # a bounded sample but much work per row: a stated number of parts isn't coalesced
    got = rows.select("source", "text", "h", "chars", "bytes").repartition(2 * spark.sparkContext.defaultParallelism).mapInPandas(make, "s string, h bigint, n int, x array<int>, y int").toPandas()  # about ten short rows of each sampled text
    if len(got):
        got = got.sort_values(["h", "s", "n"])  # so that the same texts make the same classifier, however they are parted
        # a second round leaves out the ends of real texts that the first takes for cut
        x, y = _pad([list(v) for v in got["x"]]), got["y"].to_numpy().astype(float)
        w = train(x, y, epochs=3)
        doubtful = (y == 0) & (w[x].sum(axis=1) > 0)
        w = train(x[~doubtful], y[~doubtful])
    else:
        w = np.zeros((1 << BITS) + 1)
        w[0] = -30.0
    shared = spark.sparkContext.broadcast(w.astype(np.float32))
    kinds = dict(docs.dtypes)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        for b in batches:
            blank = np.array([not t or len(t.split(None, 2)) < 2 for t in b["_text"]], bool)
            x = _pad([[1 << BITS] if e else features(t, _limits(c), _limits(o)) for t, c, o, e in zip(b["_text"], b["chars"], b["bytes"], blank)])
            p = 1 / (1 + np.exp(-np.clip(weights[x].sum(axis=1).astype(float), -30, 30)))
            p[blank] = 0.0
            yield b[["_key", "source"]].rename(columns={"_key": key}).assign(score=p, truncated=p >= THRESHOLD)

    every = fan_out(docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), F.col(text).alias("_text")))
    scored = with_limits(every, limits, known["n"], seen["n"]).mapInPandas(score, f"{key} {kinds[key]}, source string, score double, truncated boolean")
    return stash.finish(scored)


def truncation_rates(scored: DataFrame) -> DataFrame:
    """(source, texts, truncated, share) per source."""
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if("truncated").alias("truncated"), F.round(F.avg(F.col("truncated").cast("int")), 6).alias("share"))
