"""Languages of texts and of their segments.

Method: multinomial naive Bayes over hashed character n-grams; the matrix of log probabilities is
broadcast, and units of text are scored in numpy batches. The classifier learns from the table's own labels: a bounded
sample, first as labelled, then, as labels are unreliable, sentence by sentence as the other half of the sample classes them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.functions.text import strip
from reportloom.session import Stash, fan_out

# The codes of ISO 639-1.
CODES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km "
    "kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr "
    "ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()
# Other notations of languages in lower case, by ISO 639-1 code.
NOTATIONS = {
    "tr": "tr|tur|turkish|türkçe|turkce|türkisch", "en": "en|eng|english|ingilizce|englisch", "de": "de|deu|ger|german|deutsch|almanca",
    "fr": "fr|fra|fre|french|français|fransızca", "es": "es|spa|spanish|español|ispanyolca", "it": "it|ita|italian|italiano|italyanca",
    "nl": "nl|nld|dut|dutch|nederlands|hollandaca", "az": "az|aze|azerbaijani|azerice", "pt": "pt|por|portuguese|português|portekizce",
    "ru": "ru|rus|russian|rusça", "ar": "ar|ara|arabic|arapça", "pl": "pl|pol|polish", "sv": "sv|swe|swedish", "el": "el|ell|gre|greek",
}
#: Rows of each label from which the classifier is fitted, about.
SAMPLE = 600
#: Rows of the matrix; the last is for what is no n-gram.
BITS = 16
ORDERS = (2, 3, 4)
#: Share of the log likelihood that counts as evidence, as n-grams overlap; what a language must lead by.
DAMPING, LEAD = 0.15, 3.0
#: Letters of the shortest unit that is classed by itself, and of one that proves a second language; words that make an unpunctuated line running text.
MIN_LETTERS, SECOND_LETTERS, MIN_WORDS = 20, 30, 8
#: Units longer than this are cut into stretches of about STRETCH characters.
STRETCH = 100
LONG_UNIT = 240

_SEPARATOR, _MARK = 255, "\ue000"
# list, table and contents lines: no running text
_LISTS = re.compile(r"^[ \t]*(?:[-*•–—][ \t].*(?:\d[ \t]*|:[ \t]*\d.*)|.*(?:\t| \| | ; |\.{4,}).*)$", re.M)
# candidates of boundaries, found by their first character: a stop with what may follow, an empty or ruled line, a slash
_MARKS = re.compile(
    r"[.!?…\n/](?:(?<=[.!?…])[\"'”’»)]*\s+(?:[/|~=*#–—-]+\s+)?(?=[^\W\d_a-zçğıöşüáéíóúñäßèàêə]|[\"“«(]|\d)|(?<=[.!?…])(?=[^\W\d_][^.])|(?<=\n)(?:\s*\n|[=*#–—-]{2,}\s*\n)|(?<=/)\s)"
)
_ENDS = re.compile(r"[.!?…][\"'”’»)]*\s*$")


def _table() -> np.ndarray:
    """Code of each code point below 0x10000: letters without case and accents 1 to 200, separators and blanks apart."""
    t = np.zeros(0x10000, np.uint8)
    for cp in range(0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if c.isalpha():
            d = unicodedata.normalize("NFKD", c.lower())[0]
            d = "i" if d == "ı" else d
            t[cp] = 1 + ord(d) - 97 if "a" <= d <= "z" else 30 + ord(d) % 170
        elif unicodedata.category(c) in ("Mn", "Cf"):
            t[cp] = 254
    t[ord(_MARK)] = _SEPARATOR
    return t


_CODES: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    """Letters as small numbers, everything else as 0; accents and format signs are left out."""
    if not _CODES:
        _CODES.append(_table())
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _CODES[0][np.minimum(cp, 0xFFFF)]
    out = out[out != 254]
    gap = out == 0
    return out[~(gap & np.concatenate([[False], gap[:-1]]))] if len(out) else out  # runs of other signs are one gap


def units(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, sentence) of the stretches that are classed; list and table lines are left out.

    A sentence ends with a stop or has MIN_WORDS words; a unit that is too short to be classed joins the one before.
    """
    body = _LISTS.sub(lambda m: "\n" * len(m.group()), text) if _LISTS.search(text) else text
    out: list[tuple[int, int, bool]] = []
    at = 0
    cuts = []
    for m in _MARKS.finditer(body):
        i, c = m.start(), body[m.start()]
        if c in ".!?…":  # after two letters, a digit, a percent sign or a bracket, so not after initials; unspaced, three letters
            p, spaced = body[i - 1 : i], m.end() > i + 1
            if not (p.isalpha() and body[i - 2 : i - 1].isalpha() and (spaced or body[i - 3 : i - 2].isalpha()) or p and (p in "%)" or p.isdigit() and spaced)):
                continue
            cuts.append((i + 1, m.end()))
        elif c == "\n" or body[i - 1 : i].isspace():
            cuts.append((i, m.end()))
    for end, after in [*cuts, (len(body), len(body))]:
        if end < at:
            continue
        part = body[at:end]
        letters = sum(map(str.isalpha, part)) if len(part) < 80 else MIN_LETTERS
        if letters >= MIN_LETTERS:
            ends = bool(_ENDS.search(part))
            sentence = ends or part.count(" ") >= MIN_WORDS or (len(part) > 120 and letters >= MIN_LETTERS)
            if len(part) > LONG_UNIT:
                a = at
                while end - a > 2 * STRETCH:
                    b = body.find(" ", a + STRETCH, a + 2 * STRETCH)
                    b = b if b > 0 else a + STRETCH
                    out.append((a, b, sentence))
                    a = b
                out.append((a, end, sentence))
            else:
                out.append((at, end, sentence))
        elif out and letters and out[-1][1] == at_before:
            out[-1] = (out[-1][0], end, out[-1][2])
        at_before = at = after
    return out


def grams(all_codes: np.ndarray) -> list[np.ndarray]:
    """For each order the row of the matrix of the n-gram that begins at each code; 2^BITS where a separator is in it."""
    c = all_codes.astype(np.uint32)
    out = []
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            out.append(np.full(len(c), 1 << BITS, np.int64))
            continue
        h, sep = np.full(m, n, np.uint32), np.zeros(m, bool)
        for i in range(n):
            h = (h ^ c[i : i + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            sep |= all_codes[i : i + m] == _SEPARATOR
        row = (h & np.uint32((1 << BITS) - 1)).astype(np.int64)
        row[sep] = 1 << BITS
        out.append(np.concatenate([row, np.full(n - 1, 1 << BITS, np.int64)]))
    return out


def joined_codes(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all parts, each after a separator and parted from it by gaps, and where the separators are."""
    text = "".join(f" {_MARK} {p.replace(_MARK, ' ')}" for p in parts)
    flat = codes(text)
    return flat, np.flatnonzero(flat == _SEPARATOR)


def batch_scores(parts: list[str], matrix: np.ndarray, slice_chars: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each part under each language (parts x languages), and the number of its letters."""
    out, letters = np.zeros((len(parts), matrix.shape[1]), np.float32), np.zeros(len(parts), np.int64)
    i = 0
    while i < len(parts):
        j, size = i, 0
        while j < len(parts) and (j == i or size + len(parts[j]) <= slice_chars):
            size += len(parts[j]) + 3
            j += 1
        flat, starts = joined_codes(parts[i:j])
        for row in grams(flat):
            out[i:j] += np.add.reduceat(matrix[row], starts, axis=0)
        letters[i:j] = np.add.reduceat(((flat > 0) & (flat < 254)).astype(np.int64), starts)
        i = j
    return out, letters


def iso_label(label: Column) -> Column:
    """The label as ISO 639-1 code: any of these codes, with or without a region, and the notations listed; null where it is missing or a filler."""
    t = F.lower(F.translate(strip(label), "İ", "i"))
    t = F.when(t.rlike(r"^[a-z]{2,3}[-_][a-z]{2,4}$"), F.regexp_extract(t, "^[a-z]+", 0)).otherwise(t)
    return F.coalesce(*[F.when(t.isin(*names.split("|")), F.lit(code)) for code, names in NOTATIONS.items()], F.when(t.isin(CODES), t))


class Model:
    """Languages and their log probabilities by n-gram."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        c = counts.astype(np.float64) + 0.05
        m = np.log(c / c.sum(axis=0)).astype(np.float32)
        self.matrix = np.vstack([m, np.zeros((1, len(languages)), np.float32)])

    def score(self, texts: list[str]) -> np.ndarray:
        return batch_scores(texts, self.matrix)[0]


def _count(rows: DataFrame, languages: list[str], models: list | None) -> list[np.ndarray]:
    """n-gram counts by language for each half of the sample; with models of the halves, unit by unit as the other half classes it."""
    shape = ((1 << BITS) + 1, len(languages))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros(shape, np.float32) for _ in range(2)]
        for b in batches:
            for lang, half, text in b.itertuples(index=False):
                parts = [text[s:e] for s, e, _ in units(text)]
                if models:
                    if not parts:
                        continue
                    s = models[1 - half].score(parts) * DAMPING
                    best = np.sort(s, axis=1)
                    own = s.argmax(axis=1)
                    sure = best[:, -1] - best[:, -2] > LEAD if s.shape[1] > 1 else np.ones(len(parts), bool)
                    todo = [(p, int(k)) for p, k, ok in zip(parts, own, sure) if ok]
                else:
                    todo = [(p, languages.index(lang)) for p in parts]
                for k in {k for _, k in todo}:
                    for row in grams(joined_codes([p for p, own in todo if own == k])[0]):
                        total[half][:, k] += np.bincount(row, minlength=shape[0]).astype(np.float32)
        yield pd.DataFrame({"half": [0, 1], "counts": [t.tobytes() for t in total]})

    out = [np.zeros(shape, np.float64) for _ in range(2)]
    for r in rows.select("lang", "half", "text").coalesce(4).mapInPandas(add, "half int, counts binary").collect():  # four matrices of fixed size
        out[r.half] += np.frombuffer(r.counts, np.float32).reshape(shape)
    return [c[:-1] for c in out]


def fit(labelled: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> Model | None:
    """The classifier, from about `sample` rows of each label, chosen by a hash of the key; None without any labelled row.

    Labels come in any notation. A language whose rows the other half mostly takes for others is left out.
    """
    spark = labelled.sparkSession
    d = labelled.select(F.col(key).alias("key"), iso_label(F.col(label)).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = {r.lang: r["count"] for r in d.groupBy("lang").count().collect()}  # at most as many rows as CODES has
    languages = sorted(n)
    if not languages:
        return None
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / n[k]))])
    h = F.xxhash64(F.col("key").cast("string"), F.lit("language sample"))
    stash = Stash(spark, "language-sample")
    rows = stash.put(d.where(F.pmod(h, F.lit(1 << 20)) < share[F.col("lang")] * F.lit(float(1 << 20))).select("lang", "text", F.pmod(F.shiftright(h, 32), F.lit(2)).cast("int").alias("half")).repartition(8))
    first = [Model(languages, c) for c in _count(rows, languages, None)]
    counts = _count(rows, languages, first)
    both = counts[0] + counts[1]
    kept = [i for i in range(len(languages)) if both[:, i].sum() > 0]
    second = Model([languages[i] for i in kept], both[:, kept])
    stash.drop(rows)
    return second


def classify(texts: DataFrame, model: Model | None, key: str, text: str, keep: tuple[str, ...] = (), segments: bool = True) -> DataFrame:
    """key, the columns in `keep`, language, confidence, languages, segments of each row.

    segments: (start, end, language, confidence, sentence) of consecutive stretches of one language, positions in
    characters; list and table lines belong to none. language is that of most letters, confidence its share of
    them times the mean confidence of its stretches. languages: those with a whole sentence. Null, empty and
    wordless texts have null language and empty arrays. Rows are independent and stay in their partition. Without
    `segments` that column isn't handed over, as Python's output can't be pruned by the plan.
    """
    spark = texts.sparkSession
    kinds = dict(texts.dtypes)
    shared = spark.sparkContext.broadcast((model.languages, model.matrix) if model else ([], None))
    cols = ", ".join(f"{c} {kinds[c]}" for c in (key, *keep))
    out = f"{cols}, language string, confidence double, languages array<string>"
    if segments:
        out += ", segments array<struct<start:int,end:int,language:string,confidence:double,sentence:boolean>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = shared.value
        for b in batches:
            spans, flat = [], []
            for t in b["_text"]:
                u = units(t) if t and names else []
                spans.append(u)
                flat += [t[s:e] for s, e, _ in u]
            s, letters = batch_scores(flat, matrix) if flat else (np.zeros((0, max(1, len(names)))), [])
            s = s * DAMPING
            best = s.argmax(axis=1)
            p = np.exp(s - s.max(axis=1, keepdims=True)) if len(s) else s
            conf = p.max(axis=1) / p.sum(axis=1) if len(s) else s
            rows, i = [], 0
            best, conf, letters = np.asarray(best).tolist(), np.asarray(conf).tolist(), np.asarray(letters).tolist()
            for u in spans:
                segs: list[list] = []
                size: dict[str, list[float]] = {}
                whole, running = set(), False
                for start, end, sentence in u:
                    lang, c, n = names[best[i]], float(conf[i]), letters[i]
                    lead = -np.log(max(1e-12, 1 - c))
                    acc = size.setdefault(lang, [0.0, 0.0])
                    acc[0] += n
                    acc[1] += n * c
                    if sentence and lead > LEAD and n >= SECOND_LETTERS:
                        whole.add(lang)
                    running |= sentence
                    if not segments:
                        pass
                    elif segs and segs[-1][2] == lang:
                        segs[-1] = [segs[-1][0], end, lang, min(c, segs[-1][3]), sentence or segs[-1][4]]
                    else:
                        segs.append([start, end, lang, c, sentence])
                    i += 1
                if size:
                    main = max(size, key=lambda k: (size[k][0], k))
                    if running and (main not in whole and len(whole) < 2):
                        whole = {main}  # all there is is short: the text is in its main language
                    total = sum(x[0] for x in size.values()) or 1.0
                    rows.append((main, size[main][1] / total, sorted(whole), segs))
                else:
                    rows.append((None, None, [], []))
            o = b.drop(columns="_text")
            o["language"], o["confidence"], o["languages"] = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
            if segments:
                o["segments"] = [[dict(zip(("start", "end", "language", "confidence", "sentence"), x)) for x in r[3]] for r in rows]
            yield o

    return fan_out(texts.select(key, *keep, F.col(text).alias("_text"))).mapInPandas(run, out)


def label_languages(spark: SparkSession, chunks: DataFrame, key: str = "chunk_id", text: str = "text", label: str = "language", segments: bool = True) -> DataFrame:
    """classify() with a classifier fitted on the table's own labels; column label_iso has the label as ISO code."""
    model = fit(chunks, key, text, label)
    c = chunks.select(key, F.col(text).alias("text"), iso_label(F.col(label)).alias("label_iso"))
    return classify(c, model, key, "text", ("label_iso",), segments)


def mislabelled(labels: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, language): languages of the texts with running text whose label is missing or not the main language, or that hold several languages."""
    bad = F.col("label_iso").isNull() | (F.col("label_iso") != F.col("language")) | (F.size("languages") > 1)
    return labels.where((F.size("languages") > 0) & bad).select(key, F.explode("languages").alias("language")).distinct()
