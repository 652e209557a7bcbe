"""Column builders for text: cleaning, counting, folding, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blank (Unicode white space and the ASCII separators).
# Low ones are listed one by one: so a pattern tests them with one look-up.
BLANKS = r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without blanks of any kind at either end; null stays null."""
    return F.regexp_replace(col(c), f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def word_count(c: Column | str) -> Column:
    """Runs of non-blank characters; null gives 0."""
    return F.coalesce(F.regexp_count(col(c), F.lit(f"[^{BLANKS}]+")), F.lit(0))


def token_count(c: Column | str) -> Column:
    """max(1, int(words * 1.3)), 0 without words; the product alone gives both, as one word makes 1."""
    return F.floor(word_count(c) * F.lit(1.3)).cast("int")


def lower_tr(c: Column | str) -> Column:
    """Lower case with the dotted capital I as plain i, so both engines agree."""
    return F.lower(F.translate(col(c), "İ", "i"))


# Accented letters and what they fold to, letter by letter.
ACCENTED = "ÇĞİIÖŞÜÂÎÛÉÈÊËÁÀÄÃÅÍÌÏÓÒÔÕÚÙÑçğıöşüâîûéèêëáàäãåíìïóòôõúùñ"
PLAIN = "cgiiosuaiueeeeaaaaaiiioooouuncgiosuaiueeeeaaaaaiiioooouun"
# Words of address that are no part of a person's name.
TITLES = ["sayın", "sayin", "sn", "dr", "prof", "doç", "doc", "av", "mr", "ms", "mrs"]
# Namespace of names in the domain name system (RFC 4122), as hex.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
# Phrases that try to steer a model, masked in retrieved text, and what masks them.
INJECTIONS = [r"ignore\s+(all\s+)?previous\s+instructions", r"system\s+prompt\s+override", r"disregard\s+all\s+(prior\s+)?constraints", r"you\s+are\s+now\s+an?\s+unfiltered", r"forget\s+all\s+rules", r"print\s+system\s+prompt"]
MASK = "[UNTRUSTED DATA BLOCKED: Prompt Injection Attempt Removed]"
# Key names whose values are secrets.
SECRET_KEYS = "(?i)(password|secret|token|api_?key|authorization)"


def page_clean(c: Column | str) -> Column:
    """Without NUL, runs of blanks and tabs as one blank, three or more line ends as two, trimmed; null stays null."""
    t = F.regexp_replace(F.regexp_replace(col(c), "\\x00", ""), "[ \\t]+", " ")
    return F.regexp_replace(F.regexp_replace(t, "\\n{3,}", "\n\n"), "^[ \\n\\r]+|[ \\n\\r]+$", "")


def needs_ocr(c: Column | str) -> Column:
    """A page without text or with fewer than 50 characters; null counts as empty."""
    return F.length(F.coalesce(col(c), F.lit(""))) < 50


def is_meaningful(c: Column | str) -> Column:
    """15 or more trimmed characters and a letter or digit; null isn't."""
    t = F.coalesce(F.trim(col(c)), F.lit(""))
    return (F.length(t) >= 15) & t.rlike(r"[\p{L}\p{N}_]")


def chunk_hash(doc: Column, index: Column, text: Column) -> Column:
    """First 16 hex digits of SHA-256 of doc:index:trimmed text."""
    return F.substring(F.sha2(F.concat_ws(":", doc, index.cast("string"), F.trim(text)), 256), 1, 16)


def uuid5(c: Column | str) -> Column:
    """UUID version 5 of a name in the DNS namespace; null stays null."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(col(c), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def mock_embedding(c: Column | str, dims: int = 384) -> Column:
    """Unit vector made from the SHA-256 bytes of a text, repeated up to `dims`; a stand-in where no encoder is at hand."""
    h = F.sha2(F.coalesce(col(c), F.lit("")), 256)
    one = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(h, i * 2 + 1, 2), 16, 10).cast("double") / 127.5 - 1.0)
    raw = F.flatten(F.array_repeat(one, -(-dims // 32)))
    raw = F.slice(raw, 1, dims)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: x / norm)


def fold_letters(c: Column | str) -> Column:
    """Lower case, accents folded to ASCII letters."""
    return F.lower(F.translate(col(c), ACCENTED, PLAIN))


def ascii_key(c: Column | str) -> Column:
    """Letters and digits in lower-case ASCII, everything else one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(fold_letters(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def stable_digest(parts: list[Column], length: int = 24) -> Column:
    """First hex digits of SHA-256 of the trimmed parts joined by bars; null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.trim(F.coalesce(p.cast("string"), F.lit(""))) for p in parts]), 256), 1, length)


def entity_name(kind: Column, name: Column, ticker: Column) -> Column:
    """Name for comparison: ticker for a company that has one, no titles for a person, upper case for a date, else the ASCII key."""
    words = F.filter(F.split(F.regexp_replace(lower_tr(name), "[.,]", " "), " +"), lambda w: (w != "") & ~F.array_contains(F.array(*map(F.lit, TITLES)), w))
    return F.when((kind == "Company") & (F.coalesce(ticker, F.lit("")) != ""), F.upper(ticker)).when(kind == "Person", ascii_key(F.array_join(words, " "))).when(kind == "Date", F.upper(F.trim(name))).otherwise(ascii_key(name))


def one_blank(c: Column | str) -> Column:
    """Trimmed, runs of white space as one blank."""
    return F.trim(F.regexp_replace(col(c), "[ \\t\\r\\n]+", " "))


def turkish_upper(c: Column | str) -> Column:
    """Upper case with Turkish letters as ASCII."""
    return F.upper(F.translate(col(c), "çğıöşüÇĞİÖŞÜi", "cgiosuCGIOSUI"))


def truncate_words(c: Column | str, n: int) -> Column:
    """At most n characters, cut at the last blank, with an ellipsis; shorter texts stay."""
    t = col(c)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, n), " [^ ]*$", ""), F.lit("…")))


def answer_words(c: Column | str) -> Column:
    """Array of lower-case words (letters, digits, underscore); null gives an empty array."""
    t = F.regexp_replace(lower_tr(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}_]+", " ")
    return F.filter(F.split(F.trim(t), " "), lambda w: w != "")


def number_set(c: Column | str) -> Column:
    """Distinct numbers in a text (comma read as point), in order; null gives an empty array."""
    t = F.translate(F.coalesce(col(c), F.lit("")), ",", ".")
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"-?[0-9]*\.[0-9]+|[0-9]+"), F.lit(0)), lambda x: x.cast("double"))))


def sentences(c: Column | str) -> Column:
    """Pieces after . ! or ? and blanks, trimmed, empty ones left out; null gives an empty array."""
    parts = F.split(F.coalesce(col(c), F.lit("")), "(?<=[.!?])[ \\n]+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def cited_numbers(c: Column | str, n_sources: Column) -> Column:
    """Numbers of [n] or [Source n] that name one of n_sources sources, in order, each once."""
    found = F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(?i)\[(?:source )?([0-9]{1,6})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= n_sources))))


def mask_injections(c: Column | str) -> Column:
    """Steering phrases replaced by MASK."""
    return F.regexp_replace(col(c), "(?i)" + "|".join(f"(?:{p})" for p in INJECTIONS), MASK)


def redact(props: Column) -> Column:
    """A string map with the values of secret keys and bearer values replaced."""
    return F.transform_values(props, lambda k, v: F.when(k.rlike(SECRET_KEYS), F.lit("[redacted]")).otherwise(F.regexp_replace(v, "(?i)bearer [a-z0-9._-]+", "bearer [redacted]")))


def file_parts(c: Column | str) -> Column:
    """struct(ticker, year, report_type, language) of names like T__Y__type__lang__n; a year that's no number is 2025, missing parts are null."""
    stem = F.regexp_replace(F.regexp_replace(col(c), "^.*[:/]", ""), "\\.[a-z]+$", "")
    p = F.split(stem, "__")
    at = lambda i: F.try_element_at(p, F.lit(i))
    full = F.size(p) >= 4
    return F.struct(
        F.when(full, at(1)).otherwise(F.nullif(F.regexp_extract(stem, "([A-Z]{4,6})", 1), F.lit(""))).alias("ticker"),
        F.coalesce(F.when(full, at(2)).otherwise(F.regexp_extract(stem, "(20[0-9]{2})", 1)).try_cast("int"), F.lit(2025)).alias("year"),
        F.when(full, at(3)).alias("report_type"),
        F.when(full, at(4)).alias("language"),
    )
