"""Pieces of DuckDB SQL that correspond to the column builders of functions.text."""

from __future__ import annotations

from reportloom.functions import text as T

BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_BLANK = BLANK.replace("[", "[^", 1)


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def words(c: str) -> str:
    return f"coalesce(len(regexp_extract_all({c}, '{NOT_BLANK}+')), 0)"


def tokens(c: str) -> str:
    return f"(CASE WHEN {words(c)} > 0 THEN greatest(1, CAST(floor({words(c)} * 1.3::DOUBLE) AS INT)) ELSE 0 END)"


def lower_tr(c: str) -> str:
    return f"lower(replace({c}, 'İ', 'i'))"


def fold(c: str) -> str:
    return f"lower(translate({c}, '{T.ACCENTED}', '{T.PLAIN}'))"


def ascii_key(c: str) -> str:
    return f"regexp_replace(regexp_replace({fold(c)}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def page_clean(c: str) -> str:
    t = f"regexp_replace(replace({c}, chr(0), ''), '[ \\t]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \\n\\r]+|[ \\n\\r]+$', '', 'g')"


def answer_words(c: str) -> str:
    t = f"regexp_replace({lower_tr(f'coalesce({c}, {chr(39)}{chr(39)})')}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')"
    return f"list_filter(string_split(trim({t}), ' '), lambda w: w <> '')"


def blank_words(c: str) -> str:
    t = lower_tr(f"coalesce({c}, '')")
    return f"list_distinct(list_filter(string_split_regex({t}, '[ \\t\\r\\n]+'), lambda w: w <> ''))"


def sentences(c: str) -> str:
    t = f"regexp_replace(coalesce({c}, ''), '([.!?])[ \\n]+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({t}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def one_blank(c: str) -> str:
    return f"trim(regexp_replace({c}, '[ \\t\\r\\n]+', ' ', 'g'))"


def inter(a: str, b: str) -> str:
    return f"len(list_distinct(list_filter({a}, lambda z: list_contains({b}, z))))"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {inter(a, b)} / len(list_distinct(list_concat({a}, {b})))::DOUBLE ELSE 0.0 END)"


def digest(parts: list[str], n: int = 24) -> str:
    joined = " || '|' || ".join(f"trim(coalesce(CAST({p} AS VARCHAR), ''))" for p in parts)
    return f"left(sha256({joined}), {n})"


def numbers(c: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all(replace(coalesce({c}, ''), ',', '.'), '-?[0-9]*\\.[0-9]+|[0-9]+'), lambda x: x::DOUBLE)))"


def has(c: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{p}')" for p in phrases) + ")"
