"""Words of texts as hashes: runs of letters and digits, without case and accents."""

from __future__ import annotations

import unicodedata

import numpy as np

FNV = np.uint64(0x9E3779B97F4A7C15)
#: An odd base of the words' polynomial hashes, and its inverse modulo 2^64.
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
#: Characters folded and hashed at once, about; sign between texts, no letter or digit.
SLICE, BETWEEN = 1 << 19, "\ue000"
_tables: dict[str, np.ndarray] = {}


def fold(text: str) -> str:
    """Lower case without accents; dotless i as i. Code points that vanish (accents, format signs) part no words."""
    t = text.lower()
    if not t.isascii():
        t = _fold_signs(t)
        if not t.isascii():
            t = "".join(c for c in t if c.isascii() or unicodedata.category(c) not in ("Mn", "Cf"))
    return t


def _fold_signs(lower: str) -> str:
    return unicodedata.normalize("NFKD", lower).replace("ı", "i").casefold()


def _kind_of(cp: int) -> int:
    """1 for letters and digits, 2 for what vanishes, 0 for the rest."""
    c = chr(cp)
    return 1 if c.isalnum() else 2 if unicodedata.category(c) in ("Mn", "Cf") else 0


def _kinds(codes: np.ndarray) -> np.ndarray:
    if "kind" not in _tables:
        _tables["kind"] = np.array([_kind_of(cp) for cp in range(0x20000)], np.uint8)
    high = codes >= 0x20000
    kind = _tables["kind"][np.where(high, 0, codes)]
    if high.any():
        found, at = np.unique(codes[high], return_inverse=True)
        kind[high] = np.array([_kind_of(int(cp)) for cp in found], np.uint8)[at]
    return kind


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("power", ())) < n:
        for name, base in (("power", BASE), ("inverse", INVERSE)):
            p = np.full(n + SLICE, base, np.uint64)
            p[0] = 1
            _tables[name] = np.multiply.accumulate(p)
    return _tables["power"][:n], _tables["inverse"][:n]


def batch_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the folded words of all texts, in order, and where each text's begin (one place more than texts); none for null."""
    hashes, ends, i = [], [np.zeros(1, np.int64)], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= SLICE):
            size += len(texts[j] or "") + 1
            j += 1
        joined = "".join((t or "").replace(BETWEEN, " ") + BETWEEN for t in texts[i:j]).lower()
        codes = np.frombuffer((joined if joined.isascii() else _fold_signs(joined)).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kinds(codes)
        if (kind == 2).any():
            codes, kind = codes[kind != 2], kind[kind != 2]
        inside = np.concatenate([[False], kind == 1, [False]])
        start, end = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
        power, inverse = _powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes.astype(np.uint64) * power[:-1], out=sums[1:])  # all modulo 2^64
        h = (sums[end] - sums[start]) * inverse[start]
        h = (h ^ (h >> np.uint64(31)) ^ (end - start).astype(np.uint64)) * FNV
        hashes.append(h ^ (h >> np.uint64(29)))
        ends.append(np.searchsorted(start, np.flatnonzero(codes == ord(BETWEEN))) + ends[-1][-1])
        i = j
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(ends).astype(np.int64)


def fold_words(text: str | None) -> np.ndarray:
    """64-bit hashes of the folded words, in order; none for null."""
    return batch_words([text])[0]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, in order; none if there are fewer words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = words[:m].copy()
    with np.errstate(over="ignore"):
        for i in range(1, n):
            out = (out ^ (out >> np.uint64(29))) * FNV + words[i : i + m]
        out ^= out >> np.uint64(32)
    return out


def batch_grams(words: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the runs of n words of each text of batch_words."""
    g = gram_hashes(words, n)
    of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    whole = of[: len(g)] == of[len(words) - len(g) :] if len(g) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    return of[at], at - ends[of[at]], g[at]
