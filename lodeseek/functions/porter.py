"""The stemming tokenizer of the full-text index: Unicode folding and Porter's algorithm (M. F. Porter, 1980)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_VOWELS = "aeiou"


def _is_consonant(w: str, i: int) -> bool:
    c = w[i]
    if c in _VOWELS:
        return False
    return not (c == "y" and i > 0 and _is_consonant(w, i - 1))


def _shape(w: str) -> str:
    """The word as a string of c and v."""
    return "".join("c" if _is_consonant(w, i) else "v" for i in range(len(w)))


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _is_consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


# The suffix tables of steps 2, 3 and 4 of the published algorithm.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _table(text: str) -> list[tuple[str, str]]:
    pairs = [p.partition(":")[::2] for p in text.split()]
    return sorted(pairs, key=lambda p: -len(p[0]))


_T2, _T3, _T4 = _table(_STEP2), _table(_STEP3), sorted(_STEP4.split(), key=len, reverse=True)


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """Porter's stem of a lower-case word. As in the index, other signs count as consonants, byte by byte; words under 3 or over 64 bytes stay."""
    if not w.isascii():
        return _stem(w.encode().decode("latin-1")).encode("latin-1").decode("utf-8", "ignore") if len(w.encode()) <= 64 else w
    return _stem(w)


def _stem(w: str) -> str:
    if len(w) < 3 or len(w) > 64:
        return w
    if w.endswith(("sses", "ies")) and len(w) > (4 if w.endswith("sses") else 3):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed") and len(w) > 3:
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _doubled(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_T2, _T3):
        for suffix, new in table:
            if len(w) > len(suffix) and w.endswith(suffix):
                if _measure(w[: -len(suffix)]) > 0:
                    w = w[: -len(suffix)] + new
                break
    for suffix in _T4:
        if len(w) > len(suffix) and w.endswith(suffix):
            rest = w[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
                w = rest
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=4096)
def _plain(c: str) -> str:
    """A letter or digit in lower case without diacritics; a blank for what separates words, nothing for a mark."""
    kind = unicodedata.category(c)
    if kind[0] == "M":
        return ""
    if kind[0] not in "LN" and kind != "Co":
        return " "
    low = c.lower()
    base = unicodedata.normalize("NFD", low)
    return base[0] if len(base) > 1 and all(unicodedata.combining(x) for x in base[1:]) else low


def folded_words(text: str | None) -> list[str]:
    """Folded and split words of a text, unstemmed."""
    if not text:
        return []
    return re.findall(r"[a-z0-9]+", text.lower()) if text.isascii() else "".join(map(_plain, text)).split()


def porter_tokens(text: str | None) -> list[str]:
    """Folded, split and stemmed words of a text."""
    return [stem(w) for w in folded_words(text)]


@F.pandas_udf(ArrayType(StringType()))
def porter_tokens_udf(text: pd.Series) -> pd.Series:
    return text.map(porter_tokens)
