"""Porter's stemming algorithm (M. F. Porter, 1980) as a pandas UDF over token arrays, memoised per worker."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F, types as T

_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    if c in _VOWELS:
        return False
    return i == 0 or not _consonant(w, i - 1) if c == "y" else True


def _measure(stem: str) -> int:
    kinds = "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem)))
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:]))


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


# The suffix rules of steps 2, 3 and 4.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _by_rules(w: str, rules) -> str:
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            return stem + new if _measure(stem) > 0 else w
    return w


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix):
                if _has_vowel(w[: -len(suffix)]):
                    w = w[: -len(suffix)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _by_rules(_by_rules(w, _STEP2), _STEP3)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            s = w[: -len(suffix)]
            if _measure(s) > 1 and (suffix != "ion" or s.endswith(("s", "t"))):
                w = s
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: None if ts is None else [stem(t) for t in ts])
