"""Analysis for full-text search: words, accents off, Porter stems."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_WORD = re.compile(r"[^\W_]+")


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return len(re.findall("vc", re.sub(r"(.)\1*", r"\1", _shape(stem))))


def _shape(w: str) -> str:
    out = ""
    for c in w:
        out += "v" if c in "aeiou" or c == "y" and out.endswith("c") else "c"
    return out


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _short_end(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


# The suffix tables of Porter's algorithm.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@lru_cache(maxsize=200_000)
def stem(w: str) -> str:
    """Porter's stem of a lower-case word of more than two ASCII letters or digits; other words stay."""
    if len(w) < 3 or len(w) > 20 or not w.isascii() or w[-1] < "a":  # each rule begins with a letter at the end
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        ending = "ed" if w.endswith("ed") else "ing" if w.endswith("ing") else ""
        if ending and _has_vowel(w[: -len(ending)]):
            w = w[: -len(ending)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _doubled(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for step in (STEP2, STEP3):
        s = _longest(w, step)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + step[s]
    s = _longest(w, STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def fold(s: str) -> str:
    s = s.lower()
    if s.isascii():
        return s
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)))


def analyze(s: str) -> list[str]:
    return [stem(w) for w in _WORD.findall(fold(s))]


@F.pandas_udf(ArrayType(StringType()))
def analyze_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in batches:
        yield x.map(analyze, na_action="ignore")


def plain_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits: an analyzer without stems that stays in the JVM."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
