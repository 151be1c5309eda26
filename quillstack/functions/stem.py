"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), as a lookup over distinct terms."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The suffix rules of the published steps, in the order in which they are tried; of each step, the
#: first suffix that a word ends with decides.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_SEQUENCE = re.compile("v+c+")
_SHORT = re.compile("cvc$")


def _shape(word: str) -> str:
    """c or v for each character; a y is a vowel after a consonant. All but ASCII letters are consonants."""
    shape = ""
    for k, c in enumerate(word):
        vowel = c in "aeiou" or (c == "y" and k > 0 and shape[-1] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(word: str) -> int:
    return len(_SEQUENCE.findall(_shape(word)))


def _has_vowel(word: str) -> bool:
    return "v" in _shape(word)


def _is_short(word: str) -> bool:
    return bool(_SHORT.search(_shape(word))) and word[-1] not in "wxy"


def _ends_double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _strip(word: str, rules: tuple, least: int) -> str:
    for suffix, instead in rules:
        if word.endswith(suffix):
            kept = word[: -len(suffix)]
            fits = _measure(kept) > least and (suffix != "ion" or kept.endswith(("s", "t")))
            return kept + instead if fits else word
    return word


@lru_cache(maxsize=1 << 16)
def stem(term: str) -> str:
    """The stem of a lower-case term. Terms of two UTF-8 bytes at most are their own; bytes that are not ASCII count
    as consonants, each for itself."""
    raw = term.encode("utf-8")
    if len(raw) <= 2:
        return term
    word = raw.decode("latin-1")
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]

    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((len(s) for s in ("ed", "ing") if word.endswith(s) and _has_vowel(word[: -len(s)])), 0)
        if cut:
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _ends_double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _is_short(word):
                word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"

    word = _strip(word, STEP_2, 0)
    word = _strip(word, STEP_3, 0)
    word = _strip(word, tuple((s, "") for s in STEP_4), 1)
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _is_short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word.encode("latin-1").decode("utf-8", "replace")


@F.pandas_udf(StringType())
def porter_stem(term: pd.Series) -> pd.Series:
    return term.map(stem, na_action="ignore")


def stem_terms(tokens: DataFrame, column: str = "term") -> DataFrame:
    """``tokens`` with ``column`` stemmed: each distinct term goes through Python once, and joins back."""
    stems = tokens.select(F.col(column).alias("_term")).distinct().withColumn("_stem", porter_stem("_term"))
    return tokens.join(stems, F.col(column) == F.col("_term"), "left").withColumn(column, F.col("_stem")).drop("_term", "_stem")
