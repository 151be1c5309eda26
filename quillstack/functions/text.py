"""Text normalisation and tokenizing, as column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Stand-ins for apostrophes inside words while a text is cut at everything else; both are private-use characters.
STRAIGHT, CURLY = "", ""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The built-in stopwords.
STOPWORDS = ("the", "and", "is", "in", "it", "of", "to", "a", "for", "that", "on", "with", "as", "are", "by", "this", "was", "an", "be", "or", "from")


def lit_regexp_replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def trim_edges(text: Column) -> Column:
    """Without blanks, tabs and line ends at either end."""
    return F.btrim(text, F.lit(" \t\n\r"))


def normalize_whitespace(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; carriage returns vanish, joining what is around them."""
    return F.btrim(lit_regexp_replace(F.translate(text, "\r", ""), r"[ \t\n\x0B\f]+", " "), F.lit(" "))


def sanitize(text: Column) -> Column:
    """For a field of a tab-separated file: tabs and line ends are blanks, then white space is normalised."""
    return normalize_whitespace(F.translate(text, "\t\n\r", "   "))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition, which no expression has."""
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def controls_out(text: Column, tabs_as_blanks: bool = True) -> Column:
    """Line feeds as blanks, other control characters deleted; tabs as blanks, or deleted too."""
    kept = F.translate(text, "\n\t", "  ") if tabs_as_blanks else F.translate(text, "\n", " ")
    return lit_regexp_replace(kept, r"[\x00-\x1F]", "")


def dehyphenate(text: Column) -> Column:
    """Words joined that a hyphen splits at a line's end."""
    return lit_regexp_replace(text, r"-[\r\n]+", "")


def line_ends_as_blanks(text: Column) -> Column:
    return F.translate(text, "\n\r\t", "   ")


def lower(text: Column, ascii_only: bool = False) -> Column:
    return F.translate(text, UPPER, LOWER) if ascii_only else F.lower(text)


def _inside(text: Column, mark: str, stand_in: str) -> Column:
    """``mark`` between two letters as its stand-in; twice, since neighbouring matches share a letter."""
    for _ in range(2):
        text = lit_regexp_replace(text, rf"(\p{{L}}){mark}(\p{{L}})", f"$1{stand_in}$2")
    return text


def _runs(text: Column, more: str = "") -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[\p{{L}}\p{{N}}{more}]+"), F.lit(0))


def _words(text: Column, stand_ins: str, marks: str) -> Column:
    return F.transform(_runs(text, stand_ins), lambda t: F.translate(t, stand_ins, marks))


def tokens_v1(text: Column, ascii_lower: bool = False) -> Column:
    """Lower-case runs of letters and digits; a straight apostrophe between two letters is part of its word.

    Texts without an apostrophe, which most are, take one pass of one expression.
    """
    low = lower(text, ascii_lower)
    return F.when(F.contains(text, F.lit("'")), _words(_inside(low, "'", STRAIGHT), STRAIGHT, "'")).otherwise(_runs(low))


def numbered(tokens: Column) -> Column:
    """array<struct<term, pos>> of terms in order; positions count from 1."""
    return F.transform(tokens, lambda t, i: F.struct(t.alias("term"), (i + 1).alias("pos")))


def originals_v2(text: Column) -> Column:
    """Runs of letters and digits in their own case; straight and curly apostrophes between letters are kept."""
    some = F.contains(text, F.lit("'")) | F.contains(text, F.lit("’"))
    return F.when(some, _words(_marked_v2(text), STRAIGHT + CURLY, "'’")).otherwise(_runs(text))


def _marked_v2(text: Column) -> Column:
    """Apostrophes between letters as their stand-ins, which are as long."""
    for _ in range(2):
        text = lit_regexp_replace(lit_regexp_replace(text, r"(\p{L})'(\p{L})", f"$1{STRAIGHT}$2"), r"(\p{L})’(\p{L})", f"$1{CURLY}$2")
    return text


def gaps_v2(text: Column) -> Column:
    """What stands before each token of ``originals_v2``, and after the last."""
    return F.split(_marked_v2(text), rf"[\p{{L}}\p{{N}}{STRAIGHT}{CURLY}]+", -1)


def tokens_v2(text: Column) -> Column:
    """The same in lower case."""
    return F.transform(originals_v2(text), F.lower)


def query_tokens(text: Column) -> Column:
    """A query's words: lower-case runs of ASCII letters, digits and apostrophes wherever they stand."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))


def is_number(term: Column) -> Column:
    return term.rlike(r"^\p{Nd}+$")


def split_and_trim(text: Column, separator: str = " | ") -> Column:
    """Parts between separators, trimmed, without empty ones."""
    import re

    parts = F.transform(F.split(text, re.escape(separator).replace("\\ ", " ")), trim_edges)
    return F.filter(parts, lambda x: x != "")


def section_name(section: Column) -> Column:
    """What stands before the first colon, if that is among the first 50 characters; else body."""
    at = F.locate(":", section)
    return F.when((at > 0) & (at <= 50), F.substring(section, F.lit(1), at - 1)).otherwise(F.lit("body"))


def section_text(section: Column) -> Column:
    at = F.locate(":", section)
    return F.when((at > 0) & (at <= 50), F.substring(section, at + 1, F.char_length(section))).otherwise(section)


def first_non_empty(*columns: Column) -> Column:
    """The first that is neither null nor empty; else empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))
