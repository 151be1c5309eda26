"""Text functions against literal cases and a plain model."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("function", "given_", "expected"),
    [
        (T.tokens_v1, "Don't 'tis rock'n'roll a'b'c'd x'1 dogs' can''t", ["don't", "tis", "rock'n'roll", "a'b'c'd", "x", "1", "dogs", "can", "t"]),
        (T.tokens_v1, "state-of-the-art", ["state", "of", "the", "art"]),
        (T.tokens_v2, "O’Neill’s it's", ["o’neill’s", "it's"]),
        (T.originals_v2, "O’Neill’s It's", ["O’Neill’s", "It's"]),
        (T.query_tokens, "'tis Dogs'", ["'tis", "dogs'"]),
        (T.normalize_whitespace, "  a \t b\r\nc\rd ", "a b cd"),
        (T.sanitize, " a\tb\nc\rd ", "a b c d"),
        (T.trim_edges, "\t a b \r\n", "a b"),
        (lambda c: T.controls_out(c, tabs_as_blanks=False), "a\tb\nc\rd\x01e", "ab cde"),
        (T.controls_out, "a\tb\nc\rd\x01e", "a b cde"),
        (T.dehyphenate, "hyphen-\nated and re-\r\njoined", "hyphenated and rejoined"),
        (T.line_ends_as_blanks, "a\nb\rc\td", "a b c d"),
        (T.split_and_trim, "A | B |  | C: d ", ["A", "B", "C: d"]),
        (T.section_name, "Intro: text", "Intro"),
        (T.section_text, "Intro: text", " text"),
        (T.section_name, "x" * 60 + ": y", "body"),
        (T.section_text, "no colon", "no colon"),
        (lambda c: T.lower(c, True), "ÉCOLE Ω A", "École Ω a"),
    ],
)
def test_text(spark, function, given_, expected):
    assert one(spark, given_, function) == expected


def test_numbers_and_fallbacks(spark):
    rows = spark.createDataFrame([("2020", "", None), ("a1", None, "z"), ("٣", "y", "z")], "a string, b string, c string")
    found = rows.select(T.is_number(F.col("a")).alias("n"), T.first_non_empty(F.col("b"), F.col("c")).alias("f")).collect()
    assert [(r["n"], r["f"]) for r in found] == [(True, ""), (False, "z"), (True, "y")]


def model(text):
    """Runs of letters and digits; an apostrophe counts between letters."""
    letter = lambda c: unicodedata.category(c).startswith("L")
    word = lambda i: letter(text[i]) or unicodedata.category(text[i]).startswith("N") or (text[i] == "'" and 0 < i < len(text) - 1 and letter(text[i - 1]) and letter(text[i + 1]))
    found, held = [], ""
    for i in range(len(text)):
        if word(i):
            held += text[i]
        elif held:
            found.append(held)
            held = ""
    return [*found, held] if held else found


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("ab'É1٣ß-_ \n’λ2"), max_size=30), min_size=20, max_size=60))
def test_tokens_are_the_models(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    for i, s, tokens in rows.select("i", "s", T.tokens_v1(F.col("s"))).collect():
        assert tokens == model(s.lower()), (i, s)


def test_stopwords_leave_gaps(spark):
    from quillstack.operators.analyze import explode_tokens

    rows = spark.createDataFrame([(1, "the cat of x")], "doc_id long, s string")
    texts = F.array(F.struct(F.lit("title").alias("name"), F.col("s").alias("text")))
    assert {(r["term"], r["pos"]) for r in explode_tokens(rows, "doc_id", texts).collect()} == {("cat", 2), ("x", 4)}


def test_every_stopword_is_a_token():
    assert len(T.STOPWORDS) == 21
    assert all(re.fullmatch("[a-z]+", w) for w in T.STOPWORDS)
