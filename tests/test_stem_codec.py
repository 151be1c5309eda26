import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.functions import codec
from quillstack.functions.stem import stem, stem_terms
from quillstack.plans.catalog import STEMS


@pytest.mark.parametrize(("word", "expected"), STEMS.items())
def test_published_stems(word, expected):
    assert stem(word) == expected


def test_stemmer_counts_bytes():
    assert stem("é") == "é"  # two bytes
    assert stem("ées") == "ée"
    assert stem("naïvely") == stem("naïvely")
    assert stem("psychology") == "psychologi"  # no rule for logi


def test_stems_join_back(spark):
    rows = spark.createDataFrame([(1, "cats"), (2, "cats"), (3, None), (4, "ponies")], "i int, term string")
    assert [(r["i"], r["term"]) for r in stem_terms(rows).orderBy("i").collect()] == [(1, "cat"), (2, "cat"), (3, None), (4, "poni")]


def test_vbyte_goldens():
    numbers = codec.posting_numbers([(1, [113, 413]), (4, [255]), (6, [787])])
    assert codec.encode_low_first(numbers).hex(" ") == "83 81 82 f1 2c 82 83 81 7f 81 82 81 13 86"
    assert codec.postings_of(numbers) == [(1, 2, [113, 413]), (4, 1, [255]), (6, 1, [787])]
    assert codec.decode_high_first(b"\x81\x01\x02") == [129, 2]


@given(st.lists(st.integers(0, 2**40)))
def test_codecs_invert(numbers):
    assert codec.decode_low_first(codec.encode_low_first(numbers)) == numbers
    assert codec.decode_high_first(codec.encode_high_first(numbers)) == numbers


def test_sizes_are_those_of_bytes(spark):
    lists = [[(1, [1, 1, 130])], [(5, [20000]), (700, [3, 9]), (1_000_000, [1])], []]
    rows = spark.createDataFrame([(i, [{"doc_id": d, "tf": len(p), "positions": p} for d, p in x]) for i, x in enumerate(lists)], "i int, postings array<struct<doc_id:int,tf:int,positions:array<int>>>")
    found = rows.select(codec.posting_size(F.col("postings")).alias("n"), F.octet_length(codec.encode_postings("postings")).alias("m"), codec.decode_postings(codec.encode_postings("postings")).alias("back"), "postings").collect()
    assert all(r["n"] == r["m"] and r["back"] == r["postings"] for r in found)
