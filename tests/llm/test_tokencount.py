"""Token counts against the library, which encodes whole texts."""

import random

import public_tokenizers
import pytest
import sentencepiece

from quillstack.llm import tokencount

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["the ", "word", "\n", "é", "e\u0301", "𝒳", " ", "  ", "    ", "▁", "\t", "\x00", "１", "ﬁ", "<s>", "</s>", "<unk>", "<0x0A>", "漢字", "\u3000", "12345", "don't", ".", "\r\n", "\u200b", "\ufeff"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    some = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(200))) for _ in range(300)]
    return [None, "", " ", "\n", "a", " a", "a ", *some, some[1], some[1], "many words of a text " * 50_000, "x" * 200_000, " " * 50_000]


def test_pre_tokens_are_whole_texts(library, texts):
    own = tokencount.Pieces(MODEL)
    for t in texts:
        found = own.pre_tokens(t or "")
        assert "".join(found) == (f" {t}" if t else "")
        assert sum(own.count(found)) == len(library.encode(t or ""))


@pytest.mark.parametrize("batch_bytes", [1, 3000, 8 << 20])
def test_counts(spark, library, texts, batch_bytes, monkeypatch):
    monkeypatch.setattr(tokencount, "RANGE_BYTES", 300 if batch_bytes > 1 else 8 << 20)
    monkeypatch.setattr(tokencount, "TABLE_ROW", 5 if batch_bytes > 1 else 8192)
    docs = spark.createDataFrame([(None if k == 3 else k // 2, t, "x", k) for k, t in enumerate(texts)], "doc_id long, text string, word string, n_bytes int").repartition(3)
    found = tokencount.count(docs, MODEL, limit=100, batch_bytes=batch_bytes)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    told = [(None if k == 3 else k // 2, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for k, t in enumerate(texts)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, told))


def test_numbers_come_back():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    for lengths in ([0], [], [3, 0, 5], rng.integers(0, 40, 100).tolist()):
        ends = np.cumsum(np.array(lengths, np.int64))
        numbers = rng.integers(0, 1 << rng.integers(1, 40), int(sum(lengths)))
        found, to = tokencount.unpacked(pa.array(tokencount.packed(numbers, ends), pa.binary()))
        assert found.tolist() == numbers.tolist() and to.tolist() == ends.tolist()


def test_a_word_of_all_documents_is_a_row_a_batch(spark):
    """Of 2000 documents with the same words, each batch has one table of them."""
    from pyspark.sql import functions as F

    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("the same words in all of them").alias("text")).repartition(2)
    thin = docs.select(F.col("doc_id").alias("id"), "text")
    split = thin.mapInArrow(lambda b: tokencount._split(b, MODEL, 8 << 20), tokencount._SPLIT_KINDS)
    assert split.where("words IS NOT NULL").count() == 2


def test_empty_and_other_vocabularies(spark):
    assert tokencount.count(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
    with pytest.raises(Exception):  # noqa: B017  no model at all
        tokencount.Pieces(public_tokenizers.path("byte_bpe_50k.json"))
