"""Bytes of posting lists from documents that are dealt by range of ids."""

from pyspark.sql import functions as F

from quillstack.functions import text as T
from quillstack.operators import index

DOCS = [(1, "b a b c"), (2, ""), (3, None), (4, "a a a"), (5, "é z"), (0, "a"), (1 << 21, "a b"), (1, "a x b")]


def test_bytes_of_documents(spark):
    """The same pieces as postings give; these move once, by term, as bytes."""
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    tokens = T.numbered(T.tokens_v1(F.col("text")))
    found = index.document_postings(docs, tokens)
    words = index.with_offsets(index.list_bytes(found)).cache()
    for bits in (1, 8):
        own = index.encoded_documents(docs, tokens, words, bits=bits)
        assert sorted(tuple(r) for r in own.collect()) == sorted(tuple(r) for r in index.encoded(found, words, bits=bits).collect())
    assert index.encoded_documents(docs.where("false"), tokens, words).count() == 0
    plan = index.encoded_documents(docs, tokens, words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(shiftright") == 1 and plan.count("Exchange hashpartitioning(term") <= 2  # lists, and words where they are not broadcast
    assert "_range" not in plan and "Sort" in plan
