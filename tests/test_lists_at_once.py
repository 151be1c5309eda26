"""Posting lists coded, and terms grouped, a column at a time: the same as one by one."""

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillstack.functions import codec
from quillstack.operators import index

_POSTINGS = pa.list_(pa.struct([("doc_id", pa.int32()), ("tf", pa.int32()), ("positions", pa.list_(pa.int32()))]))
_TOKENS = pa.list_(pa.struct([("term", pa.string()), ("pos", pa.int32())]))
_posting = st.tuples(st.integers(0, 2**31 - 1), st.lists(st.integers(1, 2**31 - 1), max_size=4).map(sorted))


@given(st.lists(st.none() | st.lists(_posting, max_size=5, unique_by=lambda p: p[0]).map(sorted), max_size=6), st.integers(0, 2))
def test_lists_are_coded_at_once(lists, skip):
    rows = pa.array([own if own is None else [{"doc_id": d, "tf": len(p), "positions": p} for d, p in own] for own in lists], _POSTINGS).slice(skip)
    told = [own if own is None else codec.encode_low_first(codec.posting_numbers(own)) for own in lists][skip:]
    assert codec.encode_lists(rows).to_pylist() == told
    assert codec.decode_lists(pa.array([b"x", *told], pa.binary()).slice(1)).to_pylist() == rows.to_pylist()


def test_odd_bytes():
    coded = codec.encode_low_first
    assert codec.decode_lists(pa.array([b"", coded([0]), None, coded([1, 7, 0, 9]), coded([2, 3, 1, 4, 1, 1, 1])], pa.binary())).to_pylist() == [
        [], [], None, [{"doc_id": 7, "tf": 0, "positions": []}], [{"doc_id": 3, "tf": 1, "positions": [4]}, {"doc_id": 4, "tf": 1, "positions": [1]}]
    ]
    for cut in ([1], [1, 7], [1, 7, 2, 1]):
        with pytest.raises(ValueError):
            codec.decode_lists(pa.array([coded(cut), coded([1, 7, 2, 1, 1])], pa.binary()))


@given(st.lists(st.none() | st.lists(st.tuples(st.sampled_from(["a", "b", "é", "z", ""]), st.integers(1, 9)), max_size=9), max_size=6), st.integers(0, 2))
def test_terms_are_grouped_at_once(lists, skip):
    """Sorted by bytes, positions too, in whatever order tokens come."""
    rows = pa.array([own if own is None else [{"term": t, "pos": p} for t, p in own] for own in lists], _TOKENS).slice(skip)
    told = [[{"term": t, "positions": sorted(p for s, p in own if s == t)} for t in sorted({t for t, _ in own}, key=str.encode)] for own in (x or [] for x in lists[skip:])]
    assert index._runs(rows).to_pylist() == told


def test_parts_group_their_own_tokens(spark, monkeypatch):
    """A document's tokens come to its part as they are, and terms are grouped there with all of the part's."""
    from pyspark.sql import functions as F

    from quillstack.functions import text as T

    docs = spark.createDataFrame([(1, "b a b"), (2, "a")], "doc_id long, text string")
    found, words = index.numbered_documents(docs, T.numbered(T.tokens_v1(F.col("text"))), parts=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "array_sort" not in plan and "sort_array" not in plan
    assert sorted((r["doc_id"], [(p["term"], p["positions"]) for p in r["postings"]]) for r in found.collect()) == [(1, [("a", [2]), ("b", [1, 3])]), (2, [("a", [1])])]
