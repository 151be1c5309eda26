"""Document gaps as lists by range of ids: one exchange of texts and one of lists, and back."""

from collections import defaultdict

from pyspark.sql import functions as F

from quillstack.functions import text as T
from quillstack.operators import index
from quillstack.plans import catalog
from quillstack.sources import spread

DOCS = [(1, "b a b c"), (2, ""), (3, None), (4, "a a a"), (5, "é z"), (0, "a"), (1 << 21, "a b"), (1, "a x b"), (1 << 40, "a")]


def test_gaps_as_lists(spark):
    """Ids on several rows are one document; ranges, and gaps over them, of any width."""
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    told = defaultdict(set)
    for d, s in DOCS:
        for t in (s or "").split():
            told[t].add(d)
    for bits in (1, 8, 20):
        coded = index.gap_lists(docs, T.tokens_v1(F.col("text")), bits=bits)
        each = defaultdict(list)
        for r in sorted(coded.collect(), key=lambda r: r["block"]):
            each[r["term"]] += r["gaps"]
        assert each == {t: [y - x for x, y in zip([0, *sorted(own)], sorted(own), strict=False)] for t, own in told.items()}
        assert sorted(tuple(r) for r in index.documents_of_gaps(coded, "id").collect()) == sorted((t, d) for t, own in told.items() for d in own)
    assert index.documents_of_gaps(index.gap_lists(docs.where("false"), T.tokens_v1(F.col("text")))).count() == 0


def test_postings_are_sent_as_lists_once(spark, monkeypatch):
    monkeypatch.setitem(spread.spread.__kwdefaults__, "small", 0)
    plan = catalog.QUERIES["gap_decode_docids"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan
