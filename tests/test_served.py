"""What a written index serves: completions by prefix, and searches that leave out ranges of ids."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillstack.operators import index, search, suggest


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def corpus(spark):
    """8000 documents; a few short ones, close to each other, hold the words of the searches often."""
    rng = random.Random(1)
    texts = {}
    for i in range(8000):
        words = ["the"] * rng.randrange(1, 4) + [f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 60))]
        if rng.random() < 0.7:
            words += ["cell"] * rng.randrange(1, 3)
        texts[i] = words
    for i in range(4100, 4115):
        texts[i] = ["the", "cell", "the", "cell"]
    rows = [(d, k + 1, t) for d, words in texts.items() for k, t in enumerate(words)]
    tokens = spark.createDataFrame(rows, "doc_id long, pos int, term string").repartition(4)
    docs = spark.createDataFrame([(d, f"doc{d}") for d in texts], "doc_id long, orig_id string")
    return index.build(tokens, docs)


@pytest.fixture(scope="module")
def loaded(spark, corpus, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index"))
    corpus.write(at)
    return index.Index.load(spark, at)


def rows(found):
    return [(r["doc_id"], round(r["score"], 9), r["term_frequencies"]) for r in found.collect()]


@pytest.mark.parametrize(("mode", "tf_mode", "terms"), [("and", "binary", ["the", "cell"]), ("or", "actual", ["the", "the", "w7"]), ("and", "actual", ["w3", "unknown"]), ("or", "binary", ["unknown"])])
def test_bounded_search_is_the_search(loaded, mode, tf_mode, terms):
    for k, first in ((12, 1), (7000, 2)):
        search.FIRST_BLOCKS = first
        assert rows(search.bounded(loaded, terms, mode, tf_mode, k)) == rows(search.score(loaded, terms, mode, tf_mode, k))
    search.FIRST_BLOCKS = 8


def test_most_ranges_are_not_read(spark, corpus):
    """Of 1000 ranges of 8 ids, those with the short documents are read, and the scan is told which."""
    stats = index.corpus_stats(corpus.docs, corpus.doc_stats)
    held = index.with_lengths(corpus.postings).cache()
    own = index.Index(corpus.docs, held, corpus.lexicon, corpus.doc_stats, corpus=stats, blocks=index.posting_blocks(held, stats, 3).cache())
    report = {}
    found = rows(search.bounded(own, ["the", "cell"], k=10, bits=3, report=report))
    assert [d for d, *_ in found] == list(range(4100, 4110))
    assert report["ranges"] > 950 and report["read"] < 100
    other = {}  # another mean length than the ranges were written for: their bounds still hold
    changed = index.Index(corpus.docs.limit(4000), held, corpus.lexicon, corpus.doc_stats, blocks=own.blocks)
    assert rows(search.bounded(changed, ["the", "cell"], k=10, bits=3, report=other)) == rows(search.score(changed, ["the", "cell"]))
    search.MOST_LISTED = 5  # more are left than a list has: they are joined
    assert rows(search.bounded(own, ["the", "cell"], k=200, bits=3)) == rows(search.score(own, ["the", "cell"], k=200))
    search.MOST_LISTED = 1024


def test_written_index_needs_no_table_of_documents(loaded):
    found = plan(search.bounded(loaded, ["the", "cell"]))
    assert "doc_stats" not in found
    score = plan(search.score(loaded, ["the", "cell"]))
    assert "doc_stats" not in score and "docs" not in score and "positions" not in score[score.index("== Physical Plan ==") :]
    blocks = plan(search.score(index.Index(loaded.docs, loaded.postings.where(F.col("id_range").isin([4])), loaded.lexicon, loaded.doc_stats, corpus=loaded.corpus), ["the"]))
    assert "id_range" in blocks[blocks.index("PushedFilters") :]


def test_forward_index_joins_no_terms(spark, corpus, tmp_path):
    """Of a written index with word ids: one exchange, by document."""
    words = index.with_word_ids(corpus.lexicon)
    index.Index(corpus.docs, corpus.postings, words, corpus.doc_stats).write(str(tmp_path / "ids"))
    own = index.Index.load(spark, str(tmp_path / "ids"))
    found = index.forward(own.postings, own.lexicon)
    physical = plan(found)[plan(found).index("== Physical Plan ==") :]
    assert physical.count("Exchange") == 1 and "Join" not in physical and "lexicon" not in physical
    told = index.forward(corpus.postings, words)
    shown = lambda rows: {r["docid"]: [(p["wordid"], p["freq"], p["positions"]) for p in r["postings"]] for r in rows.where("docid % 97 = 0").collect()}
    assert shown(found) == shown(told)


def test_old_indexes_load(spark, corpus, tmp_path):
    import shutil

    corpus.write(str(tmp_path))
    for name in ("corpus", "blocks", "completions"):
        shutil.rmtree(tmp_path / name)
    old = index.Index.load(spark, str(tmp_path))
    assert old.completions is None and rows(search.bounded(old, ["the", "cell"])) == rows(search.score(corpus, ["the", "cell"]))


def test_documents_without_a_length(spark):
    """They have the mean, in the table of ranges too."""
    found = spark.createDataFrame([("a", 1, 2, 10), ("a", 2, 3, None)], "term string, doc_id long, tf int, dl long")
    stats = spark.createDataFrame([(2, 14, 7.5)], "n long, total_len long, avgdl double")
    row = index.posting_blocks(found, stats).first()
    top = lambda tf, norm: 2.5 * tf / (1.5 * (0.25 + 0.75 * norm) + tf)
    assert row["top_binary"] == pytest.approx(top(1, 7 / 7.5)) and row["top_actual"] == pytest.approx(top(3, 7 / 7.5))
    assert math.isclose(row["avgdl"], 7.5) and (row["docs"], row["first_id"], row["last_id"], row["max_tf"]) == (2, 1, 2, 3)


def test_completions(loaded):
    words = loaded.lexicon
    for prefix in ("w", "W1", "the", "t", "", "zz", "w49", "w" * 40):
        for n in (10, 3, 20):
            told = [tuple(r) for r in suggest.suggest_with_freq(words, prefix, n).collect()]
            assert [tuple(r) for r in suggest.complete(loaded.completions, words, prefix, n).collect()] == told
    found = plan(suggest.complete(loaded.completions, words, "w1"))
    physical = found[found.index("== Physical Plan ==") :]
    assert "PartitionFilters: [isnotnull(bucket" in physical and "EqualTo(prefix,w1)" in physical
    assert "Exchange" not in physical and "Sort" not in physical and "lexicon" not in physical


def test_completions_of_odd_terms(spark):
    words = spark.createDataFrame([("", 5), ("éa", 2), ("é", 2), ("éa b", 1), ("x" * 70, 1), ("x" * 69 + "y", 3)], "term string, term_freq long")
    found = {r["prefix"]: [(x["term"], x["term_freq"]) for x in r["suggestions"]] for r in suggest.completions(words).collect()}
    assert found["é"] == [("é", 2), ("éa", 2), ("éa b", 1)] and "" not in found and len(found) == 4 + 71
    assert found["x" * 69] == [("x" * 69 + "y", 3), ("x" * 70, 1)]
    assert max(len(r["prefix"]) for r in suggest.completions(words, longest=32).collect()) == 32
    assert suggest.completions(words.limit(0)).count() == 0


def test_a_prefix_of_all_terms_is_cut_before_the_shuffle(spark):
    """Tasks keep ten terms of it each."""
    words = spark.range(5000).select(F.format_string("a%05d", "id").alias("term"), F.col("id").alias("term_freq"))
    assert "WindowGroupLimit [prefix" in plan(suggest.completions(words))
    assert plan(suggest.completions(words)).count("Partial") >= 1


def test_documents_are_written_with_their_forward_index(spark, corpus, tmp_path):
    """The same index as of rows of tokens, and its forward index, which is read without an exchange."""
    from quillstack.functions import text as T

    docs = spark.createDataFrame([(1, "b a b c"), (2, ""), (3, None), (4, "a a a"), (1 << 21, "a b")], "doc_id long, text string")
    index.write_documents(docs, T.numbered(T.tokens_v1(F.col("text"))), str(tmp_path / "own"))
    own = index.Index.load(spark, str(tmp_path / "own"))
    tokens = docs.select("doc_id", F.posexplode(T.tokens_v1(F.col("text"))).alias("at", "term")).select("doc_id", (F.col("at") + 1).alias("pos"), "term")
    plain = index.build(tokens, docs.select("doc_id", F.col("doc_id").cast("string").alias("orig_id")))
    assert sorted(own.postings.select("term", "doc_id", "tf", "positions").collect()) == sorted(plain.postings.collect())
    assert sorted(own.lexicon.select("term", "doc_freq", "term_freq").collect()) == sorted(plain.lexicon.collect())
    assert {r["doc_id"]: r["dl"] for r in own.doc_stats.collect()} == {1: 4, 2: 0, 3: 0, 4: 3, 1 << 21: 2}
    found = index.forward_of(own.forward)
    told = index.forward(own.postings, own.lexicon)
    assert "Exchange" not in plan(found) and sorted(found.collect()) == sorted(told.collect())
    assert sorted((r["term"], r["block"], r["docs"]) for r in own.blocks.collect()) == [("a", 0, 2), ("a", 2048, 1), ("b", 0, 1), ("b", 2048, 1), ("c", 0, 1)]
