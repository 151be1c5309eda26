"""Index, search, suggestions, barrels and metrics on small corpora."""

import math

import pytest
from pyspark.sql import functions as F

from quillstack.operators import barrels, index, metrics, search, suggest

TEXTS = {1: "virus cell virus", 2: "cell", 3: "virus cell wall wall", 4: ""}


@pytest.fixture(scope="module")
def small(spark):
    tokens = [(d, i + 1, t) for d, s in TEXTS.items() for i, t in enumerate(s.split())]
    docs = spark.createDataFrame([(d, f"doc{d}") for d in TEXTS], "doc_id int, orig_id string")
    return index.build(spark.createDataFrame(tokens, "doc_id int, pos int, term string"), docs)


def bm25(df, tf, dl, n=4, avgdl=2.0):
    return math.log((n - df + 0.5) / (df + 0.5) + 1) * 2.5 * tf / (1.5 * (0.25 + 0.75 * dl / avgdl) + tf)


def scores(found):
    return [(r["doc_id"], round(r["score"], 6)) for r in found.collect()]


def test_statistics(small):
    row = small.stats().first()
    assert (row["n"], row["total_len"], row["avgdl"], row["terms"]) == (4, 8, 2.0, 3)


def test_single_and_multi(small):
    assert scores(search.search_single(small, "Virus cell")) == [(1, round(bm25(2, 1, 3), 6)), (3, round(bm25(2, 1, 4), 6))]
    assert scores(search.search_multi(small, "virus cell", tf_mode="actual")) == [(1, round(bm25(2, 2, 3) + bm25(3, 1, 3), 6)), (3, round(bm25(2, 1, 4) + bm25(3, 1, 4), 6))]
    assert scores(search.search_multi(small, "virus zzz")) == scores(search.search_multi(small, "virus"))
    assert scores(search.search_multi(small, "wall wall")) == [(3, round(2 * bm25(1, 1, 4), 6))]
    assert scores(search.search_multi(small, "zzz")) == scores(search.search_multi(small, "")) == []
    assert len(scores(search.search_multi(small, "cell", k=2))) == 2


def test_published_scores(spark):
    """A term with postings 1:2, 4:1, 6:1 among documents of known lengths."""
    lengths = [2308, 989, 3662, 3200, 1042, 4588]
    docs = spark.createDataFrame([(i, str(i)) for i in range(1, 7)], "doc_id int, orig_id string")
    postings = spark.createDataFrame([("virus", 1, 2), ("virus", 4, 1), ("virus", 6, 1)], "term string, doc_id int, tf int")
    own = index.Index(docs, postings, index.lexicon(postings), spark.createDataFrame(list(enumerate(lengths, 1)), "doc_id int, dl long"))
    assert scores(search.search_multi(own, "virus")) == [(1, 0.733738), (4, 0.631732), (6, 0.519378)]
    assert scores(search.search_multi(own, "virus", tf_mode="actual")) == [(1, 1.030948), (4, 0.631732), (6, 0.519378)]
    assert scores(search.search_multi(own, "virus virus")) == [(1, 1.467475), (4, 1.263465), (6, 1.038756)]


def test_semantic(spark, small):
    synonyms = spark.createDataFrame([("wall", "virus", 1), ("wall", "cell", 3)], "term string, synonym string, rank int")
    assert [d for d, _ in scores(search.search_semantic(small, "wall", synonyms))] == [3]
    assert {d for d, _ in scores(search.search_semantic(small, "wall", synonyms, mode="or"))} == {1, 3}
    assert scores(search.search_semantic(small, "wall")) == scores(search.search_multi(small, "wall"))


def test_results_and_intersection(small):
    found = search.results(small, search.search_multi(small, "virus")).collect()
    assert [(r["doc_id"], r["title"], r["term_frequencies"]) for r in found] == [("doc1", "", {"virus": 2}), ("doc3", "", {"virus": 1})]
    assert {r[0] for r in search.intersect(small, ["virus", "wall", "zzz"]).collect()} == {3}


def test_written_index_is_pruned(spark, small, tmp_path):
    small.write(str(tmp_path))
    loaded = index.Index.load(spark, str(tmp_path))
    assert scores(search.search_multi(loaded, "virus cell")) == scores(search.search_multi(small, "virus cell"))
    plan = search.search_multi(loaded, "virus cell")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(barrel_id" in plan or "PartitionFilters: [barrel_id" in plan
    assert "In(term" in plan
    assert "positions" not in plan[plan.index("== Physical Plan ==") :]


def test_documents_without_length_use_the_mean(spark, small):
    partial = index.Index(small.docs, small.postings, small.lexicon, small.doc_stats.where("doc_id <> 3"))
    row = {r["doc_id"]: r["score"] for r in search.score(partial, ["wall"]).collect()}
    assert row[3] == pytest.approx(bm25(1, 1, 1, avgdl=1.0))  # avgdl is (3 + 1) / 4


def test_suggest(spark):
    words = spark.createDataFrame([("infect", 105), ("influenza", 83), ("infecti", 11), ("inflamm", 11), ("viru", 18), ("", 5)], "term string, term_freq long")
    assert [r["term"] for r in suggest.suggest(words, "INF").collect()] == ["infect", "influenza", "infecti", "inflamm"]
    assert suggest.suggest_with_freq(words, "inf", 1).first()["term_freq"] == 105
    assert suggest.suggest(words, "").count() == suggest.suggest(words, "zz").count() == 0
    assert suggest.contains(words, "Viru").first()[0] and not suggest.contains(words, "vir").first()[0]
    assert suggest.insert(words, "viru", 2).where("term = 'viru'").first()["term_freq"] == 2
    tiny = spark.createDataFrame([("ab",), ("ac",), ("b",)], "term string")
    assert suggest.memory(tiny).first()["nodes"] == 5


def test_barrels(spark, small):
    words = barrels.assign(small.lexicon).withColumns({"bytes": F.lit(4), "offset": F.lit(0)})
    assert barrels.metadata(words).agg(F.sum("term_count")).first()[0] == 3
    assert barrels.memory_usage(words).first()[0] == 12
    assert barrels.needed(small.lexicon.select("term")).count() <= 3
    uses = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4), (1, 5)], "barrel_id int, at int")
    assert [r["barrel_id"] for r in barrels.resident(uses).collect()] == [1, 4, 3]


def test_numbering_spans_buckets(spark):
    terms = sorted({a + b + c for a in "abé" for b in ["", "x", "yz"] for c in ["", "q", "rr"]}, key=lambda t: t.encode())
    words = index.with_word_ids(spark.createDataFrame([(t,) for t in terms], "term string"))
    assert [r["term"] for r in words.orderBy("word_id").collect()] == terms
    assert [r["word_id"] for r in words.orderBy("word_id").collect()] == list(range(1, len(terms) + 1))


@pytest.mark.parametrize("bits", [0, 2, 20])
def test_gaps_span_ranges(spark, bits):
    docs = {"a": [1, 2, 9, 40, 41], "b": [7], "c": [0, 64]}
    rows = spark.createDataFrame([(t, d) for t, own in docs.items() for d in own], "term string, doc_id long")
    found = {(r["term"], r["doc_id"]): r["doc_gap"] for r in index.gaps(rows, bits=bits).collect()}
    assert found == {(t, d): d - (own[k - 1] if k else 0) for t, own in docs.items() for k, d in enumerate(own)}


def test_metrics(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(v), 1024 * v) for i, v in enumerate((4, 2, 1, 3))], "query_id long, time_ms double, mem_kb long")
    found = metrics.query_stats(rows).first()
    assert (found["query_count"], found["avg_time_ms"], found["p50_time_ms"], found["p95_time_ms"], found["p99_time_ms"]) == (4, 2.5, 3.0, 4.0, 4.0)
    assert metrics.percentiles(rows, "time_ms", [], (50, 95)).first().asDict() == {"p50": 3.0, "p95": 4.0}
    assert metrics.memory_stats(rows).first().asDict() == {"current_memory_mb": 3.0, "peak_memory_mb": 4.0}
    monitor = metrics.PerformanceMonitor(index_kb=2048)
    with monitor.query():
        pass
    assert monitor.report(spark).first()["index_memory_mb"] == 2.0
    monitor.save(spark, f"{tmp_path}/stats")
    assert {r["key"] for r in spark.read.option("header", True).csv(f"{tmp_path}/stats").collect()} == {"query_count", "avg_time_ms", "p95_time_ms", "peak_memory_mb"}
    done = metrics.IndexingMonitor()
    done.record(5)
    assert done.summary()["docs_per_second"] == pytest.approx(5 / 0.01)


def test_stream_appends_blocks(spark, tmp_path):
    from quillstack.streaming import ingest

    (tmp_path / "in").mkdir()
    for k, text in enumerate(["virus cell", "cell wall"]):
        (tmp_path / "in" / f"{k}.json").write_text(f'{{"paper_id":"p{k}","title":"{text}","abstract":"","sections":[]}}\n')
        ingest.append_postings(ingest.stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination()
    found = ingest.merged(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert {(r["term"], r["paper_id"], r["tf"]) for r in found} == {("virus", "p0", 1), ("cell", "p0", 1), ("cell", "p1", 1), ("wall", "p1", 1)}
    whole = ingest.load(spark, str(tmp_path / "out"))
    rows = search.results(whole, search.search_multi(whole, "cell")).collect()
    assert {r["doc_id"] for r in rows} == {"p0", "p1"} and {r["orig_id"]: r["doc_id"] for r in whole.docs.collect()} == {"p0": 1, "p1": 2}
    assert whole.stats().first().asDict() == {"n": 2, "total_len": 4, "avgdl": 2.0, "terms": 3}
    whole.write(str(tmp_path / "index"))
    again = index.Index.load(spark, str(tmp_path / "index"))
    assert {tuple(r) for r in search.score(again, ["cell", "wall"]).select("doc_id", "score").collect()} == {tuple(r) for r in search.score(whole, ["cell", "wall"]).select("doc_id", "score").collect()}


@pytest.mark.parametrize("values", [[1.0] * 900 + list(range(100)), [-5.5, 0.0, 1e300, -1e300, 0.25, float("inf"), float("nan")], [3.0], [10.0**k for k in range(-20, 20)]])
def test_percentiles_are_nearest_ranks(spark, values):
    from quillstack.operators import metrics

    table = spark.createDataFrame([(float(v), "a" if k % 3 else None) for k, v in enumerate(values)] + [(None, "a")], "v double, g string").repartition(5)
    ordered = lambda own: sorted(own, key=lambda x: (math.isnan(x), x))
    groups = {"a": [v for k, v in enumerate(values) if k % 3], None: [v for k, v in enumerate(values) if not k % 3]}
    ps = (0, 37.5, 50, 95, 99, 100)
    told = lambda own: [str(float(ordered(own)[min(int(p * len(own) / 100), len(own) - 1)])) for p in ps]
    found = {r["g"]: [str(x) for x in r[1:]] for r in metrics.percentiles(table, "v", ["g"], ps).collect()}
    assert found == {g: told(own) for g, own in groups.items() if own}
    assert [str(x) for x in metrics.percentiles(table, "v", (), ps).first()] == told(values)


def test_a_frequent_term_is_split(spark, tmp_path):
    """Of postings nine in ten are one term's: files and lists hold no more than their share, and bytes come back."""
    from quillstack.functions import codec

    rows = [("the", i, 2, [i % 7 + 1, 200 + i]) for i in range(0, 90_000, 100)] + [(f"t{i % 100}", i, 1, [5]) for i in range(100)]
    found = spark.createDataFrame(rows, "term string, doc_id long, tf int, positions array<int>").repartition(4)
    sizes = [r["count"] for r in index.posting_lists(found).where("term = 'the'").selectExpr("size(postings) as count").collect()]
    assert len(sizes) == 9 and max(sizes) == 100
    tokens = found.selectExpr("term", "doc_id", "explode(positions) as pos")
    words = index.lexicon_with_offsets(tokens)
    pieces = index.encoded(found, words, bits=12).collect()
    by_word = {}
    for r in sorted(pieces, key=lambda r: r["offset"]):
        by_word.setdefault(r["word_id"], []).append(r)
    assert len(by_word[words.where("term = 'the'").first()["word_id"]]) == 22
    told = {}
    for t, d, _, at in rows:
        told.setdefault(t, []).append((d, at))
    for w in words.collect():
        data = b"".join(bytes(r["content"]) for r in by_word[w["word_id"]])
        assert by_word[w["word_id"]][0]["offset"] == w["offset"] and len(data) == w["bytes"]
        assert data == codec.encode_low_first(codec.posting_numbers(sorted(told[w["term"]])))
    docs = spark.range(0, 90_000, 100).selectExpr("id as doc_id", "cast(id as string) as orig_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition
    index.Index(docs, found, index.lexicon(found), index.lengths(found), derived=True).write(str(tmp_path / "index"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {}
    for r in spark.read.parquet(f"{tmp_path}/index/postings").where("term = 'the'").selectExpr("_metadata.file_name as f").collect():
        files[r["f"]] = files.get(r["f"], 0) + 1
    assert len(files) > 1
    loaded = index.Index.load(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, loaded.lexicon.select("term", "doc_freq", "term_freq").collect())) == sorted((t, len(own), sum(len(at) for _, at in own)) for t, own in told.items())
    assert loaded.doc_stats.agg({"dl": "sum"}).first()[0] == 1900
