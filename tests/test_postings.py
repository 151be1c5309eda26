"""Postings that are grouped in the row of their document, and what follows from them."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillstack.functions import text as T
from quillstack.operators import index, synonyms
from quillstack.plans import catalog, formats
from quillstack.sources import spread

DOCS = [(1, "b a b c"), (2, ""), (3, None), (4, "a a a"), (5, "é z"), (None, "q"), (1 << 21, "a b")]


def told(rows):
    at = defaultdict(list)
    for i, s in rows:
        for k, t in enumerate((s or "").split()):
            at[t, i].append(k + 1)
    return {k: sorted(v) for k, v in at.items()}


@pytest.mark.parametrize("more", [[], [(1, "a x b"), (None, "q r")]])
def test_terms_grouped_in_their_row(spark, more):
    """Ids that are on several rows are one document."""
    docs = spark.createDataFrame(DOCS + more, "doc_id long, text string")
    found = index.document_postings(docs, T.numbered(T.tokens_v1(F.col("text")))).collect()
    assert {(r["term"], r["doc_id"]): r["positions"] for r in found} == told(DOCS + more)
    assert len(found) == len(told(DOCS + more)) and all(r["tf"] == len(r["positions"]) for r in found)


def test_large_inputs_shuffle_no_token(spark, monkeypatch):
    monkeypatch.setitem(spread.spread.__kwdefaults__, "small", 0)
    for name in ("postings_positions", "gap_positions", "field_postings"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "collect_list" not in plan


def test_sizes_of_lists_gather_no_list(spark):
    docs = spark.createDataFrame([d for d in DOCS if d[0]], "doc_id long, text string")
    found = index.list_bytes(index.document_postings(docs, T.numbered(T.tokens_v1(F.col("text")))), bits=1)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    df, tf = Counter(t for t, _ in told(DOCS) if t != "q"), Counter()
    for (t, _), at in told(DOCS).items():
        tf[t] += len(at)
    rows = {r["term"]: (r["doc_freq"], r["term_freq"], r["bytes"]) for r in found.collect()}
    assert {t: r[:2] for t, r in rows.items()} == {t: (n, tf[t]) for t, n in df.items()}
    assert rows["a"][2] == 1 + (1 + 1 + 1) + (1 + 1 + 3) + (3 + 1 + 1)  # documents; gap, number and position gaps of each


def test_greatest_scores_move_no_posting(spark, monkeypatch):
    """Texts are dealt by range of ids, and nothing is dealt again by term."""
    monkeypatch.setitem(spread.spread.__kwdefaults__, "small", 0)
    monkeypatch.setattr(catalog, "pieces", lambda rows: 4)
    plan = catalog.QUERIES["posting_blocks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(shiftright" in plan and "hashpartitioning(term" not in plan


def test_parts_of_an_input_do_not_grow(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert spread.pieces(rows, 1 << 16) > spread.pieces(rows, 1 << 20) >= 1
    assert spread.pieces(rows.union(rows), 1 << 16) >= 2 * spread.pieces(rows, 1 << 16) - 1


def test_pairs_in_their_row(spark):
    """Pairs of lists are those of rows of tokens, those of one term with itself too."""
    lists = [(1, "a b a a c".split()), (2, []), (3, ["b"]), (4, "b a d d".split()), (5, "x x".split())]
    table = spark.createDataFrame(lists, "doc_id long, l array<string>")
    tokens = table.select("doc_id", F.posexplode("l").alias("pos", "term"))
    n = {(r["term"], r["context"]): r["n"] for r in synonyms.pairs(tokens).collect()}
    assert {(r["a"], r["b"]): r["n"] for r in synonyms.unordered(table, least=2).collect()} == {k: v for k, v in n.items() if v >= 2 and k[0] <= k[1]}
    of = Counter()
    for (a, _), v in n.items():
        of[a] += v
    assert {r["term"]: r["of"] for r in synonyms.neighbours(table).collect()} == of
    plan = synonyms.unordered(table)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    assert sorted(synonyms.synonyms_of(table).collect()) == sorted(synonyms.synonyms(tokens).collect())


@pytest.mark.parametrize("more", [[], [(1, "a x b"), (5, "q r")]])
def test_word_ids_come_to_documents(spark, more):
    """A document's words by their ids, without a join or an exchange of postings; ids on several rows are one document."""
    docs = spark.createDataFrame(DOCS + more, "doc_id long, text string")
    tokens = T.numbered(T.tokens_v1(F.col("text")))
    found, words = index.numbered_documents(docs, tokens, parts=3)
    known = {r["word_id"]: (r["term"], r["doc_freq"], r["term_freq"]) for r in words.collect()}
    here = told(DOCS + more)
    df, tf = Counter(t for t, _ in here), Counter()
    for (t, _), at in here.items():
        tf[t] += len(at)
    assert [known[k + 1] for k in range(len(known))] == [(t, df[t], tf[t]) for t in sorted(df, key=str.encode)]
    shown = {r["docid"]: [(known[p["wordid"]][0], p["positions"], p["freq"]) for p in r["postings"]] for r in index.forward_of(found).collect()}
    assert {(t, i): at for i, own in shown.items() for t, at, _ in own} == here
    assert all(own == sorted(own, key=lambda p: p[0].encode()) and all(n == len(at) for _, at, n in own) for own in shown.values())
    assert found.where("dl IS NULL").isEmpty() and index.numbered_documents(docs.where("false"), tokens)[0].isEmpty()


def test_forward_index_file_shuffles_no_posting(spark, monkeypatch):
    """Texts and a part's different terms are dealt: a document's row has no join and no sort by document."""
    monkeypatch.setitem(spread.spread.__kwdefaults__, "small", 0)
    seen = []
    monkeypatch.setattr(formats.writers, "forward_index", lambda rows, path, *more: (seen.append(rows), rows.write.json(path))[1])
    assert formats.forward_index_file(spark, "/root/testdata/sf0.001").count() == 200
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "hashpartitioning(doc_id" not in plan
    assert "positions" not in plan[plan.index("SortMergeJoin" if "SortMergeJoin" in plan else "HashJoin") :]


def test_forward_block_file_shuffles_nothing(spark, monkeypatch):
    monkeypatch.setitem(spread.spread.__kwdefaults__, "small", 0)
    seen = []
    monkeypatch.setattr(formats.writers, "forward_block", lambda rows, path, *more: (seen.append(rows), rows.write.json(path))[1])
    found = formats.forward_block_file(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString() and found.count() == 50243


def test_cleaned_rows_are_in_their_row(spark):
    """The same fields as tokens that are gathered give, for all options that need no rows of tokens."""
    from quillstack.operators import analyze

    told_ = [("p1", "The 12 cells", "A: don't | B: 7 | the of", "x"), ("p2", None, None, "y"), ("p3", "of the", "Q: Virus Virus", None), ("p4", "", "", "")]
    rows = spark.createDataFrame(told_, "paper_id string, title string, sections string, authors string").withColumns({"pub_date": F.lit("d"), "source": F.lit(None).cast("string")})
    for options in (
        analyze.CleanOptions(),
        analyze.CleanOptions(fields=("sections", "title", "title"), stopwords=None, keep_original=True),
        analyze.CleanOptions(remove_numbers=True, tokenizer="v2"),
        analyze.CleanOptions(stopwords=None, remove_numbers=True),
        analyze.CleanOptions(stem=True),
    ):
        found = analyze.cleaned_rows(rows, options)
        assert sorted(found.collect(), key=lambda r: r["docid"]) == sorted(analyze.cleaned(rows, analyze.clean(rows, options)).collect(), key=lambda r: r["docid"])
        assert ("Exchange" in found._jdf.queryExecution().executedPlan().toString()) == options.stem
    twice = analyze.cleaned_rows(rows.union(rows.where("paper_id = 'p3'").withColumn("title", F.lit("more"))))
    assert sorted(sum(len(f["tokens"]) for f in r["fields"]) for r in twice.where("docid = 'p3'").collect()) == [2, 3]


def test_lines_are_numbered_without_moving_them(spark, tmp_path):
    """Line numbers over many splits and files of one task; empty lines count, and have no row."""
    from quillstack.sources import readers

    texts = {"a": [f"a{k}" if k % 3 else "" for k in range(500)], "b": ["b"], "c": [], "d": [f"d{k}" for k in range(300)]}
    for name, own in texts.items():
        (tmp_path / f"{name}.txt").write_text("".join(f"{x}\n" for x in own))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    found = readers.lines(spark, str(tmp_path))
    assert sorted((r["line_no"], r["line"]) for r in found.collect()) == [(k + 1, x) for k, x in enumerate(x for own in texts.values() for x in own) if x]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_sizes_of_lists_move_no_posting(spark, monkeypatch):
    """Texts are dealt by range of ids: windows over a term's documents of a range need no exchange of their own."""
    monkeypatch.setitem(spread.spread.__kwdefaults__, "small", 0)
    plan = catalog.listed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(shiftright" in plan and "hashpartitioning(term" in plan and not any("hashpartitioning(term" in x and "_range" in x for x in plan.splitlines())
    docs = spark.createDataFrame([d for d in DOCS if d[0]], "doc_id long, text string")
    tokens = T.numbered(T.tokens_v1(F.col("text")))
    assert sorted(index.list_bytes_of_documents(docs, tokens, bits=1).collect()) == sorted(index.list_bytes(index.document_postings(docs, tokens)).collect())


def test_lists_by_block_move_no_posting(spark, monkeypatch):
    monkeypatch.setitem(spread.spread.__kwdefaults__, "small", 0)
    plan = catalog.posting_lists(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(term" not in plan
    docs = spark.createDataFrame([d for d in DOCS if d[0]] + [(1, "a x b")], "doc_id long, text string")
    tokens = T.numbered(T.tokens_v1(F.col("text")))
    assert sorted(index.lists_of_documents(docs, tokens, block_docs=2).collect()) == sorted(index.posting_lists(index.document_postings(docs, tokens), block_docs=2).collect())
