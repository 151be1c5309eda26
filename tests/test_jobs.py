"""The programs from papers to answers, through their files."""

import json

from quillstack.__main__ import parser, run
from quillstack.sources import readers


def test_from_papers_to_answers(spark, tmp_path):
    (tmp_path / "papers").mkdir()
    papers = {"a.json": ("A", "Virus cells", "The virus is in the cell"), "PMC1.xml.json": ("PMC1", "Cell walls", "Café walls aren't cells 2020")}
    for name, (key, title, text) in papers.items():
        (tmp_path / "papers" / name).write_text(json.dumps({"paper_id": key, "metadata": {"title": title}, "abstract": [{"text": text}], "body_text": [{"section": "Intro", "text": "Cells: " + text}]}))

    def go(*words):
        return run(spark, parser().parse_args([str(w) for w in words]))

    go("extract", "-d", tmp_path / "papers", "-o", tmp_path / "tsv", "--jsonl", tmp_path / "jsonl")
    for kind in ("tsv", "jsonl"):
        go("clean", "-i", tmp_path / kind, "-if", kind, "-o", tmp_path / f"clean_{kind}", "--stem", "--remove-numbers", "--nfc", "--fields", "title,abstract,sections")
    rows = {kind: {r["docid"]: r["fields"] for r in readers.cleaned_jsonl(spark, f"{tmp_path}/clean_{kind}").collect()} for kind in ("tsv", "jsonl")}
    assert rows["tsv"] == rows["jsonl"]
    assert [f["name"] for f in rows["tsv"]["A"]] == ["title", "abstract", "Intro"]
    assert [(t["term"], t["pos"]) for t in rows["tsv"]["PMC1"][1]["tokens"]] == [("café", 1), ("wall", 2), ("aren't", 3), ("cell", 4)]

    stats = go("index", "-i", tmp_path / "clean_tsv", "-o", tmp_path / "index").first()
    assert (stats["n"], stats["total_len"]) == (2, 7 + 11)
    assert [r["doc_id"] for r in go("search", tmp_path / "index", "cell wall").collect()] == ["PMC1"]
    assert {r["doc_id"] for r in go("search", tmp_path / "index", "cell x", "--single", "--actual-tf").collect()} == {"A", "PMC1"}
    assert [r["term"] for r in go("suggest", tmp_path / "index", "c").collect()] == ["cell", "café"]
    assert go("stats", tmp_path / "index").first()["n"] == 2
    assert [r[0] for w in ("cell", "virus") for r in go("contains", tmp_path / "index", w).collect()] == [True, False]
    held = go("barrels", tmp_path / "index").collect()
    assert sum(r["term_count"] for r in held) == 5 and [r["barrel_id"] for r in held] == sorted(r["barrel_id"] for r in held)
    (tmp_path / "synonyms").write_text("walls\twall\t1\nvirus\tviru\t1\nvirus\tx\t3\n")
    ids = lambda *more: [r["doc_id"] for r in go("search", tmp_path / "index", *more).collect()]
    assert ids("virus", "--synonyms", tmp_path / "synonyms") == ["A"] and ids("virus walls") == [] and ids("viruses", "--stem") == []
    assert set(ids("virus walls", "--synonyms", tmp_path / "synonyms", "--any")) == {"A", "PMC1"}
    assert ids("walls", "--stem", "--metrics", tmp_path / "metrics") == ["PMC1"]
    assert {r["key"] for r in spark.read.option("header", True).csv(str(tmp_path / "metrics")).collect()} == {"query_count", "avg_time_ms", "p95_time_ms", "peak_memory_mb"}
    (tmp_path / "one.tsv").write_text("P\tCAF\u00c9 don\u2019t\t\t\t\t\t\t\n")
    go("clean", "-i", tmp_path / "one.tsv", "-o", tmp_path / "clean_v2", "--tokenizer", "v2", "--ascii-lower", "--dehyphenate", "--delete-tabs", "--no-stopwords")
    assert [t["term"] for t in readers.cleaned_jsonl(spark, f"{tmp_path}/clean_v2").first()["fields"][0]["tokens"]] == ["caf\u00e9", "don\u2019t"]
    go("export", tmp_path / "index", "-o", tmp_path / "out")
    words = {r["term"]: r for r in readers.lexicon(spark, f"{tmp_path}/out/lexicon").collect()}
    assert words["cell"]["doc_freq"] == 2
    back = readers.inverted_block(spark, f"{tmp_path}/out/block.inv").where("term = 'viru'").collect()
    assert [len(r["positions"]) for r in back] == [3]
    assert {r["docid"] for r in readers.forward_index(spark, f"{tmp_path}/out/forward_index").collect()} == {"A", "PMC1"}
    assert {r["docid"] for r in readers.forward_block(spark, f"{tmp_path}/out/block.fwd").collect()} == {"A", "PMC1"}
    assert readers.docid_map(spark, f"{tmp_path}/out/docid_map").count() == 2
    assert readers.barrel_metadata(spark, f"{tmp_path}/out/barrel_metadata").count() >= 1


def test_an_index_that_grows(spark, tmp_path):
    """Papers come in batches, one of them again in another version; ids and other papers stay."""
    from quillstack.plans import jobs

    def add(batch, papers):
        rows = [{"docid": d, "fields": [{"name": "title", "tokens": [{"term": t, "pos": k + 1} for k, t in enumerate(s.split())]}], "meta": {}} for d, s in papers.items()]
        (tmp_path / batch).write_text("".join(json.dumps(r) + "\n" for r in rows))
        return run(spark, parser().parse_args(["add", "-i", str(tmp_path / batch), "-o", str(tmp_path / "growing")]))

    assert add("one", {"A": "virus cell", "B": "cell wall"}).first()["n"] == 2
    ids = {r["orig_id"]: r["doc_id"] for r in jobs.load(spark, str(tmp_path / "growing")).docs.collect()}
    assert add("two", {"C": "virus", "A": "wall wall"}).first()["n"] == 3
    found = lambda *words: [r["doc_id"] for r in run(spark, parser().parse_args(["search", str(tmp_path / "growing"), *words])).collect()]
    assert found("virus") == ["C"] and found("cell") == ["B"] and set(found("wall")) == {"A", "B"}
    now = {r["orig_id"]: r["doc_id"] for r in jobs.load(spark, str(tmp_path / "growing")).docs.collect()}
    assert {d: now[d] for d in ids} == ids and now["C"] == 3
    assert [r["term"] for r in run(spark, parser().parse_args(["suggest", str(tmp_path / "growing"), "w"])).collect()] == ["wall"]
    for k in range(3):
        add(f"more{k}", {f"M{k}": "cell"})
    gone = spark.createDataFrame([("B",)], "docid string")
    own = jobs.add_cleaned(spark, str(tmp_path / "two"), str(tmp_path / "growing"), deleted=gone)
    assert len(own.segments()) < 6 and "B" not in {r["orig_id"] for r in own.index().docs.collect()}
    assert set(found("cell")) == {"M0", "M1", "M2"}
