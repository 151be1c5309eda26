"""The registered queries and the pipeline over the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from quillstack.llm import importance, mixing, simhash
from quillstack.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "op1_warc_index_merge": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op2_url_language_models": ["page_id", "host", "path", "rule", "verdict"],
    "op3_order_minhash": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op4_template_deduction": ["page_id", "url", "text", "n_chars"],
    "op5_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op6_stupid_backoff": ["doc_id"],
    "op7_importance_resampling": ["doc_id"],
    "op8_exact_top_k": ["query_id", "rank", "vec_id", "score"],
    "op9_sainte_lague_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op10_minimum_bin_slack": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op11_pre_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op12_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op13_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
}
TABLE = {"op1": "pages", "op2": "pages", "op4": "pages"}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    found = QUERIES[name](spark, DATA).cache()
    assert found.columns[: len(COLUMNS[name])] == COLUMNS[name]
    if name.partition("_")[0] in ("op1", "op2", "op3", "op4", "op5", "op6", "op9", "op11", "op12"):
        assert found.count() == spark.read.parquet(f"{DATA}/{TABLE.get(name.partition('_')[0], 'documents')}.parquet").count()
    if name in ORACLE_SQL:
        db = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        told = db.execute(ORACLE_SQL[name])
        names = [d[0] for d in told.description]
        assert sorted(names) == sorted(found.columns)
        shown = lambda row: [f"{x:.6f}" if isinstance(x, float) else str(x) for x in row]
        assert sorted(map(shown, found.select(names).collect())) == sorted(map(shown, told.fetchall()))


def stage_inputs(spark):
    rows = [(1, "A good text about cats and dogs. " * 9), (2, "A good text about cats and dogs. " * 9), (3, "Another text of other words, " * 7 + "the end."), (3, "A third text with the same id " * 5)]
    rows += [(4, None), (5, ""), (None, "A text without an id " * 8), (6, "one"), (6, "one")]
    rows += [(i, f"word{i} " * 3 + "and more that is common to all of these texts " * 4) for i in range(10, 60)]
    return spark.createDataFrame([(i, t, "en", "s" if i and i % 3 else None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def key(row):
    return str((row["doc_id"], row["text"], row["source"]))


def test_quality_stage(spark):
    docs = stage_inputs(spark)
    found = corpus_pipeline.quality(spark, docs, DATA)
    assert found.columns == docs.columns
    kept = Counter(str(r["doc_id"]) for r in importance.resample(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect())
    assert Counter(str(r["doc_id"]) for r in found.collect()) == kept


def test_near_dedup_stage(spark):
    docs = stage_inputs(spark)
    found = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert found.columns == docs.columns
    rows, prints = docs.collect(), []
    for r in rows:
        prints.append(simhash.fingerprint(r["text"]))
    up = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    up[a] = up[b] = min(up[a], up[b])
    groups = {}
    for k, r in zip(up, rows, strict=True):
        groups.setdefault(k, []).append(r)
    least = Counter(min(((r["doc_id"] is None, r["doc_id"] or 0) for r in own)) for own in groups.values())
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in found.collect()) == least


def test_mix_stage(spark):
    docs = stage_inputs(spark)
    found = corpus_pipeline.mix(spark, docs, DATA)
    assert found.columns == docs.columns
    taken = sum(r["taken"] for r in mixing.mix(docs).collect())
    rows = found.collect()
    assert sum(len(r["text"].split()) for r in rows) == taken
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    for r in rows:  # every span is of a text of its document
        assert any(all(part in t for part in r["text"].split("\n")) for t in texts[r["doc_id"]])
    assert sorted(map(key, rows)) == sorted(map(key, corpus_pipeline.mix(spark, docs.coalesce(1), DATA).collect()))


def test_stages_keep_columns_and_long_texts(spark):
    """Other columns than those of documents, with names that the operators use, and a text of a million characters."""
    rows = [(i, f"row{i}", f"A good text with the number {i} about cats and dogs and birds. " * (9 if i else 16_000), {"a": i}, 7.5) for i in range(12)]
    docs = spark.createDataFrame([(i, n, t, "s", m, x, "k") for i, n, t, m, x in rows], "doc_id long, row string, text string, source string, spans map<string,long>, id double, ROW_ string")
    for stage in (corpus_pipeline.quality, corpus_pipeline.near_dedup, corpus_pipeline.mix):
        found = stage(spark, docs, DATA)
        assert found.columns == docs.columns
        kept = found.collect()
        assert kept and all(r["row"] == f"row{r['doc_id']}" and r["spans"] == {"a": r["doc_id"]} and r["id"] == 7.5 for r in kept)
    packed = corpus_pipeline.pack(spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packed} == set(range(12))
    lengths = {i: sum(r["length"] for r in packed if r["doc_id"] == i) for i in range(12)}
    assert lengths[0] > 1700 * lengths[1] and all(r["length"] == 1024 for r in packed if r["doc_id"] == 0 and r["piece"] > 0)


def test_pipeline(spark):
    assert [n.split(" (")[1] for n, _ in corpus_pipeline.STAGES] == ["7)", "5)", "9)", "10)"]
    found = corpus_pipeline.run(spark, DATA)
    assert found.columns == COLUMNS["op10_minimum_bin_slack"]
    per = found.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in per) <= 1024
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, DATA)
        assert empty.count() == 0
