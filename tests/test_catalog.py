"""Every query of the catalogue against its SQL, over the smallest tables."""

import os

import duckdb
import pytest

from quillstack.plans import catalog, formats, records, served  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    shown = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(names), sorted(tuple(shown(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", catalog.SQL)
def test_query_is_its_sql(spark, sql, name):
    frame = catalog.QUERIES[name](spark, DATA)
    told = sql.execute(catalog.SQL[name])
    assert rows(frame.columns, frame.collect()) == rows([d[0] for d in told.description], told.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_search_reads_two_columns(spark):
    plan = catalog.QUERIES["search_multi_and"](spark, DATA)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    assert "lang" not in plan[plan.index("== Physical Plan ==") :]


def test_no_document_is_left_out(spark):
    """Queries over texts that documents have no case of are over all documents too."""
    ids = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    for name in ("tokenize_v2", "query_tokenize", "control_characters"):
        assert {r["id"] for r in catalog.QUERIES[name](spark, DATA).select("id").collect()} == ids | {-i for i, _ in catalog.SAMPLES}
    assert {r["internal_id"] for r in catalog.QUERIES["forward_doc_lengths"](spark, DATA).collect()} == ids
