"""Byte files of barrels: many tasks, any bytes, and lists cut out of chunks."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.functions import codec
from quillstack.sources import readers, writers


@given(st.lists(st.lists(st.integers(0, 2**62), max_size=8), max_size=8))
def test_all_lists_at_once(lists):
    coded = codec.encode_all(lists)
    assert coded == [codec.encode_low_first(x) for x in lists]
    assert codec.decode_all(coded) == lists


@given(st.lists(st.binary(max_size=9), max_size=6))
@settings(max_examples=200)
def test_any_bytes_decode_alike(parts):
    told = [codec.decode_low_first(p) for p in parts]
    assert codec.decode_all(parts) == told if all(x < 2**63 for own in told for x in own) else True


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def read(spark, path, chunk):
    found = {}
    for r in sorted(readers.barrel_blobs(spark, path, chunk).collect(), key=lambda r: (r["barrel_id"], r["chunk"])):
        assert len(r["content"]) <= chunk and r["chunk"] * chunk == len(found.get(r["barrel_id"], b""))
        found[r["barrel_id"]] = found.get(r["barrel_id"], b"") + bytes(r["content"])
    return found


def test_files_of_other_programs(spark, tmp_path, small_splits):
    """Any bytes, a mark of byte order, no line feed at all or at the end, empty files, and files that are no barrel."""
    rng = random.Random(1)
    told = {0: rng.randbytes(20_000), 1: b"\xef\xbb\xbf" + rng.randbytes(9000), 2: b"no line feed", 3: b"\n", 4: b"a\r\nb\rc\n\n", 5: bytes(range(256)) * 30 + b"\n", 13: b"\xef\xbb\xbf\n"}
    for k, data in told.items():
        (tmp_path / f"barrel_{k}.bin").write_bytes(data)
    (tmp_path / "barrel_7.bin").write_bytes(b"")
    (tmp_path / "other_8.bin").write_bytes(b"no barrel\n")
    for chunk in (64, 1 << 16):
        assert read(spark, str(tmp_path), chunk) == told
    splits = spark.read.option("lineSep", "\n").text(str(tmp_path / "barrel_0.bin")).select("_metadata.file_block_start").distinct().count()
    assert splits == 7  # of one file


def test_written_barrels(spark, tmp_path, small_splits):
    """Barrels of several files, read by several tasks; each list comes back, those over many chunks too."""
    rng = random.Random(2)
    rows = [(f"t{k}", k % 2 if k % 10 else 3, k * 7, bytearray(rng.randbytes(rng.choice([0, 1, 30, 5000])))) for k in range(200)]
    table = spark.createDataFrame(rows, "term string, barrel_id int, offset long, content binary").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one task
    words = writers.barrel_blobs(table, str(tmp_path / "b")).cache()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    told = {b: b"".join(bytes(c) + b"\n" for _, own, _, c in rows if own == b) for b in (0, 1, 3)}
    assert read(spark, str(tmp_path / "b"), 1000) == told
    assert max(len(list((tmp_path / "b" / f"barrel_id={b}").glob("part-*"))) for b in (0, 1)) > 1
    for r in words.collect():
        assert told[r["barrel_id"]][r["offset"] :][: r["bytes"]] == bytes(dict((t, c) for t, _, _, c in rows)[r["term"]])
    for chunk in (256, 1 << 16):
        found = readers.posting_slices(readers.barrel_blobs(spark, str(tmp_path / "b"), chunk), words, chunk).collect()
        assert {r["term"]: bytes(r["content"]) for r in found} == {t: bytes(c) for t, _, _, c in rows if c}


def test_lexicon_of_four_columns(spark, tmp_path):
    (tmp_path / "lexicon").write_text("1\tcell\t3\t5\n2\tvirus\t2\t2\t0\t14\t{}\t3\n3\tbad\tx\t1\n")
    assert [(r["word_id"], r["term"], r["term_freq"]) for r in readers.lexicon(spark, str(tmp_path / "lexicon"), 4).collect()] == [(1, "cell", 5), (2, "virus", 2)]
    assert [r["term"] for r in readers.lexicon(spark, str(tmp_path / "lexicon")).collect()] == ["virus"]


def test_bytes_move_to_their_files_and_chunks_alone(spark, tmp_path):
    """Neither offsets nor places of lines send bytes through a window; a list in one chunk is not gathered."""
    shown = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([(f"t{k}", k % 2, k, bytearray(b"ab\ncd")) for k in range(50)], "term string, barrel_id int, offset long, content binary")
    words = writers.barrel_blobs(rows, str(tmp_path / "b"))
    assert "content" not in shown(words)
    found = readers._byte_lines(spark, str(tmp_path / "b"))
    assert "SortMergeJoin" not in shown(found) and found.count() <= 2 * 4  # a row for each file, not for each line
    slices = readers.posting_slices(readers.barrel_blobs(spark, str(tmp_path / "b")), words)
    assert "Union" in shown(slices) and {bytes(r["content"]) for r in slices.collect()} == {b"ab\ncd"}
