"""Archives, their index and its merge."""

import gzip
import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillstack.llm import warc

LONG = "x" * 120


@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree_merges(runs):
    tree = warc.LoserTree([iter(sorted(r)) for r in runs], lambda x: x)
    assert list(tree) == sorted(x for r in runs for x in r)


def test_ties_go_to_the_earlier_run():
    runs = [[(1, "b"), (3, "b")], [(1, "a"), (2, "a")], [(1, "c")]]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x[0])) == [(1, "b"), (1, "a"), (1, "c"), (2, "a"), (3, "b")]


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("https://www.Example.com/A/b?Q=1#f", "com,example)/a/b?q=1"),
        ("http://user@blog.example.com:80", "com,example,blog)/"),
        ("example.org/x", "org,example)/x"),
        ("http://a.b?x/y", "b,a)?x/y"),
        ("", ")/"),
        (None, ")/"),
    ],
)
def test_url_key(url, key):
    assert warc.url_key(url) == key


PAGES = [
    (5, "http://a.b/x", LONG),
    (3, "http://a.b/x", LONG),
    (9, "http://a.b/y", LONG),
    (9, "http://a.b/y", LONG),
    (1, "http://a.b/s", "short"),
    (2, "http://a.b/s", "short"),
    (4, None, None),
    (6, "http://a.b/z", ""),
    (None, "http://a.b/n", LONG),
    (None, "http://a.b/m", "only one " * 20),
    (7, "http://x.y/\r\nWARC-Type: evil", "WARC/1.1\r\nContent-Length: 3\r\n\r\n\r\n\r\nWARC/1.1\r\n" + "é\u0000\r\n\r\n" * 30),
    (8, "http://x.y/é", "ü" * 60),
    (10, "http://x.y/e", "ü" * 60),
    (11, "http://x.y/t", "t" * 99),
    (12, "http://x.y/t", "t" * 99),
    (13, "http://x.y/t", "t" * 100),
    (14, "http://x.y/t", "t" * 100),
]


def expected(pages):
    data = [(i, u, (t or "").encode()) for i, u, t in pages]
    found = []
    for i, _, p in data:
        same = [j for j, _, q in data if q == p and j is not None]
        first = min(same, default=None) if len(p) >= 100 else None
        revisit = first is not None and i != first
        found.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return found


def order(row):
    return tuple((x is None, str(x)) for x in row)


def test_archive_and_index(spark, tmp_path):
    table = spark.createDataFrame([(t, u, i, 1, "k", "d") for i, u, t in PAGES], "html string, url string, page_id long, refers_to int, key string, digest string")
    found = warc.archive_and_index(table, path=f"{tmp_path}/w", archive_bytes=300).collect()
    told = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found]
    assert sorted(told, key=order) == sorted(expected(PAGES), key=order)
    ordered = sorted(found, key=lambda r: (r["range_id"], r["range_pos"]))
    keys = [warc.order(tuple(r)) for r in ordered]
    assert keys == sorted(keys)
    archives = {p.name: gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz")}
    assert len(archives) > 1
    texts = {}
    for r in found:
        data = archives[r["archive"]]
        ((_, length, headers, block),) = warc.parse(data[r["offset"] : r["offset"] + r["length"]])
        assert length == r["length"] and headers["warc-type"] == r["record_type"]
        if r["record_type"] == "response":
            texts.setdefault(r["page_id"], []).append(bytes(block).partition(b"\r\n\r\n")[2].decode())
    assert texts[7] == [PAGES[10][2]] and texts[4] == [""] and texts[8] == ["ü" * 60]
    assert sum(len(x) for x in archives.values()) == sum(r["length"] for r in found)


def test_hot_url_is_split_among_ranges(spark):
    pages = [(i, "http://a.b/hot", f"text {i} " * 20) for i in range(300)]
    found = warc.archive_and_index(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len({r["range_id"] for r in found}) > 1
    ordered = sorted(found, key=lambda r: (r["range_id"], r["range_pos"]))
    assert [r["page_id"] for r in ordered] == list(range(300))


def test_equal_rows_are_dealt_to_all_archives(spark):
    """Nine of ten rows are one page, id and all."""
    pages = [(1, "http://a.b/hot", LONG)] * 900 + [(i, f"http://a.b/{i}", f"text {i} " * 20) for i in range(2, 102)] + [(None, "http://a.b/none", LONG)] * 200
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    found = warc.archive_and_index(table, archive_bytes=16_000).collect()
    sizes = {}
    for r in found:
        sizes[r["archive"]] = sizes.get(r["archive"], 0) + 1
    assert len(found) == len(pages) and max(sizes.values()) < 300
    told = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found]
    assert sorted(told, key=order) == sorted(expected(pages), key=order)


def test_changed_payload_is_an_error():
    data = (
        b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: x\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 27\r\n\r\n"
        b"HTTP/1.1 200\r\nContent-Length: 1\r\n\r\na\r\n\r\n"
    ).replace(b"Content-Length: 27", b"Content-Length: 36")
    with pytest.raises(ValueError, match="not what its record says"):
        warc.entries("a", data)


def test_no_rows_and_times(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_and_index(empty).count() == 0
    table = spark.sql("SELECT 1L page_id, 'http://a.b' url, 'x' html, timestamp'2020-02-03 04:05:06' at")
    assert warc.archive_and_index(table, time_col="at").first()["timestamp"] == "2020-02-03T04:05:06Z"


def test_many_runs(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(40)}", "t", i, None, "response", None, "d", 1, f"a{rng.randrange(7)}", i, 1) for i in range(500)]
    found = warc.merge_runs(spark.createDataFrame(rows, warc.INDEX), range_rows=60).orderBy("range_id", "range_pos").collect()
    keys = [warc.order(tuple(r)) for r in found]
    assert keys == sorted(keys) and len(keys) == 500


def test_very_long_pages(spark):
    """Of millions of characters, copies among them, beside short ones: whole payloads, sizes and digests."""
    long = "".join(f"<p>paragraph {k} é</p>\r\n\r\n" for k in range(120_000))
    pages = [(1, "http://a.b/1", long), (2, "http://a.b/2", long), (3, "http://a.b/3", long + "x"), (4, "http://a.b/" + "p" * 100_000, "short"), (5, None, "y" * 2_000_000)]
    table = spark.createDataFrame([(i, u, t) for i, u, t in pages], "page_id long, url string, html string")
    found = warc.archive_and_index(table).collect()
    told = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found]
    assert sorted(told, key=order) == sorted(expected(pages), key=order)
