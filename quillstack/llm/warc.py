"""WARC archives of captures, and their index: locally sorted runs, merged by loser trees into ordered histories.

Archives are written by Spark's own text writer: a record is a row, and what ends a record in WARC is its line
separator. So they go to whatever store the session uses, through its commit protocol. Every archive is read back,
each response's payload digest is held against its record, and its captures are sorted by URL key and timestamp: a
run. Runs are cut at common key ranges, and each range merges its slices of all runs by a loser tree.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import batched, materialize, new_path, partitions, rows, with_rows

#: Payloads under this many bytes are never revisits.
LEAST_SHARED = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=UTC)
#: Uncompressed bytes of an archive, about.
ARCHIVE_BYTES = 32 << 20
INDEX = "urlkey string, timestamp string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, archive string, offset long, length long"
_INDEX = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[k]) for n, k in (x.split() for x in INDEX.split(", "))])


def url_key(url: str | None) -> str:
    """The key that sorts captures of a site together: the host's labels from the last, then path and query."""
    rest = (url or "").partition("#")[0].strip()
    rest = rest.partition("://")[2] or rest
    cut = next((i for i, c in enumerate(rest) if c in "/?"), len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:].lower()
    for port in (":80", ":443"):
        host = host.removesuffix(port)
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (path or "/")


class LoserTree:
    """Merges sorted iterators. Inner nodes hold the loser of their match, so that a step replays one path only."""

    def __init__(self, runs: list[Iterator], key: Callable) -> None:
        self.runs, self.key, n = runs, key, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * n
        for leaf in range(n):
            self._seat(leaf)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; ties go to the earlier run, exhausted runs come last."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None or (self.keys[b] is None and a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _seat(self, winner: int) -> None:
        at = (winner + len(self.runs)) // 2
        while at:
            if self.losers[at] < 0:
                self.losers[at] = winner
                return
            if self._beats(self.losers[at], winner):
                self.losers[at], winner = winner, self.losers[at]
            at //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.runs and self.keys[won := self.losers[0]] is not None:
            yield self.heads[won]
            self.heads[won] = head = next(self.runs[won], None)
            self.keys[won] = None if head is None else self.key(head)
            at = (won + len(self.runs)) // 2
            while at:
                if self._beats(self.losers[at], won):
                    self.losers[at], won = won, self.losers[at]
                at //= 2
            self.losers[0] = won


def _line(name: str, value: Column) -> Column:
    """A header line; none for null. Line ends in values would end the header: they are escaped as in URLs."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _name(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def records(captures: DataFrame) -> DataFrame:
    """The text of each capture's record, from (page_id, url, captured, payload, digest, refers_to)."""
    revisit = F.col("is_revisit")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _name(F.col("page_id"))),
        _line("WARC-Date", F.col("captured")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("WARC-Refers-To", F.when(revisit, _name(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    return captures.select(F.concat(head, block).alias("value"))


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """What to write of each row: revisits are settled on digests alone, before any payload moves."""
    page = F.col(id_col).cast("long")
    seconds = F.coalesce(page, F.lit(0)) % F.lit(10**9) if time_col is None else F.unix_seconds(F.col(time_col))
    captured = F.date_format(F.timestamp_seconds((F.lit(0) if time_col else F.lit(int(FIRST_CAPTURE.timestamp()))) + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    whole = pages.select(page.alias("page_id"), F.col(url_col).cast("string").alias("url"), captured.alias("captured"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    whole = with_rows(whole).withColumn("digest", F.sha2("payload", 256))
    thin = materialize(whole.select("row", "page_id", "digest", F.octet_length("payload").cast("long").alias("bytes")), "digests")
    shared = thin.where(F.col("bytes") >= LEAST_SHARED)
    firsts = materialize(shared.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    later = shared.join(firsts, "digest").where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    later = materialize(later.select("row", "refers_to"), "revisits")
    total = thin.agg(F.sum("bytes")).first()[0] or 0
    # by its row: copies are dealt to archives as other pages are
    dealt = whole.repartition(partitions(pages.sparkSession, total, archive_bytes), "row")
    return dealt.join(later, "row", "left").withColumn("is_revisit", F.col("refers_to").isNotNull())


def write_archives(found: DataFrame, path: str) -> None:
    """Writes captures as gzipped WARC files at ``path``, one for each partition, under the names that Spark gives them."""
    records(found).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """(offset, length, headers, block) of each record of an archive, uncompressed."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        first, *lines = archive[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError(f"no record at {at}")
        headers = dict((n.lower(), v) for n, _, v in (x.partition(": ") for x in lines))
        stop = end + 4 + int(headers["content-length"])
        if archive[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it says")
        yield at, stop + 4 - at, headers, view[end + 4 : stop]
        at = stop + 4


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def entries(name: str, archive: bytes) -> list[tuple]:
    """The index entries of an archive, sorted: a run. A response whose payload has another digest is an error."""
    found = []
    for offset, length, headers, block in parse(archive):
        head, _, payload = bytes(block).partition(b"\r\n\r\n")
        size = next(int(x[16:]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))
        digest = headers["warc-payload-digest"].removeprefix("sha256:")
        kind, url = headers["warc-type"], headers.get("warc-target-uri")
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"{name}: the payload at {offset} is not what its record says")
        refers = _page(headers.get("warc-refers-to"))
        found.append((url_key(url), headers["warc-date"], _page(headers["warc-record-id"]), url, kind, refers, digest, size, name, offset, length))
    return sorted(found, key=order)


def order(entry: tuple) -> tuple:
    """URL key, timestamp, page (null last), place."""
    page = entry[2]
    return entry[0].encode(), entry[1], page is None, page or 0, entry[8], entry[9]


def index_runs(spark, path: str) -> DataFrame:  # noqa: ANN001
    """Every archive's captures, each archive's sorted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                name = b.column(0)[k].as_py().rpartition("/")[2]
                yield from batched(entries(name, gzip.decompress(b.column(1)[k].as_buffer())), _INDEX)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(run, INDEX)


def merge_runs(runs: DataFrame, range_rows: int = 200_000) -> DataFrame:
    """All runs merged: (range_id, range_pos) is the place of a capture in the order of URL key and timestamp.

    Range bounds take the page and its place in as well as the key, so that a URL with very many captures is split
    among ranges. Spark's shuffle does not promise the order of a run's slice, which is therefore checked.
    """

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[tuple]] = {}
        for row in rows(batches, *_INDEX.names):
            slices.setdefault(row[8], []).append(row)
        number = TaskContext.get().partitionId()
        for run in slices.values():
            run.sort(key=order)  # one pass where it is in order
        tree = LoserTree([iter(slices[name]) for name in sorted(slices)], order)
        out = pa.schema([*_INDEX, ("range_id", pa.int32()), ("range_pos", pa.int64())])
        yield from batched(((*row, number, k) for k, row in enumerate(tree)), out)

    n = partitions(runs.sparkSession, runs.count(), range_rows)
    bounds = ["urlkey", "timestamp", F.col("page_id").asc_nulls_last(), "archive", "offset"]
    return runs.repartitionByRange(n, *bounds).mapInArrow(merged, f"{INDEX}, range_id int, range_pos long")


def ranked(index: DataFrame) -> DataFrame:
    """A merged index with ``position``, from 1, in the order of all captures; a row for each range meets in one task."""
    index = materialize(index, "index")
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = index.groupBy("range_id").agg(F.count("*").alias("n"))
    ahead = sizes.select("range_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return index.join(ahead, "range_id").withColumn("position", F.col("ahead") + F.col("range_pos") + 1).drop("ahead")


def archive_and_index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row at ``path`` (the shared folder, if none), reads it back, and gives the merged index.

    Payloads are the column in UTF-8, null as empty. Of rows with equal payloads of LEAST_SHARED bytes and more, those
    with the smallest id are responses (all of them, should the id repeat), others revisit it; rows without an id
    revisit one that has one, and are responses where none has. Null URLs have no target line and sort first. Without
    ``time_col`` a capture's time is FIRST_CAPTURE and as many seconds as its id. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(captures(pages, id_col, url_col, payload_col, time_col, archive_bytes), path)
    return merge_runs(materialize(index_runs(spark, path), "runs"))
