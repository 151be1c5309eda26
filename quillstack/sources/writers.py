"""Writers of the interchange formats. The canonical form of every table is Parquet; these are for other programs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack import schemas
from quillstack.operators import order
from quillstack.sources.shared import written


def _lines(value: Column, rows: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    rows.select(value.alias("value")).write.mode(mode).text(path, compression=compression)


def _tabs(*columns: str | Column) -> Column:
    return F.concat_ws("\t", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns))


def extracted_tsv(rows: DataFrame, path: str) -> None:
    """Eight columns, no header, no quoting; sections joined by a bar."""
    joined = rows.withColumn("sections", F.array_join("sections", " | "))
    clean = [F.translate(F.col(n), "\t\n\r", "   ") for n in schemas.EXTRACTED_FIELDS]
    _lines(_tabs(*clean), joined, path)


def extracted_jsonl(rows: DataFrame, path: str) -> None:
    rows.select(*schemas.EXTRACTED.fieldNames()).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def cleaned_jsonl(rows: DataFrame, path: str, compression: str = "none") -> None:
    """(docid, fields, meta); a token's orig only where it is kept."""
    _lines(F.to_json(F.struct("docid", "fields", "meta")), rows, path, compression=compression)


def inverted_block(postings: DataFrame, path: str) -> None:
    """A line for each row of (term, postings): a term is on a line for each block that it is in."""
    one = lambda p: F.concat(p["doc_id"].cast("string"), F.lit(":"), F.array_join(F.transform(p["positions"], lambda x: x.cast("string")), ","))
    _lines(F.concat("term", F.lit("\t"), F.array_join(F.transform("postings", one), ";")), postings, path)


def forward_block(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Objects, one a line; ``compression`` is the codec of the files, such as gzip, which their names tell readers."""
    rows.select("docid", "postings").write.mode("overwrite").json(path, compression=compression)


def forward_index(rows: DataFrame, path: str, compression: str = "none") -> None:
    rows.select("docid", "postings").write.mode("overwrite").json(path, compression=compression)


def lexicon(rows: DataFrame, path: str) -> None:
    """By word id, so that a reader finds lists in the order of their offsets."""
    term = F.translate("term", "\t\n\r", "   ")
    ordered = rows.repartitionByRange("word_id").sortWithinPartitions("word_id")
    _lines(_tabs("word_id", term, "doc_freq", "term_freq", "offset", "bytes", "skip_meta", "barrel_id"), ordered, path)


def terms_list(rows: DataFrame, path: str) -> None:
    _lines(_tabs("term", "word_id"), rows, path)


def docid_map(rows: DataFrame, path: str) -> None:
    _lines(_tabs("orig_id", "doc_id"), rows, path)


def postings_bytes(rows: DataFrame, path: str) -> None:
    """(word_id, offset, content) as Parquet; the bytes of all lists by offset are the single-file form."""
    rows.select("word_id", "offset", "content").repartitionByRange("offset").sortWithinPartitions("offset").write.mode("overwrite").parquet(path)


def _byte_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(barrel_id, offset, n, line) of each list's bytes, cut at line ends, which a text writer puts back."""
    for b in batches:
        held: list[tuple[int, int, int, bytes]] = []
        for barrel, offset, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for k, line in enumerate(content.split(b"\n")):
                held.append((barrel, offset, k, line))
        types = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], t) for k, t in enumerate(types)], names=["barrel_id", "offset", "n", "line"])


def barrel_blobs(rows: DataFrame, path: str) -> DataFrame:
    """Byte files of barrels from (term, barrel_id, offset, content), lists by their offsets, which tell them apart; gives
    back (term, barrel_id, offset, bytes), the offset within the barrel.

    A barrel is a folder barrel_id=<id>; its files, by name, are one after another the barrel's bytes, each written by
    a task of its own. Each list is followed by one line end, as the text writer that writes the bytes ends its rows;
    offsets count it. Bytes are dealt once, to their files; the sums that offsets are of move sizes alone.
    """
    rows = written(rows.select("term", "barrel_id", "offset", "content"), "lists")  # encoded once, read for sizes and for bytes
    sizes = rows.select("term", "barrel_id", F.struct("barrel_id", "offset").alias("key"), F.octet_length("content").cast("long").alias("bytes"))
    placed = order.running(sizes.withColumn("size", F.col("bytes") + 1), "key", None, {"at": "size"})
    first = placed.groupBy(F.col("barrel_id").alias("of")).agg(F.min("at").alias("first"))  # a row for each barrel
    placed = placed.join(F.broadcast(first), F.col("barrel_id") == F.col("of")).withColumn("at", F.col("at") - F.col("first"))
    lines = rows.select("barrel_id", F.col("offset").cast("long"), "content").mapInArrow(_byte_lines, "barrel_id int, offset long, n int, line binary")
    lines = lines.repartitionByRange("barrel_id", "offset", "n").sortWithinPartitions("barrel_id", "offset", "n")
    lines.select("barrel_id", F.col("line").cast("string").alias("value")).write.mode("overwrite").partitionBy("barrel_id").text(path)
    return placed.select("term", "barrel_id", F.col("at").alias("offset"), "bytes")


def barrel_metadata(rows: DataFrame, path: str) -> None:
    _lines(_tabs(*schemas.BARREL_METADATA.fieldNames()), rows, path)


def stats_csv(stats: DataFrame, path: str) -> None:
    """(key, value) rows, with a header of that."""
    stats.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
