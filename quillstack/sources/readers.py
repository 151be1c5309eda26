"""Readers. Explicit schemas, bad records kept apart instead of failing a job."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillstack import schemas
from quillstack.functions import text as T

CORRUPT = "_corrupt_record"


def _with_corrupt(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(CORRUPT, StringType())])


def papers(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*.json") -> DataFrame:
    """Paper objects of the .json files of folders (not below them), or of listed files, with their file's name.

    A file that is no JSON object is a row with its text in _corrupt_record; ``sound`` leaves those out.
    """
    found = spark.read.schema(_with_corrupt(schemas.PAPER)).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", pattern)
    rows = found.json([paths] if isinstance(paths, str) else list(paths))
    return rows.select("*", F.col("_metadata.file_name").alias("orig_file"))


def sound(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad(rows: DataFrame) -> DataFrame:
    """What a parser could not read, for a log."""
    return rows.where(F.col(CORRUPT).isNotNull())


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, line_no) of the lines of a text file that are not empty, or of a folder's files one after another by their
    names; line_no counts from 1, empty ones included.

    Files may be of any size and number: a line's number comes from its place in its split, and those of splits from
    the splits before, of which each is one row. No line is shuffled: those of a split follow each other in one task.
    """
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("at"))
    split = rows.groupBy("file", "begin").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("file", "begin").rowsBetween(Window.unboundedPreceding, -1)
    ahead = split.select("file", "begin", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return rows.join(F.broadcast(ahead), ["file", "begin"]).select("line", (F.col("ahead") + F.col("at") - F.col("first") + 1).alias("line_no")).where(F.length("line") > 0)


def tsv_fields(line, names: Sequence[str] = schemas.EXTRACTED_FIELDS):  # noqa: ANN001, ANN201
    """Fields of a line cut at tabs; the last takes all that is left, missing ones are empty. There is no quoting."""
    parts = F.split(line, "\t", len(names))
    return [F.coalesce(F.get(parts, k), F.lit("")).alias(n) for k, n in enumerate(names)]


def extracted_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.length("value") > 0).select(*tsv_fields(F.col("value")))


def jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Objects, one a line, with line_no; lines that are none have their text in _corrupt_record."""
    parsed = lines(spark, path).withColumn("j", F.from_json("line", _with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    return parsed.select("j.*", "line_no")


def extracted_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Extracted papers; paper_id, else docid, else the line's number."""
    schema = StructType([*schemas.EXTRACTED.fields, StructField("docid", StringType()), StructField("body", StringType())])
    rows = sound(jsonl(spark, path, schema))
    return rows.withColumn("paper_id", F.coalesce("paper_id", "docid", F.col("line_no").cast("string"))).drop("docid")


def cleaned_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return sound(jsonl(spark, path, schemas.CLEANED))


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    """(term) with A-Z in lower case; blank lines and comments out. A path that is not there gives none, as a warning would."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], "term string")
    term = F.btrim("value", F.lit(" \t\r\n"))
    return rows.select(T.lower(term, True).alias("term")).where((F.col("term") != "") & ~F.col("term").startswith("#")).distinct()


def _tabbed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("mode", "DROPMALFORMED").csv(path)


def inverted_block(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id, positions) of a text block of postings; a line without a tab is a term without postings."""
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(path).where(F.length("value") > 0).select(F.get(parts, 0).alias("term"), F.get(parts, 1).alias("list"))
    each = rows.select("term", F.explode(F.filter(F.split("list", ";"), lambda x: x != "")).alias("p"))
    pair = F.split("p", ":", 2)
    positions = F.transform(F.filter(F.split(F.get(pair, 1), ","), lambda x: x != ""), lambda x: x.try_cast("int"))
    return each.select("term", F.get(pair, 0).try_cast("int").alias("doc_id"), positions.alias("positions"))


def forward_block(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FORWARD_BLOCK).json(path)


def forward_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FORWARD).json(path)


def terms_list(spark: SparkSession, path: str) -> DataFrame:
    """(term, word_id) of a file; of a term that repeats, the last line's."""
    parts = F.split("line", "\t")
    rows = lines(spark, path).select(F.get(parts, 0).alias("term"), F.get(parts, 1).try_cast("int").alias("word_id"), "line_no")
    return rows.where(F.col("word_id").isNotNull()).groupBy("term").agg(F.max_by("word_id", "line_no").alias("word_id"))


def lexicon(spark: SparkSession, path: str, columns: int = 6) -> DataFrame:
    """Rows with all of the first six columns, or of the first four, which suggestions need; others where they are."""
    parts = F.split("value", "\t")
    fields = [F.nullif(F.get(parts, k), F.lit("")).try_cast(f.dataType).alias(f.name) for k, f in enumerate(schemas.LEXICON.fields)]
    return spark.read.text(path).select(*fields).dropna(subset=schemas.LEXICON.fieldNames()[:columns])


def docid_map(spark: SparkSession, path: str) -> DataFrame:
    return _tabbed(spark, path, schemas.DOCID_MAP).dropna()


def barrel_metadata(spark: SparkSession, path: str) -> DataFrame:
    return _tabbed(spark, path, schemas.BARREL_METADATA).dropna()


#: Bytes of a chunk of a byte file.
CHUNK = 1 << 16


_PIECES = "barrel_id int, file string, size long, begin long, own long, content binary"


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits, which follow each other, as longer pieces, each with its place in its split."""
    at, ahead = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        file, begin = b.column("file").dictionary_encode().indices.to_numpy(), b.column("begin").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(begin) != 0)) + 1).tolist(), b.num_rows]
        rows = []
        for x, y in zip(cuts, cuts[1:], strict=False):
            head = b.slice(x, 1).select(["barrel_id", "file", "size", "begin"]).to_pylist()[0]
            content = b"\n".join([*b.column("line").slice(x, y - x).to_pylist(), b""])
            if (head["file"], head["begin"]) != at:
                at, ahead = (head["file"], head["begin"]), 0
            rows.append(head | {"own": ahead, "content": content})
            ahead += len(content)
        types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in _PIECES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)


def _byte_lines(spark: SparkSession, path: str) -> DataFrame:
    """(barrel_id, at, content): the bytes of barrels between line feeds, those included, and where they are in the barrel.

    A barrel is a file barrel_<id>.bin, or the files of a folder barrel_id=<id>, by their names. Spark's text reader
    cuts a file of any size into splits, at line feeds; a split's place in its barrel is the sum of those before. Lines
    of a split follow each other in one task, where they are joined to longer pieces; only rows for splits are sent.
    """
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    file, size, begin = (F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_block_start"))
    barrel = F.regexp_extract(file, r"/barrel_(?:(\d+)\.bin|id=(\d+)/[^/]*)$", 0)
    rows = rows.select(F.regexp_extract(barrel, r"barrel_(?:id=)?(\d+)", 1).try_cast("int").alias("barrel_id"), file.alias("file"), size.alias("size"), begin.alias("begin"), F.col("value").cast("binary").alias("line"))
    rows = rows.where(F.col("barrel_id").isNotNull())
    # a row for each split of a barrel's files
    splits = rows.groupBy("barrel_id", "file", "size", "begin").agg(F.sum(F.octet_length("line").cast("long") + 1).alias("n"))
    files = splits.groupBy("barrel_id", "file", "size").agg(F.sum("n").alias("n"))
    before = lambda *by: Window.partitionBy("barrel_id", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    # the reader leaves out a mark of byte order at a file's start, and the last line may have no end
    mark = F.when(F.col("size") - F.col("n") >= 2, F.lit(3)).otherwise(F.lit(0))
    files = files.select("barrel_id", "file", F.coalesce(F.sum("size").over(before("file")), F.lit(0)).alias("base"), mark.alias("mark"))
    splits = splits.select("barrel_id", "file", "begin", F.coalesce(F.sum("n").over(before("file", "begin")), F.lit(0)).alias("ahead"))
    joined = rows.mapInArrow(_joined, _PIECES)
    lines_ = joined.join(F.broadcast(splits), ["barrel_id", "file", "begin"]).join(F.broadcast(files), ["barrel_id", "file"])
    place = F.col("ahead") + F.col("own")
    first = (F.col("mark") > 0) & (place == 0)
    content = F.concat(F.when(first, F.lit(bytearray(b"\xef\xbb\xbf"))).otherwise(F.lit(bytearray())), "content")
    within = F.when(first, F.lit(0)).otherwise(F.col("mark") + place)
    content = F.substring(content, F.lit(1), F.least(F.octet_length(content).cast("long"), F.col("size") - within).cast("int"))
    return lines_.select("barrel_id", (F.col("base") + within).alias("at"), content.alias("content")).where(F.octet_length("content") > 0)


def barrel_blobs(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(barrel_id, chunk, content): the bytes of barrels in chunks of one size, by their number; the last may be shorter.

    Files are read by as many tasks as they have splits, and no task or row holds more than it has a use for.
    """
    lines_ = _byte_lines(spark, path)
    end = F.col("at") + F.octet_length("content")
    numbers = F.sequence(F.floor(F.col("at") / chunk), F.floor((end - 1) / chunk))
    each = lines_.select("barrel_id", "at", "content", end.alias("end"), F.explode(numbers).alias("chunk"))
    start = F.greatest("at", F.col("chunk") * chunk)
    part = F.substring("content", (start - F.col("at") + 1).cast("int"), (F.least("end", (F.col("chunk") + 1) * chunk) - start).cast("int"))
    pieces = each.select("barrel_id", "chunk", F.struct(start.alias("at"), part.cast("string").alias("part")).alias("p"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "")
    return pieces.groupBy("barrel_id", "chunk").agg(whole.cast("binary").alias("content"))


def posting_slices(blobs: DataFrame, words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(term, content): each term's encoded list, cut from its barrel's chunks by the lexicon's offset and bytes.

    A list meets the chunks that it lies in, and those alone.
    """
    end = F.col("offset") + F.col("bytes")
    least, last = F.floor(F.col("offset") / chunk), F.floor((end - 1) / chunk)
    own = words.where("bytes > 0").select("term", F.col("barrel_id").alias("of"), "offset", "bytes", (last > least).alias("cut"), F.explode(F.sequence(least, last)).alias("number"))
    both = own.join(blobs, (F.col("of") == F.col("barrel_id")) & (F.col("number") == F.col("chunk")))
    start = F.greatest("offset", F.col("chunk") * chunk)
    part = F.substring("content", (start - F.col("chunk") * chunk + 1).cast("int"), (F.least(end, (F.col("chunk") + 1) * chunk) - start).cast("int"))
    pieces = both.where("cut").select("term", "of", "offset", F.struct("chunk", part.cast("string").alias("part")).alias("p"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "")
    some = pieces.groupBy("term", "of", "offset").agg(whole.cast("binary").alias("content")).select("term", "content")
    return both.where("NOT cut").select("term", part.alias("content")).unionAll(some)  # lists in one chunk are whole
