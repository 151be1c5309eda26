"""New papers to an index as they arrive: a file stream, analysed in micro-batches and appended, searched as blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstack import schemas
from quillstack.operators.analyze import CleanOptions, clean
from quillstack.operators.index import Index, barrel_of, lengths, lexicon, postings
from quillstack.operators.order import numbered
from quillstack.sources.shared import written


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """Extracted papers of JSON lines files that come into a folder."""
    return spark.readStream.schema(schemas.EXTRACTED).json(folder)


def append_postings(rows: DataFrame, path: str, checkpoint: str, options: CleanOptions = CleanOptions(), available_now: bool = True) -> StreamingQuery:  # noqa: B008
    """Appends each micro-batch's postings and papers, as a block by batch id; a batch that is run again overwrites it.

    Blocks of a term merge where they are read, by ``merged``; ``load`` gives an index of all blocks so far.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        found = postings(clean(batch, options), "paper_id").withColumn("barrel_id", barrel_of(F.col("term")))
        batch.select("paper_id").distinct().write.mode("overwrite").parquet(f"{path}/_docs/block={batch_id}")
        found.write.mode("overwrite").parquet(f"{path}/block={batch_id}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merged(blocks: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """One posting for each term and document: positions of all blocks, in order."""
    per = blocks.groupBy("term", id_col).agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return per.select("term", id_col, F.size("positions").alias("tf"), "positions")


def load(spark: SparkSession, path: str) -> Index:
    """An index of the blocks so far, to be searched, or written as an index that is dealt to barrels.

    Ids count papers by the block in which they come first, then by their own ids: those of older blocks stay. A paper
    that comes again adds its positions to what is there. Lexicon and lengths follow from the merged postings.
    """
    seen = spark.read.parquet(f"{path}/_docs").groupBy("paper_id").agg(F.min("block").cast("long").alias("block")).where(F.col("paper_id").isNotNull())
    ids = numbered(seen.withColumn("place", F.struct("block", "paper_id")), "place", F.col("block"), "doc_id").select("doc_id", F.col("paper_id").alias("orig_id"))
    docs = written(ids.withColumn("doc_id", F.col("doc_id").cast("long")), "docs")
    found = merged(spark.read.parquet(path)).join(docs.withColumnRenamed("orig_id", "paper_id"), "paper_id").drop("paper_id")
    found = written(found.withColumn("barrel_id", barrel_of(F.col("term"))), "postings")
    return Index(docs, found, lexicon(found), lengths(found), derived=True)


def term_counts(rows: DataFrame, terms: Column, id_col: str, at: str, delay: str = "1 hour") -> DataFrame:
    """(term, doc_freq, term_freq) of a stream of documents, kept up as they arrive: state is a row for each term.

    A document that comes again within ``delay`` of the latest time ``at`` counts once; one that is later than that by
    the stream's watermark counts no more, as its id may have been forgotten.
    """
    once = rows.withWatermark(at, delay).dropDuplicatesWithinWatermark([id_col])
    own = once.select(F.array_sort(terms).alias("l"))
    each = own.select(F.explode(F.transform("l", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (F.get("l", i - 1) != x)).alias("first")))).alias("t"))
    return each.groupBy("t.term").agg(F.sum(F.col("t.first").cast("int")).cast("int").alias("doc_freq"), F.count("*").alias("term_freq"))


def keep_updates(counts: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes the rows of a streaming aggregate that each micro-batch changed; a batch that is run again overwrites its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The latest row of each key of what ``keep_updates`` wrote."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))
