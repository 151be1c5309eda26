"""The pipeline's programs as jobs: papers to rows, rows to tokens, tokens to an index, and an index's exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.operators import analyze, barrels, extract, index, metrics, segments
from quillstack.sources import readers, writers
from quillstack.sources.shared import written


def extract_papers(spark: SparkSession, paths: str | Sequence[str], tsv: str | None = None, jsonl: str | None = None) -> DataFrame:
    """Extracted rows of paper files, written in the forms asked for."""
    rows = extract.extract(readers.sound(readers.papers(spark, paths)))
    if tsv:
        writers.extracted_tsv(rows, tsv)
    if jsonl:
        writers.extracted_jsonl(rows, jsonl)
    return rows


def clean_rows(spark: SparkSession, source: str, kind: str, out: str, options: analyze.CleanOptions = analyze.CleanOptions()) -> None:  # noqa: B008
    """Extracted rows of a tsv or jsonl file to cleaned JSON lines."""
    rows = readers.extracted_tsv(spark, source) if kind == "tsv" else readers.extracted_jsonl(spark, source)
    writers.cleaned_jsonl(analyze.cleaned(rows, analyze.clean(rows, options)), out)


def index_cleaned(spark: SparkSession, source: str, out: str, skip_interval: int = index.SKIP_INTERVAL, monitor: metrics.IndexingMonitor | None = None) -> index.Index:
    """An index of cleaned JSON lines, written to and loaded from a folder.

    Ids count documents by their first line; lines that share a docid are one document. ``monitor`` counts the lines
    as they are read, and their tokens.
    """
    lines = readers.cleaned_jsonl(spark, source)
    if monitor:
        lines = monitor.watch(lines, tokens=F.sum(F.aggregate("fields", F.lit(0).cast("long"), lambda n, f: n + F.size(f["tokens"]))))
    rows = written(lines, "cleaned")  # lines are parsed once
    docs = index.document_map(rows.where(F.col("docid").isNotNull()), "docid", "line_no")
    named = docs.withColumnRenamed("orig_id", "paper_id")
    tokens = written(analyze.tokens_of_cleaned(rows).join(named, "paper_id").select("doc_id", "pos", "term"), "tokens")
    found = index.Index(docs, index.postings(tokens), index.lexicon_with_offsets(tokens, skip_interval=skip_interval), index.lengths(index.counts(tokens)))
    found.write(out)
    return index.Index.load(spark, out)


def add_cleaned(spark: SparkSession, source: str, out: str, batch: int | None = None, deleted: DataFrame | None = None) -> segments.Segments:
    """Adds cleaned JSON lines to an index that grows, and merges its segments by tiers.

    Documents that it has are replaced, new ones get ids that go on from its last; ``deleted`` are docids that go. A
    batch that is lost is run again under its number, which is the segments' otherwise.
    """
    own = segments.Segments(spark, out)
    rows = written(readers.cleaned_jsonl(spark, source), "cleaned")
    batch = own.version() + 1 if batch is None else batch
    docs = written(segments.assign_ids(spark, f"{out}/ids", batch, rows, "docid", F.col("line_no")), "ids")
    tokens = analyze.tokens_of_cleaned(rows).join(docs.withColumnRenamed("orig_id", "paper_id"), "paper_id").select("doc_id", "pos", "term")
    gone = None
    if deleted is not None:
        known = spark.read.parquet(f"{out}/ids").select("orig_id", "doc_id")
        gone = deleted.toDF("orig_id").join(known, "orig_id").select("doc_id").join(docs.select("doc_id"), "doc_id", "left_anti")
    own.add(index.build(tokens, docs), gone)
    while own.merge():
        pass
    return own


def load(spark: SparkSession, path: str) -> index.Index:
    """A written index, or one that grows, as it is now."""
    growing = segments.Segments(spark, path)
    return growing.index() if growing.segments() else index.Index.load(spark, path)


def export(found: index.Index, out: str) -> None:
    """The text and byte files of an index, for other programs."""
    lists = index.posting_lists(found.postings)
    writers.inverted_block(lists, f"{out}/block.inv")
    writers.lexicon(found.lexicon, f"{out}/lexicon")
    writers.terms_list(found.lexicon, f"{out}/terms_list")
    writers.docid_map(found.docs, f"{out}/docid_map")
    original = found.docs.select("doc_id", F.col("orig_id").alias("docid"))
    forward = index.forward(found.postings, found.lexicon).join(original.withColumnRenamed("docid", "name"), F.col("docid") == F.col("doc_id"))
    writers.forward_index(forward.select(F.col("name").alias("docid"), "postings"), f"{out}/forward_index")
    block = F.array_sort(F.collect_list(F.struct("term", "positions"))).alias("postings")
    writers.forward_block(found.postings.join(original, "doc_id").groupBy("docid").agg(block), f"{out}/block.fwd")
    writers.postings_bytes(index.encoded(found.postings, found.lexicon), f"{out}/postings")
    writers.barrel_metadata(barrels.metadata(found.lexicon), f"{out}/barrel_metadata")
