"""Queries that write a file format of the pipeline, read it back, and give what its reader gives: round trips.

Files go to the shared folder. Each query takes all rows of its table; its SQL knows the table alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import codec
from quillstack.functions import text as T
from quillstack.operators import analyze, barrels, index, search, segments
from quillstack.plans.catalog import (
    BARREL_SQL,
    LENGTHS,
    LEXICON,
    SQL,
    documents,
    extracted,
    fielded,
    listed,
    posting_lists,
    query,
    table,
    token_rows,
    whole_index,
)
from quillstack.sources import readers, writers
from quillstack.sources.shared import new_path, written
from quillstack.sources.spread import pieces
from quillstack.streaming import ingest

# -- papers and extracted rows ----------------------------------------------------------------------------------------


@query(
    "SELECT item_id::INT AS item_id, CASE WHEN contains(text, ',') THEN 'I' || item_id END AS paper_id, CASE WHEN contains(text, ',') THEN split_part(text, chr(10), 1) END AS title, "
    "CASE WHEN NOT contains(text, ',') THEN '{\"paper_id\":' || item_id END AS bad FROM benchmark"
)
def paper_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each item; files that are no JSON are kept apart, with their text."""
    items = table(spark, sf_dir, "benchmark")
    whole = F.to_json(F.struct(F.concat(F.lit("I"), "item_id").alias("paper_id"), F.struct(F.split_part("text", F.lit("\n"), F.lit(1)).alias("title")).alias("metadata")))
    value = F.when(F.contains("text", F.lit(",")), whole).otherwise(F.concat(F.lit('{"paper_id":'), "item_id"))
    path = new_path(spark, "papers")
    items.select("item_id", value.alias("value")).write.partitionBy("item_id").option("lineSep", "\n").text(path)
    rows = written(readers.papers(spark, path, "*.txt"), "parsed")  # Spark has no query of bad records alone on files
    sound, bad = readers.sound(rows), readers.bad(rows)
    one = sound.select("item_id", "paper_id", F.col("metadata.title").alias("title"), F.lit(None).cast("string").alias("bad"))
    return one.union(bad.select("item_id", F.lit(None).cast("string"), F.lit(None).cast("string"), F.rtrim(readers.CORRUPT, F.lit("\n"))))


_EXTRACTED = " JOIN ".join(f"({SQL[n]}) {n}" + (" USING (doc_id)" if k else "") for k, n in enumerate(("extract_ids", "extract_titles", "extract_abstracts", "extract_sections", "extract_authors", "extract_dates_and_dois")))


@query(f"SELECT paper_id, title, abstract, sections, authors, pub_date, doi_or_id, source FROM {_EXTRACTED}")
def extracted_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tsv")
    writers.extracted_tsv(extracted(spark, sf_dir), path)
    return readers.extracted_tsv(spark, path)


@query(f"SELECT paper_id, title, abstract, sections, authors, pub_date, doi_or_id, source, 'f' || doc_id || '.xml.json' AS orig_file FROM {_EXTRACTED}")
def extracted_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "jsonl")
    writers.extracted_jsonl(extracted(spark, sf_dir), path)
    found = readers.extracted_jsonl(spark, path)
    return found.withColumn("sections", F.array_join("sections", " | ")).drop("body", "line_no")


@query(
    "WITH n AS (SELECT *, row_number() OVER (ORDER BY item_id) AS line FROM benchmark) "
    "SELECT CASE WHEN contains(text, ',') THEN 'I' || item_id ELSE line::VARCHAR END AS paper_id, length(text) AS chars FROM n WHERE NOT contains(text, ';')"
)
def extracted_jsonl_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id from docid, or from the line's number; lines that are no JSON have no row, but a number."""
    items = table(spark, sf_dir, "benchmark")
    line = F.to_json(F.struct(F.when(F.contains("text", F.lit(",")), F.concat(F.lit("I"), "item_id")).alias("docid"), F.col("text").alias("title")))
    path = new_path(spark, "jsonl")
    items = items.select("item_id", F.when(F.contains("text", F.lit(";")), F.lit("{no JSON")).otherwise(line).alias("value"))
    items.repartitionByRange(3, "item_id").sortWithinPartitions("item_id").select("value").write.text(path)  # files in the order of items
    return readers.extracted_jsonl(spark, path).select("paper_id", F.char_length("title").cast("long").alias("chars"))


# -- cleaned rows -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id::VARCHAR AS paper_id, field_idx, field, pos, term FROM (" + SQL["field_tokens"] + ")")
def cleaned_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens to nested lines and back. Fields that a filter leaves without a token have none in either form."""
    rows = fielded(spark, sf_dir).withColumns({"paper_id": F.col("doc_id").cast("string"), "authors": F.lit(""), "pub_date": F.lit(""), "source": F.lit("")})
    nested = analyze.cleaned_rows(rows, analyze.CleanOptions(fields=("title", "body")))
    path = new_path(spark, "cleaned")
    writers.cleaned_jsonl(nested, path, "gzip")
    back = readers.cleaned_jsonl(spark, path)
    # a name is a field's place here, as title and body are the only ones and come in this order
    found = analyze.tokens_of_cleaned(back).drop("orig")
    return found.withColumn("field_idx", F.when(F.col("field") == "title", F.lit(0)).otherwise(F.lit(1)))


@query("SELECT doc_id::VARCHAR AS docid, source || '; ' || lang AS authors, n_chars::VARCHAR AS pub_date, 'pdf' AS source, 0 AS fields FROM documents")
def cleaned_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes with a document's tokens; a document that has none, here for an unknown field, has its row."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("paper_id"), F.concat_ws("; ", "source", "lang").alias("authors"), F.col("n_chars").cast("string").alias("pub_date"), F.lit("pdf").alias("source"), "text")
    nested = analyze.cleaned_rows(docs, analyze.CleanOptions(fields=("unknown",)))
    path = new_path(spark, "cleaned")
    writers.cleaned_jsonl(nested, path)
    return readers.cleaned_jsonl(spark, path).select("docid", "meta.authors", "meta.pub_date", "meta.source", F.size("fields").alias("fields"))


@query(
    "WITH o AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, lang FROM documents) "
    "SELECT doc_id, 'title' AS name, title AS text FROM o UNION ALL SELECT doc_id, 'lang', lang FROM o UNION ALL SELECT doc_id, 'body', 'no name' FROM o UNION ALL SELECT doc_id, 'title', title FROM o"
)
def field_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in the order chosen, one of them twice and one that is unknown; sections from one bar-joined string."""
    rows = documents(spark, sf_dir).select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.concat(F.lit("lang:"), "lang", F.lit(" | no name |  | ")).alias("sections"))
    chosen = analyze.fields(rows, analyze.CleanOptions(fields=("title", "sections", "other", "title")))
    return rows.select("doc_id", F.explode(chosen).alias("f")).select("doc_id", "f.name", "f.text")


@query(f"SELECT DISTINCT translate(trim(s, ' ' || chr(9) || chr(10) || chr(13)), '{T.UPPER}', '{T.LOWER}') AS term FROM (SELECT unnest(string_split(p_name, ' ')) AS s FROM part UNION SELECT upper(c_name) FROM customer)")
def stopword_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list with comments, blank lines, blanks at the ends and capitals."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("s")).union(table(spark, sf_dir, "customer").select(F.upper("c_name")))
    lines = words.select(F.concat(F.lit("  "), "s", F.lit("\t")).alias("value")).union(spark.createDataFrame([("# comment",), ("",), ("   ",)], "value string"))
    path = new_path(spark, "stopwords")
    lines.write.text(path)
    return readers.stopwords(spark, path)


# -- index files ------------------------------------------------------------------------------------------------------


@query(SQL["posting_list_decode"].replace(", count(*)::INT AS tf", ""))
def inverted_block_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "block")
    writers.inverted_block(posting_lists(spark, sf_dir), path)
    return readers.inverted_block(spark, path).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query(SQL["posting_list_decode"].replace("doc_id::INT AS doc_id, count(*)::INT AS tf", "'d' || doc_id AS docid"))
def forward_block_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = index.by_document(documents(spark, sf_dir), T.numbered(T.tokens_v1(F.col("text")))).where(F.size("tokens") > 0)
    path = new_path(spark, "forward-block")
    writers.forward_block(own.select(F.concat(F.lit("d"), "doc_id").alias("docid"), index.grouped_at_once(F.col("tokens")).alias("postings")), path, "gzip")
    each = readers.forward_block(spark, path).select("docid", F.explode("postings").alias("p"))
    return each.select("p.term", "docid", F.array_join(F.col("p.positions").cast("array<string>"), ",").alias("positions"))


@query(SQL["forward_index"].replace("SELECT doc_id, count(*) AS words", "SELECT doc_id::VARCHAR AS docid, count(*) AS words"))
def forward_index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = index.numbered_documents(documents(spark, sf_dir), T.numbered(T.tokens_v1(F.col("text"))))
    path = new_path(spark, "forward")
    writers.forward_index(index.forward_of(found).withColumn("docid", F.col("docid").cast("string")), path, "gzip")
    rows = readers.forward_index(spark, path)
    pair = F.transform("postings", lambda p: F.concat(p["wordid"].cast("string"), F.lit(":"), p["freq"].cast("string")))
    total = F.aggregate("postings", F.lit(0).cast("long"), lambda a, p: a + F.size(p["positions"]))
    return rows.select("docid", F.size("postings").cast("long").alias("words"), total.alias("freq"), F.array_join(pair, " ").alias("forward"))


@query(f"SELECT *, {BARREL_SQL} AS barrel_id FROM ({SQL['posting_offsets']})")
def lexicon_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "lexicon")
    writers.lexicon(index.with_offsets(listed(spark, sf_dir)), path)
    return readers.lexicon(spark, path)


@query("SELECT source AS term, (1000000 - max(doc_id))::INT AS word_id FROM documents GROUP BY source UNION ALL SELECT 'd' || doc_id, doc_id::INT FROM documents")
def terms_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a term on more than one line the last counts, here the one with the least id."""
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", F.col("source").alias("term"), (F.lit(1_000_000) - F.col("doc_id")).alias("word_id")).union(docs.select("doc_id", F.concat(F.lit("d"), "doc_id"), "doc_id"))
    path = new_path(spark, "terms")
    writers.terms_list(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), path)  # files in the order of documents
    return readers.terms_list(spark, path)


@query(SQL["docid_map"].replace("internal_id", "doc_id"))
def docid_map_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.concat(F.lit("doc-"), "doc_id").alias("orig"), "doc_id")
    path = new_path(spark, "docids")
    writers.docid_map(index.document_map(docs, "orig", "doc_id"), path)
    return readers.docid_map(spark, path)


@query(SQL["barrel_stats"])
def barrel_metadata_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "barrels")
    writers.barrel_metadata(barrels.metadata_of_sizes(listed(spark, sf_dir)), path)
    return readers.barrel_metadata(spark, path)


@query(f"WITH o AS ({SQL['posting_offsets']}) SELECT term, \"offset\", bytes, bytes AS found FROM o")
def posting_bytes_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of all lists, in pieces of 256 ids: each list lies where the lexicon says, and is as long."""
    words = written(index.with_offsets(listed(spark, sf_dir)), "words")  # read three times
    path = new_path(spark, "postings")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    writers.postings_bytes(index.encoded_documents(docs, T.numbered(T.tokens_v1(F.col("text"))), words, bits=8), path)
    pieces = spark.read.parquet(path).groupBy("word_id").agg(F.min("offset").alias("at"), F.max(F.col("offset") + F.octet_length("content")).alias("to"), F.sum(F.octet_length("content")).alias("n"))
    sound = F.when((F.col("at") == F.col("offset")) & (F.col("to") - F.col("at") == F.col("n")), F.col("n"))
    return words.join(pieces, "word_id", "left").select("term", "offset", "bytes", sound.alias("found"))


def _byte_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, doc_id, tf, positions) of postings that went through byte files, one a barrel."""
    lists = posting_lists(spark, sf_dir)
    coded = barrels.assign(lists.select(F.concat_ws("#", "term", "block").alias("key"), "term", codec.encode_postings("postings").alias("content"))).drop("term")
    path = new_path(spark, "blobs")
    placed = writers.barrel_blobs(coded.withColumnRenamed("key", "term").withColumn("offset", F.xxhash64("term")), path)
    slices = readers.posting_slices(readers.barrel_blobs(spark, path), placed)
    back = slices.select(F.regexp_replace("term", "#[0-9]+$", "").alias("term"), F.explode(codec.decode_postings("content")).alias("p"))
    return back.select("term", "p.doc_id", "p.tf", "p.positions")


@query(SQL["posting_list_decode"])
def barrel_blob_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list through a byte file, cut out by its offset and bytes."""
    return _byte_index(spark, sf_dir).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


# -- results ----------------------------------------------------------------------------------------------------------


def _result_sql(k: int, lengths: str = LENGTHS, named: str = "documents") -> str:
    """Two terms, whose scores add up alike in either order; the operator's own limit."""
    return (
        f"WITH {LEXICON}, {lengths}, q AS (SELECT * FROM (VALUES ('the'), ('of')) v(term)), known AS (SELECT term, doc_freq FROM x JOIN q USING (term)), "
        "s AS (SELECT p.doc_id, sum(ln((n - doc_freq + 0.5::DOUBLE) / (doc_freq + 0.5::DOUBLE) + 1) * 2.5::DOUBLE * tf / (1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * coalesce(dl.dl, floor(avgdl)) / avgdl) + tf)) AS score, "
        "string_agg(p.term || '=' || tf, ' ' ORDER BY p.term) AS term_frequencies "
        "FROM p JOIN known USING (term) LEFT JOIN dl USING (doc_id) CROSS JOIN c GROUP BY p.doc_id HAVING count(*) = (SELECT count(*) FROM known)) "
        f"SELECT coalesce(m.doc_id::VARCHAR, '') AS doc_id, round(score, 6) AS score, '' AS title, '' AS snippet, term_frequencies "
        f"FROM (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT {k}) s LEFT JOIN (SELECT DISTINCT doc_id FROM {named}) m ON m.doc_id = s.doc_id"
    )


def _shown(found: DataFrame) -> DataFrame:
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("term_frequencies")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    return found.withColumns({"score": F.round("score", 6), "term_frequencies": pairs})


@query(_result_sql(25))
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as a caller sees them: original id, score, empty title and snippet, frequencies; the best 25."""
    found = whole_index(spark, sf_dir)
    return _shown(search.results(found, search.search_multi(found, "the of", 25, "actual")))


#: Lengths and names of labelled documents alone.
_LABELLED = LENGTHS.replace("FROM l), c AS (SELECT count(*) AS n, sum(dl) AS total_len, sum(dl) / count(*)::DOUBLE AS avgdl FROM dl)", "FROM l WHERE doc_id IN (SELECT doc_id FROM labels)), c AS (SELECT count(DISTINCT doc_id) AS n, (SELECT sum(dl) FROM dl) / count(DISTINCT doc_id)::DOUBLE AS avgdl FROM labels WHERE doc_id IN (SELECT doc_id FROM documents))")


@query(_result_sql(200, _LABELLED, "labels"))
def search_results_without_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only labelled documents have a length and an original id: others have the mean length, and an empty id."""
    found = whole_index(spark, sf_dir)
    some = table(spark, sf_dir, "labels").select("doc_id").distinct()
    part = index.Index(found.docs.join(some, "doc_id", "left_semi"), found.postings.drop("dl"), found.lexicon, found.doc_stats.join(some, "doc_id", "left_semi"))
    return _shown(search.results(part, search.search_multi(part, "the of", 200, "actual")))


@query(_result_sql(25))
def search_byte_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over postings cut out of byte files and decoded."""
    found = whole_index(spark, sf_dir)
    coded = index.Index(found.docs, _byte_index(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("long")), found.lexicon, found.doc_stats)
    return _shown(search.results(coded, search.search_multi(coded, "the of", 25, "actual")))


# -- indexes that grow ------------------------------------------------------------------------------------------------


def _part(docs: DataFrame) -> index.Index:
    """An index of some documents."""
    found = index.document_postings(docs, T.numbered(T.tokens_v1(F.col("text"))))
    return index.Index(docs.select("doc_id", F.col("doc_id").cast("string").alias("orig_id")), found, index.lexicon(found), index.lengths(found), derived=True)


def _postings(found: DataFrame) -> DataFrame:
    return found.select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(SQL["postings_positions"])
def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as six segments that are merged by tiers, three at a time."""
    docs = documents(spark, sf_dir)
    own = segments.Segments(spark, new_path(spark, "segments"))
    for k in range(6):
        own.add(_part(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(6)) == k)))
        own.merge(3)
    own.vacuum()
    return _postings(own.index().postings)


_CHANGED = "documents_changed AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'first version ' || text END AS text FROM documents WHERE doc_id % 5 > 0)"


@query("WITH " + _CHANGED + SQL["postings_positions"].replace("WITH ", ", ", 1).replace("FROM documents)", "FROM documents_changed)", 1))
def replaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a first version; then half of them in a second one, and a fifth deleted; merged."""
    docs = documents(spark, sf_dir)
    own = segments.Segments(spark, new_path(spark, "segments"))
    own.add(_part(docs.withColumn("text", F.concat(F.lit("first version "), "text"))))
    own.add(_part(docs.where("doc_id % 2 = 0")))
    own.add(_part(docs.where("false")), docs.where("doc_id % 5 = 0"))
    own.merge(3)
    return _postings(own.index().postings)


@query("SELECT doc_id, count(*) OVER () AS \"of\", row_number() OVER (ORDER BY n_chars < 1000, n_chars, doc_id::VARCHAR) AS number FROM documents")
def lasting_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents first, all of them then, and the first batch once more, as after a lost job: ids stay."""
    docs = documents(spark, sf_dir)
    at = new_path(spark, "ids")
    some = docs.where("n_chars >= 1000")
    before = written(segments.assign_ids(spark, at, 0, some, "doc_id", F.col("n_chars")), "ids")
    segments.assign_ids(spark, at, 0, some, "doc_id", F.col("n_chars"))
    found = segments.assign_ids(spark, at, 1, docs, "doc_id", F.col("n_chars"))
    both = found.join(before.withColumnRenamed("doc_id", "first"), "orig_id", "left").where("first IS NULL OR first = doc_id")  # one whose id changed has no row
    return both.select(F.col("orig_id").cast("long").alias("doc_id"), F.lit(docs.count()).cast("long").alias("of"), F.col("doc_id").alias("number"))


@query(SQL["lexicon_terms"])
def streamed_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a stream of files, each of them twice, in several micro-batches, kept up by term."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 1000).alias("at"))
    folder, out = new_path(spark, "stream"), new_path(spark, "updates")
    twice = docs.union(docs)
    files = 4 * pieces(twice)  # four micro-batches, each of as many files as the input has pieces
    twice.repartition(files, F.rand(3)).write.parquet(folder)
    rows = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files // 4).parquet(folder)
    ingest.keep_updates(ingest.term_counts(rows, T.tokens_v1(F.col("text")), "doc_id", "at"), out, new_path(spark, "checkpoint")).awaitTermination()
    return ingest.latest(spark, out, "term")
