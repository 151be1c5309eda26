"""Queries over records that the papers of ``catalog`` have no case of: listed files, fallbacks, originals, odd terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack import schemas
from quillstack.operators import analyze, extract
from quillstack.plans.catalog import _CONTROLS, _FIELD_SQL, _NORMAL, _V2, documents, query, table
from quillstack.sources import readers, writers
from quillstack.sources.shared import new_path


@query("SELECT 'I' || item_id AS paper_id, split_part(text, chr(10), 1) AS title FROM benchmark")
def paper_listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of files that a caller lists by their names, here those of a folder's."""
    items = table(spark, sf_dir, "benchmark")
    value = F.to_json(F.struct(F.concat(F.lit("I"), "item_id").alias("paper_id"), F.struct(F.split_part("text", F.lit("\n"), F.lit(1)).alias("title")).alias("metadata")))
    path = new_path(spark, "listed")
    items.select("item_id", value.alias("value")).write.partitionBy("item_id").text(path)
    names = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(path).select("path").collect()]  # one for each item
    return readers.sound(readers.papers(spark, names, "*.txt")).select("paper_id", F.col("metadata.title").alias("title"))


#: A line's section, by its number.
_SECTIONS = ("Abstract", "Introduction", "ABSTRACT", "abstract", "Abstracts", "")


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers whose abstract is blank but for every fourth, and whose DOI is among other ids or cited ones."""
    doc = F.col("doc_id")
    names = F.array(*map(F.lit, _SECTIONS))
    body = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.get(names, i % len(_SECTIONS)).alias("section"), x.alias("text")))
    abstract = F.when(doc % 4 == 0, F.concat(F.lit("["), F.to_json(F.struct(F.concat(F.lit("own "), "lang").alias("text"))), F.lit("]"))).when(doc % 4 == 1, F.lit('[{"text":"  "}," "]')).when(doc % 4 == 2, "[]")
    other = F.when(doc % 3 == 0, F.concat(F.lit('{"DOI":["10.3/'), doc, F.lit('","10.4/x"]}'))).when(doc % 3 == 1, '{"DOI":[]}').otherwise('{"PMID":["7"]}')
    bib = F.when(doc % 2 == 0, F.concat(F.lit('{"B0":{"other_ids":{}},"B1":{"other_ids":{"DOI":["10.5/'), doc, F.lit('"]}}}'))).otherwise("{}")
    raw = F.concat(F.lit('{"paper_id":"P'), doc, F.lit('","metadata":{"doi":'), F.when(doc % 7 == 0, F.concat(F.lit('"10.2/'), doc, F.lit('"'))).otherwise('""'), F.lit(',"other_ids":'), other, F.lit('},"bib_entries":'), bib, F.lit(',"body_text":'), F.to_json(body), F.lit("}"))
    parsed = documents(spark, sf_dir).select("doc_id", F.from_json(raw, schemas.PAPER).alias("p"), abstract.alias("abstract"))
    return parsed.select("doc_id", "p.*", F.col("abstract").alias("own"), F.lit("f.json").alias("orig_file")).drop("abstract").withColumnRenamed("own", "abstract")


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_papers(spark, sf_dir)).withColumn("doc_id", F.regexp_extract("paper_id", r"(\d+)", 1).cast("long"))


@query(
    "WITH e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), "
    f"g AS (SELECT doc_id, {_NORMAL.format('string_agg(s, chr(32) ORDER BY i)')} AS s FROM e WHERE i % 6 IN (0, 2, 3) AND s <> '' GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'own ' || lang ELSE coalesce(s, '') END AS abstract FROM documents LEFT JOIN g USING (doc_id)"
)
def abstract_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank abstract is the body's texts of sections of its name, in three spellings."""
    return _extracted(spark, sf_dir).select("doc_id", "abstract")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '10.2/' || doc_id WHEN doc_id % 3 = 0 THEN '10.3/' || doc_id WHEN doc_id % 2 = 0 THEN '10.5/' || doc_id ELSE 'P' || doc_id END AS doi_or_id FROM documents")
def doi_of_other_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paper's own DOI, else the first of its other ids, else a cited one, else its id."""
    return _extracted(spark, sf_dir).select("doc_id", "doi_or_id")


@query(f"{_FIELD_SQL} SELECT doc_id::VARCHAR AS paper_id, field, pos, term FROM t WHERE field_idx = 1")
def body_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines without sections, whose body is one string: it is their one section."""
    path = new_path(spark, "jsonl")
    documents(spark, sf_dir).select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("paper_id"), F.col("text").alias("body"))).alias("value")).write.text(path)
    found = readers.extracted_jsonl(spark, path)
    return analyze.clean(found, analyze.CleanOptions(fields=("sections",), stopwords=None)).select("paper_id", "field", "pos", "term")


_PLAIN = _CONTROLS.format("translate(text, chr(10) || chr(9), chr(32) || chr(32))")
_ORIGINALS = _V2.replace("regexp_replace(s,", f"regexp_replace({_PLAIN},")


@query(f"WITH l AS (SELECT doc_id, {_ORIGINALS} AS l FROM documents), t AS (SELECT doc_id, unnest(l) AS orig, generate_subscripts(l, 1)::INT AS pos FROM l) SELECT doc_id, pos, lower(orig) AS term, orig FROM t")
def kept_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with the form that they have in the text."""
    rows = documents(spark, sf_dir).select("doc_id", F.col("text").alias("title"))
    found = analyze.clean(rows, analyze.CleanOptions(fields=("title",), stopwords=None, keep_original=True), "doc_id")
    return found.select("doc_id", "pos", "term", "orig")


@query("SELECT p_partkey::BIGINT AS word_id, translate(p_name, ' ', '  ') AS term, 1 AS doc_freq, p_size::BIGINT AS term_freq FROM part")
def scrubbed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that hold tabs and line ends, in a lexicon's lines and back: they are blanks there."""
    odd = F.translate(F.col("p_name"), " ", "\t")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("word_id"), odd.alias("term"), F.lit(1).alias("doc_freq"), F.col("p_size").cast("long").alias("term_freq"), F.lit(0).cast("long").alias("offset"), F.lit(1).cast("long").alias("bytes"), F.lit("{}").alias("skip_meta"), F.lit(0).alias("barrel_id"))
    path = new_path(spark, "lexicon")
    writers.lexicon(rows, path)
    found = readers.lexicon(spark, path, 4)
    return found.select(F.col("word_id").cast("long").alias("word_id"), "term", "doc_freq", "term_freq")
