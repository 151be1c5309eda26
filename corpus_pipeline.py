"""From documents to packed sequences: quality, near-duplicates, mixing, packing; each stage is written and reread."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import importance, mixing, packing, simhash
from quillstack.llm.common import new_path, with_rows
from quillstack.llm.queries import tokenizer_files

_WORD = re.compile(mixing.WORD)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells its rows apart, under a name that it does not have yet, nor with spans after it."""
    name, taken = "row", {c.lower() for c in docs.columns}
    while {name, f"{name}spans"} & taken:
        name += "_"
    return with_rows(docs, name), name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones keeps; the others go.

    Texts without a token (null, empty, blank) go; repeated rows stay or go together, as do ties with the last row
    kept; a null id can stay. Texts of any length are weighed whole. Without labels all weights are equal, and what
    has a text stays. An empty table stays one. Columns stay as they are, whatever their names.
    """
    named, row = _numbered(docs)
    kept = importance.resample(named, spark.read.parquet(f"{sf_dir}/labels.parquet"), row_col=row)
    return named.join(kept.select(F.col("row").alias(row)), row, "left_semi").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: the one with the smallest id, nulls last.

    Of rows that share the smallest id one stays, by its place. Texts without a word (null, empty, blank) are one
    group. Texts of any length have a whole fingerprint. An empty table stays one. Columns stay as they are.
    """
    named, row = _numbered(docs)
    placed = simhash.near_duplicates(named, row_col=row)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    kept = placed.groupBy("component_root").agg(first).select(F.col("first.row").alias(row))
    return named.join(kept, row, "left_semi").select(*docs.columns)


def _cut(text: str, spans: list[dict]) -> list[str]:
    """For each time that words of a text are taken, the text of those words; breaks between spans are new lines."""
    at = [m.span() for m in _WORD.finditer(text)]
    if len(spans) == 1 and (spans[0]["from"], spans[0]["to"]) == (0, len(at)):
        return [text] * spans[0]["times"]
    return ["\n".join(text[at[s["from"]][0] : at[s["to"] - 1][1]] for s in spans if s["times"] > k) for k in range(max(s["times"] for s in spans))]


def _taken(names: list[str], spans: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with a column of spans to a row for each time that words are taken, a few rows at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                texts = [_cut(t, s) for t, s in zip(part.column("text").to_pylist(), part.column(spans).to_pylist(), strict=True)]
                rest = part.select([n for n in names if n != "text"]).take(pa.array([k for k, own in enumerate(texts) for _ in own], pa.int64()))
                text = pa.array([t for own in texts for t in own], part.column("text").type)
                yield pa.RecordBatch.from_arrays([text if n == "text" else rest.column(n) for n in names], names=names)

    return run


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that Sainte-Laguë mixing takes: a row for each time that words of a document are taken.

    A document that is taken whole keeps its text; of one that is cut, the taken spans are lines. n_chars, if there,
    is the new text's. Texts without a word (null, empty, blank) have nothing to take and go; null ids and sources
    stay null; repeated rows are taken each. An empty table stays one. Other columns stay as they are.
    """
    named, row = _numbered(docs)
    taken = mixing.mix(named, row_col=row).where(F.size("spans") > 0).select(F.col("row").alias(row), F.col("spans").alias(f"{row}spans"))
    parts = named.join(taken, row).select(*docs.columns, f"{row}spans").mapInArrow(_taken(docs.columns, f"{row}spans"), docs.schema)
    if "n_chars" in docs.columns:
        parts = parts.withColumn("n_chars", F.char_length("text").cast("long"))
    return parts.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 1024 tokens.

    A null text is an empty one, the end token alone; repeated rows and ids are packed each, a null id stays null; a
    text of any length is cut into full pieces, the first of which may be shorter. An empty table gives no rows.
    """
    return packing.pack(docs, **tokenizer_files())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier (7)", quality),
    ("SimHash near-dedup (5)", near_dedup),
    ("mixing to target weights (9)", mix),
    ("best-fit packing (10)", pack),
]

#: SQL has no SimHash, hashed models, seeded choices or tokenizers: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
