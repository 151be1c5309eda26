"""Barrels: terms dealt to a fixed number of parts by a hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.operators.index import BARRELS, barrel_of
from quillstack.sources.shared import written


def assign(terms: DataFrame, barrels: int = BARRELS) -> DataFrame:
    return terms.withColumn("barrel_id", barrel_of(F.col("term"), barrels))


def metadata(lexicon: DataFrame) -> DataFrame:
    """(barrel_id, start_term, end_term, offset, size, term_count) of a lexicon with bytes and offsets."""
    return lexicon.groupBy("barrel_id").agg(
        F.min("term").alias("start_term"), F.max("term").alias("end_term"), F.min("offset").alias("offset"), F.sum("bytes").alias("size"), F.count("*").cast("int").alias("term_count")
    )


def metadata_of_sizes(sizes: DataFrame, barrels: int = BARRELS) -> DataFrame:
    """The same of (term, bytes) alone, where offsets are not known yet: a barrel begins where the lists of all lesser
    terms end, which is one more sum over the sizes, for each of the few barrels."""
    sizes = written(assign(sizes.select("term", F.col("bytes").cast("long").alias("bytes")), barrels), "sizes")
    own = sizes.groupBy("barrel_id").agg(F.min("term").alias("start_term"), F.max("term").alias("end_term"), F.sum("bytes").alias("size"), F.count("*").cast("int").alias("term_count"))
    starts = {r["barrel_id"]: r["start_term"] for r in own.collect()}  # a row for each barrel
    if not starts:
        return own.select("barrel_id", "start_term", "end_term", F.lit(0).cast("long").alias("offset"), "size", "term_count")
    before = sizes.agg(F.array(*(F.struct(F.lit(b).alias("of"), F.coalesce(F.sum(F.when(F.col("term") < t, F.col("bytes"))), F.lit(0)).alias("offset")) for b, t in starts.items())).alias("o"))
    before = before.select(F.inline("o"))
    return own.join(F.broadcast(before), F.col("barrel_id") == F.col("of")).select("barrel_id", "start_term", "end_term", "offset", "size", "term_count")


def needed_by(tokens: DataFrame, id_col: str, barrels: int = BARRELS) -> DataFrame:
    """(id_col, barrel_id): the barrels that the terms of each text are in, to be loaded before they are looked up."""
    return assign(tokens.select(id_col, "term"), barrels).select(id_col, "barrel_id").distinct()


def needed(terms: DataFrame, barrels: int = BARRELS) -> DataFrame:
    """The barrels that some terms are in."""
    return assign(terms, barrels).select("barrel_id").distinct()


def load(postings: DataFrame, barrel_ids: Sequence[int]) -> DataFrame:
    """The postings of some barrels: the scan reads their folders alone."""
    return postings.where(F.col("barrel_id").isin(list(barrel_ids)))


def memory_usage(lexicon: DataFrame, barrel_ids: Sequence[int] | None = None) -> DataFrame:
    """One row: the bytes of the posting lists of some barrels, or of all."""
    found = lexicon if barrel_ids is None else lexicon.where(F.col("barrel_id").isin(list(barrel_ids)))
    return found.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def resident(accesses: DataFrame, most: int = 3) -> DataFrame:
    """(barrel_id, at) of the barrels that a cache of ``most`` keeps, last used first; from (barrel_id, at) accesses."""
    return accesses.groupBy("barrel_id").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "barrel_id").limit(most)
