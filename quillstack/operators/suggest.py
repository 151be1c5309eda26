"""Autocomplete over a lexicon of (term, term_freq): by a range of terms, or by a table of every prefix's best terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOP = 10
#: Characters of the longest prefix of a written table, as a term of n characters has n prefixes; longer ones, which few
#: terms share, are ranges of the lexicon.
LONGEST = 32
#: Terms of a bucket of a written table, about, and its least and most buckets.
BUCKET_TERMS, LEAST_BUCKETS, MOST_BUCKETS = 250_000, 16, 8192


def suggest_with_freq(lexicon: DataFrame, prefix: str, n: int = TOP) -> DataFrame:
    """The n most frequent terms that start with the prefix, in lower case; ties by term. No prefix, no suggestion."""
    if not prefix:
        return lexicon.select("term", "term_freq").limit(0)
    found = lexicon.where(F.col("term").startswith(prefix.lower())).select("term", "term_freq")
    return found.orderBy(F.desc("term_freq"), "term").limit(n)


def suggest(lexicon: DataFrame, prefix: str, n: int = TOP) -> DataFrame:
    return suggest_with_freq(lexicon, prefix, n).select("term")


def contains(lexicon: DataFrame, term: str) -> DataFrame:
    """One row: whether the term, in lower case, is in the lexicon."""
    return lexicon.where(F.col("term") == term.lower()).limit(1).agg((F.count("*") > 0).alias("contained"))


def insert(lexicon: DataFrame, term: str, frequency: int) -> DataFrame:
    """The lexicon with a term's frequency set."""
    term = term.lower()
    added = lexicon.sparkSession.createDataFrame([(term, frequency)], "term string, term_freq long")
    return lexicon.select("term", "term_freq").where(F.col("term") != term).unionByName(added)


def prefixes(lexicon: DataFrame) -> DataFrame:
    """(prefix) of every term, once each: the nodes of a trie below its root."""
    lengths = F.sequence(F.lit(1), F.char_length("term"))
    return lexicon.where(F.char_length("term") > 0).select(F.explode(F.transform(lengths, lambda n: F.substring(F.col("term"), F.lit(1), n))).alias("prefix")).distinct()


def memory(lexicon: DataFrame, node_bytes: int = 64) -> DataFrame:
    """One row (nodes, term_bytes, bytes): what a trie of the lexicon would take."""
    nodes = prefixes(lexicon).agg((F.count("*") + 1).alias("nodes"))
    own = lexicon.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("term_bytes"))
    return nodes.crossJoin(F.broadcast(own)).withColumn("bytes", F.col("nodes") * node_bytes + F.col("term_bytes"))


def completions(lexicon: DataFrame, n: int = TOP, longest: int | None = None) -> DataFrame:
    """(prefix, suggestions): the n most frequent terms of each prefix, ties by term; of prefixes up to ``longest``, or all.

    Each task keeps n terms of a prefix before they are shuffled, so that a prefix that all terms share is n rows a task.
    """
    chars = F.char_length("term")
    ends = F.sequence(F.lit(1), chars if longest is None else F.least(chars, F.lit(longest)))
    each = lexicon.where(chars > 0).select("term", "term_freq", F.explode(ends).alias("_n"))
    each = each.select(F.substring(F.col("term"), F.lit(1), F.col("_n")).alias("prefix"), "term", "term_freq")
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("term_freq"), "term"))
    best = each.withColumn("rank", rank).where(F.col("rank") <= n)
    listed = F.array_sort(F.collect_list(F.struct("rank", "term", "term_freq")))  # n at most
    return best.groupBy("prefix").agg(F.transform(listed, lambda x: F.struct(x["term"].alias("term"), x["term_freq"].alias("term_freq"))).alias("suggestions"))


def _bucket(prefix: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(prefix), buckets.cast("long")).cast("int")


def write_completions(lexicon: DataFrame, path: str, terms: int, longest: int = LONGEST) -> None:
    """The table of completions, so that a prefix is one folder, one file and, in the order of prefixes, one row group.

    ``terms`` are those of the lexicon; a bucket is for about BUCKET_TERMS of them.
    """
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, terms // BUCKET_TERMS))
    rows = completions(lexicon, TOP, longest).withColumn("bucket", _bucket(F.col("prefix"), F.lit(buckets)))
    rows = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "prefix")
    rows.write.mode("overwrite").option("parquet.block.size", 1 << 20).partitionBy("bucket").parquet(f"{path}/buckets={buckets}")


def load_completions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def complete(table: DataFrame, lexicon: DataFrame, prefix: str, n: int = TOP) -> DataFrame:
    """What ``suggest_with_freq`` gives, from a written table of completions where it has the prefix and as many terms."""
    prefix = prefix.lower()
    if not prefix or n > TOP or len(prefix) > LONGEST:
        return suggest_with_freq(lexicon, prefix, n)
    # one row: its terms come in their order
    row = table.where((F.col("bucket") == _bucket(F.lit(prefix), F.col("buckets"))) & (F.col("prefix") == prefix))
    return row.select(F.inline(F.slice("suggestions", 1, n)))
