"""BM25 search over an index: one term, all terms, or terms with synonyms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.operators import snippets
from quillstack.operators.index import K1, RANGE_BITS, B, Index, barrel_of, corpus_stats, length_norm, saturation
from quillstack.sources.shared import written

TOP = 10
#: Ranges of ids that a bounded search reads first, and that a scan is given as a list at most.
FIRST_BLOCKS, MOST_LISTED = 8, 1024
RESULT = "doc_id string, score double, title string, snippet string, term_frequencies map<string,int>"


def tokenize(query: str) -> list[str]:
    """A query's words as ``functions.text.query_tokens`` cuts them; a query is on the driver anyway."""
    return re.findall("[a-z0-9']+", query.lower())


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def bm25(n: Column, df: Column, tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """Doubles throughout, so that no count wraps; a document without a length has the mean, a corpus without lengths norm 1."""
    return idf(n.cast("double"), df.cast("double")) * saturation(tf, length_norm(dl, avgdl), k1, b)


def _lookup(table: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Rows of some terms; where the table is dealt to barrels, of their barrels alone."""
    found = table.where(F.col("term").isin(list(terms)))
    if "barrel_id" in table.columns:
        row = table.sparkSession.range(1).select(F.array(*(barrel_of(F.lit(t)) for t in terms)).alias("b")).first()
        found = found.where(F.col("barrel_id").isin(sorted(set(row["b"]))))
    return found


def score(index: Index, terms: Sequence[str], mode: str = "and", tf_mode: str = "binary", k: int | None = TOP) -> DataFrame:
    """(doc_id, score, term_frequencies), best first, ties by id.

    Terms that no document has are ignored, terms that repeat score again. With mode and, a document must have every
    term that any document has; with or, one of them. tf_mode binary counts a term of a document once.
    """
    if mode not in ("and", "or") or tf_mode not in ("binary", "actual"):
        raise ValueError("mode is and or or, tf_mode binary or actual")
    times = Counter(terms)
    if not times:
        return index.spark.createDataFrame([], "doc_id long, score double, term_frequencies map<string,int>")
    known = _lookup(index.lexicon, list(times)).select("term", "doc_freq")  # a row for each of the query's terms at most
    stats = _corpus(index).crossJoin(F.broadcast(known.agg(F.count("*").alias("known"))))  # one row each
    length = ["dl"] if "dl" in index.postings.columns else []
    found = _lookup(index.postings, list(times)).select("doc_id", "term", "tf", *length).join(F.broadcast(known), "term")
    # a row for each document, and those that lack a term gone, before lengths are joined; a written index has them
    per = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term", "tf", "doc_freq"))).alias("parts"), *(F.max(c).alias(c) for c in length))
    per = per.crossJoin(F.broadcast(stats))  # one row
    if mode == "and":
        per = per.where(F.size("parts") == F.col("known"))
    if not length:
        per = per.join(index.doc_stats, "doc_id", "left")

    def part(x: Column) -> Column:
        weight = F.coalesce(*(F.when(x["term"] == t, F.lit(n)) for t, n in times.items()))
        tf = F.lit(1.0) if tf_mode == "binary" else x["tf"].cast("double")
        return weight * bm25(F.col("n"), x["doc_freq"], tf, F.col("dl"), F.col("avgdl"))

    total = F.aggregate(F.transform("parts", part), F.lit(0.0), lambda a, b: a + b)
    frequencies = F.map_from_entries(F.transform("parts", lambda x: F.struct(x["term"], x["tf"])))
    per = per.select("doc_id", total.alias("score"), frequencies.alias("term_frequencies"))
    best = per.orderBy(F.desc("score"), "doc_id")
    return best if k is None else best.limit(k)


def _corpus(index: Index) -> DataFrame:
    return corpus_stats(index.docs, index.doc_stats) if index.corpus is None else index.corpus


def bounded(index: Index, terms: Sequence[str], mode: str = "and", tf_mode: str = "binary", k: int = TOP, bits: int = RANGE_BITS, report: dict[str, int] | None = None) -> DataFrame:
    """What ``score`` gives, without reading the postings of ranges of ids that cannot have one of the k best.

    The index has blocks, of ranges of 2**bits ids. A range's terms bound the score of its documents. A few ranges with
    the highest bounds are scored first; the k-th best score there rules out the ranges whose bound is under it, and
    goes on to do so, over eight times as many each time, until none is left or a third reading takes all that are.
    Ranges go to the scan as a list, so that files, row groups and pages without one are not read; where over
    MOST_LISTED are left they are joined. ``report`` gets how many ranges the terms have, and how many were read.
    """
    times = Counter(terms)
    known = {r["term"]: r["doc_freq"] for r in _lookup(index.lexicon, list(times)).select("term", "doc_freq").collect()} if times else {}  # the query's terms at most
    if not known or index.blocks is None:
        return score(index, terms, mode, tf_mode, k)
    stats = _corpus(index).first()
    n, avgdl = F.lit(float(stats["n"])), F.lit(float(stats["avgdl"]))
    weight = F.coalesce(*(F.when(F.col("term") == t, F.lit(times[t]) * F.greatest(F.lit(0.0), idf(n, F.lit(float(df))))) for t, df in known.items()))
    # of another mean length than the blocks were written with, what no length can exceed
    least = saturation(F.lit(1.0) if tf_mode == "binary" else F.col("max_tf").cast("double"), F.lit(0.0))
    top = F.when(F.col("avgdl") == avgdl, F.col("top_binary" if tf_mode == "binary" else "top_actual")).otherwise(least)
    own = _lookup(index.blocks, list(known)).select("block", (weight * top).alias("bound"))
    ranges = own.groupBy("block").agg(F.sum("bound").alias("bound"), F.count("*").alias("has"))
    if mode == "and":
        ranges = ranges.where(F.col("has") == len(known))
    ranges = written(ranges.select("block", "bound"), "ranges")
    block = F.col("id_range") if "id_range" in index.postings.columns else F.shiftright(F.col("doc_id").cast("long"), bits)
    left, found, bar, take = ranges, None, None, FIRST_BLOCKS
    total, read = ranges.count(), 0
    for last in (False, False, True) if total > 2 * FIRST_BLOCKS else (True,):  # few ranges are read at once
        some = [r["block"] for r in left.orderBy(F.desc("bound"), "block").limit(MOST_LISTED + 1 if last else take).collect()]
        if not some:
            break
        if not last or len(some) <= MOST_LISTED:
            postings = index.postings.where(block.isin(some))
            read += len(some)
        else:
            chosen = left.select(F.col("block").alias("_block"))
            postings = index.postings.join(chosen, block == F.col("_block"), "left_semi")
            read += left.count()
        best = score(replace(index, postings=postings), terms, mode, tf_mode, k)
        best = best if found is None else found.unionByName(best).orderBy(F.desc("score"), "doc_id").limit(k)
        if last:
            found = best
            break
        found = written(best, "best")  # k rows
        bar = found.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        left = left.where(~F.col("block").isin(some))
        if bar["n"] >= k:  # equal scores are told apart by ids: they stay
            left = left.where(F.col("bound") * (1 + 1e-9) >= F.lit(bar["least"]))
        take *= 8
    if report is not None:
        report.update(ranges=total, read=read)
    if found is None:
        return score(index, terms, mode, tf_mode, k).limit(0)
    return found.orderBy(F.desc("score"), "doc_id").limit(k)


def results(index: Index, scored: DataFrame, texts: DataFrame | None = None, words: Sequence[str] = ()) -> DataFrame:
    """With the ids that documents came with; empty where there is none. Titles and snippets stay empty without ``texts``,
    rows of (doc_id, title, text): with them, the snippet is the passage of the text that has most of the words.
    """
    docs = index.docs.select("doc_id", F.col("orig_id").cast("string").alias("orig_id"))
    named = scored.join(docs, "doc_id", "left")
    title, snippet = F.lit(""), F.lit("")
    if texts is not None:
        own = texts.join(scored.select("doc_id"), "doc_id", "left_semi")
        named = named.join(own.select("doc_id", "title"), "doc_id", "left").join(snippets.snippets(own, words).select("doc_id", "snippet"), "doc_id", "left")
        title, snippet = F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))
    return named.select(F.coalesce("orig_id", F.lit("")).alias("doc_id"), "score", title.alias("title"), snippet.alias("snippet"), "term_frequencies").orderBy(F.desc("score"), "doc_id")


def search_single(index: Index, query: str, k: int = TOP, tf_mode: str = "binary") -> DataFrame:
    """By the query's first word."""
    return score(index, tokenize(query)[:1], "and", tf_mode, k)


def search_multi(index: Index, query: str, k: int = TOP, tf_mode: str = "binary", stemmed: bool = False) -> DataFrame:
    """By all words. ``stemmed`` puts them through the stemmer, as an index of stems asks for."""
    words = tokenize(query)
    if stemmed:
        from quillstack.functions.stem import stem

        words = [stem(w) for w in words]
    return score(index, words, "and", tf_mode, k)


def expand(words: Sequence[str], synonyms: DataFrame, limit: int = 2) -> list[str]:
    """The words, then ``limit`` synonyms of each at most, by rank; (term, synonym, rank) rows."""
    rows = synonyms.where(F.col("term").isin(list(words)) & (F.col("rank") <= limit)).collect()  # limit rows a word
    of = {w: [r["synonym"] for r in sorted(rows, key=lambda r: (r["rank"], r["synonym"])) if r["term"] == w] for w in words}
    return [*words, *(s for w in dict.fromkeys(words) for s in of[w][:limit])]


def search_semantic(index: Index, query: str, synonyms: DataFrame | None = None, k: int = TOP, mode: str = "and", tf_mode: str = "binary") -> DataFrame:
    """By the words and their synonyms: all of them (which narrows a search), or with mode or, any."""
    words = tokenize(query)
    if synonyms is not None:
        words = tokenize(" ".join(expand(words, synonyms)))
    return score(index, words, mode, tf_mode, k)


def intersect(index: Index, terms: Sequence[str]) -> DataFrame:
    """Documents that have every one of the terms that any has."""
    known = _lookup(index.lexicon, list(terms)).agg(F.count("*").alias("known"))
    has = _lookup(index.postings, list(terms)).groupBy("doc_id").agg(F.count_distinct("term").alias("has"))
    return has.crossJoin(F.broadcast(known)).where(F.col("has") == F.col("known")).select("doc_id")
