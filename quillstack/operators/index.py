"""The inverted index as tables: postings, lexicon, documents, their lengths, corpus statistics, forward index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quillstack.functions.codec import encode_lists
from quillstack.functions.codec import vbyte_encode as encode
from quillstack.functions.codec import vbyte_size
from quillstack.operators import order, suggest
from quillstack.sources.shared import exists, written
from quillstack.sources.spread import pieces

BARRELS = 10
SKIP_INTERVAL = 128
#: Documents of a block.
BLOCK_DOCS = 10_000
#: Bytes of a part whose documents meet the ids of its words.
PART = 8 << 20
#: A range of ids whose greatest scores are kept has 2 to this power of them.
RANGE_BITS = 10
#: BM25.
K1, B = 1.5, 0.75


def barrel_of(term: Column, barrels: int = BARRELS) -> Column:
    """A barrel by the term's hash; the same in any engine that has md5."""
    return (F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("long") % barrels).cast("int")


def postings(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(term, doc_id, tf, positions): all fields of a document merged, positions in order, repeats kept."""
    length = [F.max("dl").alias("dl")] if "dl" in tokens.columns else []
    per = tokens.groupBy("term", id_col).agg(F.sort_array(F.collect_list("pos")).alias("positions"), *length)
    return per.select("term", id_col, F.size("positions").alias("tf"), "positions", *["dl"] * len(length))


def counts(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(term, doc_id, tf), where positions are not asked for: all of it combines before the shuffle. dl stays, if there."""
    length = [F.max("dl").alias("dl")] if "dl" in tokens.columns else []
    return tokens.groupBy("term", id_col).agg(F.count("*").cast("int").alias("tf"), *length)


def grouped(l: Column) -> Column:
    """array<struct<term, positions>>, by term, of array<struct<term, pos>>: a list's runs of equal terms, once it is sorted.

    Each ``let`` names a value, so that it is computed once for all that uses it.
    """
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    heads = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["term"] != x["term"]), i)), lambda i: i.isNotNull())
    run = lambda s, h, i, k: F.transform(F.slice(s, i + 1, F.coalesce(F.get(h, k + 1), F.size(s)) - i), lambda x: x["pos"])
    runs = lambda s, h: F.transform(h, lambda i, k: F.struct(F.get(s, i)["term"].alias("term"), run(s, h, i, k).alias("positions")))
    return let(F.sort_array(l), lambda s: let(heads(s), lambda h: runs(s, h)))


def _runs(tokens: pa.ListArray) -> pa.ListArray:
    """Lists of (term, pos) as lists of (term, positions), all lists of a batch at once."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    held = tokens.flatten()
    coded, pos = held.field("term").dictionary_encode(), held.field("pos").cast(pa.int32()).to_numpy(zero_copy_only=False)
    by = pc.array_sort_indices(coded.dictionary).to_numpy()
    n = max(1, len(by))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    key = np.repeat(np.arange(len(sizes)) * n, sizes) + rank[coded.indices.to_numpy()]
    at = np.argsort(key, kind="stable")
    if ((np.diff(pos[at]) < 0) & (np.diff(key[at]) == 0)).any():  # tokens that came in another order than that of positions
        at = np.lexsort((pos, key))
    key, pos = key[at], pos[at]
    heads = np.flatnonzero(np.diff(key, prepend=-1))
    positions = pa.ListArray.from_arrays(pa.array(np.append(heads, len(key)), pa.int32()), pa.array(pos, pa.int32()))
    terms = coded.dictionary.take(pa.array(by[key[heads] % n]))
    cuts = np.searchsorted(key[heads] // n, np.arange(len(sizes) + 1))
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([terms, positions], names=["term", "positions"]))


#: A document's terms with their positions.
GROUPED = ArrayType(StructType([StructField("term", StringType()), StructField("positions", ArrayType(IntegerType()))]))


@F.arrow_udf(GROUPED)
def grouped_at_once(tokens: pa.Array) -> pa.Array:
    """``grouped`` of a batch of lists, several times as fast; but Spark forgets how rows were dealt that pass through it."""
    return _runs(tokens)


def by_document(rows: DataFrame, tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """(id_col, tokens, dl): a row for each id, with its array<struct<term, pos>> and the length of its longest row.

    A count of the ids tells whether any is on more than one row. Where none is, nothing is shuffled.
    """
    own = rows.select(id_col, tokens.alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))
    if rows.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return own
    return own.groupBy(id_col).agg(F.flatten(F.collect_list("tokens")).alias("tokens"), F.max("dl").alias("dl"))


def document_postings(rows: DataFrame, tokens: Column, id_col: str = "doc_id", dealt: bool = False) -> DataFrame:
    """``postings``, and dl, of documents that are a row each with all their tokens: terms are grouped in their row, so
    that no token is shuffled or sorted among those of other documents. ``dealt`` says that postings are grouped next as
    ``rows`` are dealt."""
    own = grouped if dealt else grouped_at_once
    each = by_document(rows, tokens, id_col).select(id_col, "dl", F.explode(own(F.col("tokens"))).alias("p"))
    return each.select("p.term", id_col, F.size("p.positions").alias("tf"), "p.positions", "dl")


def lexicon(counted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(term, doc_freq, term_freq) of postings or counts."""
    return counted.groupBy("term").agg(F.count(id_col).cast("int").alias("doc_freq"), F.sum("tf").cast("long").alias("term_freq"))


def with_word_ids(rows: DataFrame) -> DataFrame:
    """word_id: 1 and up in the order of terms."""
    return order.numbered(rows, "term", None, "word_id")


def posting_lists(found: DataFrame, id_col: str = "doc_id", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(term, block, postings), postings by document: a list for each term and block of documents.

    A block has ``block_docs`` ids, so that the list of the most frequent term is no longer than others can be.
    """
    one = F.struct(F.col(id_col).cast("int").alias("doc_id"), "tf", "positions")
    block = F.floor(F.col(id_col).cast("long") / block_docs).alias("block")
    return found.groupBy("term", block).agg(F.sort_array(F.collect_list(one)).alias("postings"))


def parts_of(rows: DataFrame) -> int:
    """Parts of PART bytes, one for each core at least; a shuffle's partitions where the size of ``rows`` is not known."""
    session, n = rows.sparkSession, pieces(rows, PART)
    return max(session.sparkContext.defaultParallelism, n) if n < 1 << 24 else int(session.conf.get("spark.sql.shuffle.partitions"))


def dealt_by(rows: DataFrame, part: Column) -> DataFrame:
    """Documents dealt by a group of ids, to as many tasks as their bytes have parts: what is grouped by term and group
    is not shuffled again, and no task's postings grow with the input."""
    return rows.repartition(parts_of(rows), part)


def lists_of_documents(rows: DataFrame, tokens: Column, id_col: str = "doc_id", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``posting_lists`` of documents that are a row each: texts are dealt by block, and no posting is shuffled."""
    dealt = dealt_by(rows, F.floor(F.col(id_col).cast("long") / block_docs))
    return posting_lists(document_postings(dealt, tokens, id_col, True), id_col, block_docs)


def posting_bytes(tokens: DataFrame, id_col: str = "doc_id", bits: int = 20) -> DataFrame:
    """``list_bytes`` of rows of tokens."""
    return list_bytes(tokens.groupBy("term", id_col).agg(F.sort_array(F.collect_list("pos")).alias("positions")), id_col, bits)


def list_bytes(found: DataFrame, id_col: str = "doc_id", bits: int = 20) -> DataFrame:
    """(term, doc_freq, term_freq, bytes): how long each term's encoded list is, as sums of the sizes of its gaps.

    No list is encoded or gathered for it, and each posting is read once: sizes of position gaps add up in the
    posting's row, those of document gaps by term and range of 2**bits ids, and the gap into a range comes from the
    ranges before.
    """
    sizes = F.aggregate(F.transform(position_gaps(F.col("positions")), lambda x: vbyte_size(x).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    own = found.select("term", F.col(id_col).cast("long").alias("_doc"), F.size("positions").alias("tf"), (sizes + vbyte_size(F.size("positions"))).cast("int").alias("_b"))
    own = own.withColumn("_range", F.shiftright("_doc", bits))
    before = F.lag("_doc").over(Window.partitionBy("term", "_range").orderBy("_doc"))
    own = own.withColumn("_b", F.col("_b") + F.coalesce(vbyte_size(F.col("_doc") - before), F.lit(0)))
    ranged = own.groupBy("term", "_range").agg(F.count("*").alias("n"), F.sum("tf").alias("tf"), F.sum("_b").alias("_b"), F.min("_doc").alias("_first"), F.max("_doc").alias("_last"))
    into = F.col("_first") - F.lag("_last", 1, 0).over(Window.partitionBy("term").orderBy("_range"))
    sums = ranged.withColumn("_b", F.col("_b") + vbyte_size(into)).groupBy("term").agg(F.sum("n").cast("int").alias("doc_freq"), F.sum("tf").cast("long").alias("term_freq"), F.sum("_b").alias("bytes"))
    return sums.withColumn("bytes", F.col("bytes") + vbyte_size(F.col("doc_freq")))


def list_bytes_of_documents(rows: DataFrame, tokens: Column, id_col: str = "doc_id", bits: int = 11) -> DataFrame:
    """``list_bytes`` of documents that are a row each. Texts are dealt by range of ids, so that a term's documents of a
    range are met where they are: no posting is shuffled, but one row for each term and range."""
    dealt = dealt_by(rows, F.shiftright(F.col(id_col).cast("long"), bits))
    return list_bytes(document_postings(dealt, tokens, id_col, True), id_col, bits)


def lexicon_with_offsets(tokens: DataFrame, id_col: str = "doc_id", skip_interval: int = SKIP_INTERVAL) -> DataFrame:
    """``with_offsets`` of rows of tokens."""
    return with_offsets(posting_bytes(tokens, id_col), skip_interval)


def with_offsets(sizes: DataFrame, skip_interval: int = SKIP_INTERVAL) -> DataFrame:
    """The whole lexicon: ids, frequencies, where a term's encoded list begins, how long it is, and its barrel."""
    placed = order.running(sizes, "term", None, {"offset": "bytes"}, number="word_id")
    skip = F.to_json(F.struct(F.col("doc_freq").alias("df"), F.lit(skip_interval).alias("skip_interval")))
    return placed.select("word_id", "term", "doc_freq", "term_freq", "offset", "bytes", skip.alias("skip_meta"), barrel_of(F.col("term")).alias("barrel_id"))


def encoded(found: DataFrame, words: DataFrame, id_col: str = "doc_id", bits: int = 20) -> DataFrame:
    """(word_id, offset, content): the bytes of each posting list, in pieces of one range of ids each.

    Pieces by offset are the list: gaps go on over ranges, and the first piece begins with the number of documents.
    """
    each = F.concat(F.array(F.col("doc_gap").cast("long"), F.size("positions").cast("long")), position_gaps(F.col("positions")).cast("array<long>"))
    coded = gaps(found, id_col, bits).select("term", "block", F.struct(F.col(id_col).cast("long"), each.alias("numbers")).alias("p"))
    lists = coded.groupBy("term", "block").agg(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["numbers"])).alias("numbers"))
    lists = lists.select("term", "block", encode("numbers").alias("content"))  # bytes before they move
    own = Window.partitionBy("term").orderBy("block")
    lists = lists.withColumn("head", F.row_number().over(own) == 1).join(words.select("term", "word_id", "doc_freq", "offset"), "term")
    pieces = lists.withColumn("content", F.when(F.col("head"), F.concat(encode(F.array(F.col("doc_freq").cast("long"))), "content")).otherwise(F.col("content")))
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select("word_id", (F.col("offset") + F.coalesce(F.sum(F.octet_length("content")).over(before), F.lit(0))).alias("offset"), "content")


def _pieces(own: pa.Table) -> pa.Table:
    """(term, block, first, last, rest): for each term of a range's documents, its postings as bytes without what goes
    ahead of the first one's positions; all terms at once."""
    lists = own.column("tokens").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    sizes, held = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), lists.flatten()
    coded, pos = held.field("term").dictionary_encode(), held.field("pos").to_numpy(zero_copy_only=False)
    doc, code = np.repeat(own.column("id").to_numpy(), sizes), coded.indices.to_numpy()
    at = np.lexsort((pos, doc, code))
    doc, code = doc[at], code[at]
    fresh = np.diff(code, prepend=-1) != 0
    posts = np.flatnonzero(fresh | (np.diff(doc, prepend=0) != 0))  # where postings begin
    heads = np.flatnonzero(fresh[posts])  # and terms, of postings
    positions = pa.ListArray.from_arrays(pa.array(np.append(posts, len(at)), pa.int32()), pa.array(pos[at], pa.int32()))
    docs = doc[posts]
    found = pa.ListArray.from_arrays(pa.array(np.append(heads, len(posts)), pa.int32()), pa.StructArray.from_arrays([pa.array(docs), positions], names=["doc_id", "positions"]))
    last = docs[np.append(heads, len(posts))[1:] - 1]
    block = pa.array(np.full(len(heads), own.column("block")[0].as_py()), pa.int64())
    columns = [coded.dictionary.take(pa.array(code[posts][heads])), block, pa.array(docs[heads]), pa.array(last), encode_lists(found, headless=True)]
    return pa.table(columns, names=["term", "block", "first", "last", "rest"])


def encoded_documents(rows: DataFrame, tokens: Column, words: DataFrame, id_col: str = "doc_id", bits: int = 8) -> DataFrame:
    """``encoded`` of documents. Texts are dealt by range of ids, of which a group is one, and a term's postings of a
    range are bytes before they move, all but the gap into the range; they move once, by term."""
    number = F.col(id_col).cast("long")
    dealt = dealt_by(rows.where(F.col(id_col).isNotNull()), F.shiftright(number, bits))
    dealt = dealt.select(F.shiftright(number, bits).alias("block"), number.alias("id"), tokens.alias("tokens"))
    lists = dealt.groupBy("block").applyInArrow(_pieces, "term string, block long, first long, last long, rest binary").repartition("term")
    own = Window.partitionBy("term").orderBy("block")
    lists = lists.withColumns({"head": F.row_number().over(own) == 1, "gap": F.col("first") - F.lag("last", 1, 0).over(own)})
    pieces = lists.join(words.select("term", "word_id", F.col("doc_freq").cast("long").alias("doc_freq"), "offset"), "term")
    size = F.octet_length("rest") + vbyte_size(F.col("gap")) + F.when(F.col("head"), vbyte_size(F.col("doc_freq"))).otherwise(F.lit(0))
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("offset", F.col("offset") + F.coalesce(F.sum(size).over(before), F.lit(0)))  # while rows are where the exchange put them
    start = encode(F.when(F.col("head"), F.array("doc_freq", "gap")).otherwise(F.array("gap")))
    return placed.select("word_id", "offset", F.concat(start, "rest").alias("content"))


def document_map(rows: DataFrame, orig_col: str, seen_col: str) -> DataFrame:
    """(orig_id, doc_id): 1 and up in the order in which ids come first."""
    first = rows.groupBy(F.col(orig_col).cast("string").alias("orig_id")).agg(F.min(seen_col).alias("seen"))
    return order.numbered(first, "seen", order.by_number("seen"), "doc_id").select("orig_id", "doc_id")


def lengths(counted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, dl): tokens that the index holds of each document that has any."""
    return counted.groupBy(id_col).agg(F.sum("tf").cast("long").alias("dl"))


def lengths_of_forward(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, dl) of a forward index by original ids, joined to (doc_id, orig_id); ids that docs lack have no row."""
    own = rows.select(F.col("docid").cast("string").alias("orig_id"), F.aggregate("postings", F.lit(0).cast("long"), lambda a, p: a + p["freq"]).alias("dl"))
    return own.join(docs.select("doc_id", F.col("orig_id").cast("string").alias("orig_id")), "orig_id").select("doc_id", "dl")


def union(**corpora: DataFrame) -> DataFrame:
    """Several corpora's rows, each with its name; columns that some lack are null there."""
    found = None
    for name, rows in corpora.items():
        rows = rows.withColumn("corpus", F.lit(name))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


def corpus_stats(docs: DataFrame, doc_stats: DataFrame) -> DataFrame:
    """One row (n, total_len, avgdl): documents without a token count, with length 0."""
    n = docs.agg(F.count("*").alias("n"))
    total = doc_stats.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len"))
    both = n.crossJoin(F.broadcast(total))  # one row each
    return both.withColumn("avgdl", F.when(F.col("n") > 0, F.col("total_len") / F.col("n")).otherwise(F.lit(0.0)))


def with_lengths(found: DataFrame, doc_stats: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """Postings with dl, the length of their document, null where it has none; from the postings themselves without ``doc_stats``."""
    if "dl" in found.columns:
        return found
    if doc_stats is None:
        return found.withColumn("dl", F.sum("tf").over(Window.partitionBy(id_col)).cast("long"))
    return found.join(doc_stats.select(id_col, F.col("dl").cast("long").alias("dl")), id_col, "left")


def length_norm(dl: Column, avgdl: Column) -> Column:
    """A document's length against the mean, which stands in for one that is not known; 1 in a corpus without lengths."""
    return F.when(avgdl > 0, F.coalesce(dl, F.floor(avgdl)).cast("double") / avgdl).otherwise(F.lit(1.0))


def saturation(tf: Column, norm: Column, k1: float = K1, b: float = B) -> Column:
    """What a term's frequency makes of its weight in BM25."""
    return F.lit(k1 + 1) * tf / (F.lit(k1) * (F.lit(1 - b) + F.lit(b) * norm) + tf)


def posting_blocks(found: DataFrame, corpus: DataFrame, bits: int = RANGE_BITS, id_col: str = "doc_id", *more: str) -> DataFrame:
    """(term, block, docs, first_id, last_id, max_tf, top_binary, top_actual, avgdl): what a term's postings can give in
    each range of 2**bits ids, by the saturation of its frequencies, of once a document and of as often as it is there.

    Postings have dl; ``corpus`` is one row with avgdl, which the figures hold for. All of it combines before the shuffle.
    ``more`` are columns that follow from the term.
    """
    both = found.crossJoin(F.broadcast(corpus.select("avgdl")))  # one row
    norm = length_norm(F.col("dl"), F.col("avgdl"))
    block = F.shiftright(F.col(id_col).cast("long"), bits).alias("block")
    return both.groupBy(*more, "term", block).agg(
        F.count("*").cast("int").alias("docs"),
        F.min(id_col).cast("long").alias("first_id"),
        F.max(id_col).cast("long").alias("last_id"),
        F.max("tf").alias("max_tf"),
        F.max(saturation(F.lit(1.0), norm)).alias("top_binary"),
        F.max(saturation(F.col("tf").cast("double"), norm)).alias("top_actual"),
        F.max("avgdl").alias("avgdl"),
    )


def forward(found: DataFrame, words: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(docid, postings): each document's words by their ids; those of a written index have them, and join nothing."""
    one = F.struct(F.col("word_id").alias("wordid"), F.col("tf").alias("freq"), "positions")
    joined = found if "word_id" in found.columns else found.join(words.select("term", "word_id"), "term")
    return joined.groupBy(F.col(id_col).alias("docid")).agg(F.sort_array(F.collect_list(one)).alias("postings"))


def _with_ids(own: pa.Table, words: pa.Table) -> pa.Table:
    """Documents of one part, their tokens grouped by term, and these looked up among the part's words."""
    tokens = own.column("tokens").combine_chunks()
    held = _runs(tokens if isinstance(tokens, pa.ListArray) else pa.concat_arrays(tokens.chunks))
    term, positions = held.flatten().flatten()
    ids = words.column("word_id").take(pc.index_in(term, value_set=words.column("term"))).combine_chunks()
    ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
    sizes = pc.list_value_length(held).cast(pa.int64())
    ends = pc.cumulative_sum(sizes).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([ids, term, positions], names=["word_id", "term", "positions"]))
    return pa.table({n: own.column(n) for n in own.column_names if n not in ("_part", "tokens")} | {"postings": lists})


def numbered_documents(rows: DataFrame, tokens: Column, id_col: str = "doc_id", parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id_col, dl, postings) of documents with a token, postings as array<struct<word_id, term, positions>> in the order
    of words; and the lexicon (word_id, term, doc_freq, term_freq).

    Texts are dealt to parts by a hash of their id. A part's different terms meet the lexicon, a row each, and their
    ids come back to the part: no posting is shuffled.
    """
    parts = parts or parts_of(rows)
    part = F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int")
    own = by_document(rows.repartition(parts, part), tokens, id_col).where(F.size("tokens") > 0)
    own = own.select(part.alias("_part"), id_col, "dl", "tokens")
    each = own.select("_part", F.explode(grouped(F.col("tokens"))).alias("p")).select("_part", "p.term", F.size("p.positions").alias("tf"))
    terms = written(each.groupBy("_part", "term").agg(F.count("*").alias("n"), F.sum("tf").alias("tf")), "terms")
    whole = terms.groupBy("term").agg(F.sum("n").cast("int").alias("doc_freq"), F.sum("tf").cast("long").alias("term_freq"))
    words = written(with_word_ids(whole).select("word_id", "term", "doc_freq", "term_freq"), "words")
    ids = terms.select("_part", "term").join(words.select("term", "word_id"), "term")
    schema = f"{id_col} {dict(rows.dtypes)[id_col]}, dl long, postings array<struct<word_id: int, term: string, positions: array<int>>>"
    return own.groupBy("_part").cogroup(ids.groupBy("_part")).applyInArrow(_with_ids, schema), words


def forward_of(numbered: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``forward`` of ``numbered_documents``, each in its row."""
    one = lambda p: F.struct(p["word_id"].alias("wordid"), F.size(p["positions"]).alias("freq"), p["positions"].alias("positions"))
    return numbered.select(F.col(id_col).alias("docid"), F.transform("postings", one).alias("postings"))


def missing_terms(found: DataFrame, words: DataFrame) -> DataFrame:
    """Terms of postings that a lexicon does not have."""
    return found.select("term").distinct().join(words.select("term"), "term", "left_anti")


def gaps(found: DataFrame, id_col: str = "doc_id", bits: int = 20) -> DataFrame:
    """block and doc_gap: from a term's document before; the first one's is its id. ``ungapped`` is the way back.

    A window holds a term's documents of one range of ids, of 2**bits ids, so that the most frequent term is not one
    task's; where a range begins, the last document of the ranges before comes from a table of one row for each.
    """
    ranged = found.withColumn("_range", F.shiftright(F.col(id_col).cast("long"), bits))
    last = ranged.groupBy("term", "_range").agg(F.max(id_col).alias("_last"))
    ahead = last.select("term", "_range", F.lag("_last", 1, 0).over(Window.partitionBy("term").orderBy("_range")).alias("_ahead"))
    before = F.lag(id_col).over(Window.partitionBy("term", "_range").orderBy(id_col))
    return ranged.join(ahead, ["term", "_range"]).withColumn("doc_gap", F.col(id_col) - F.coalesce(before, "_ahead")).withColumnRenamed("_range", "block").drop("_ahead")


def ungapped(coded: DataFrame, by: str, name: str = "doc_id") -> DataFrame:
    """``name``: the documents of gaps that are in the order of ``by`` within their term and block.

    Blocks add up first: a window holds the gaps of one block, or a row for each of a term's blocks.
    """
    before = Window.partitionBy("term").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = coded.groupBy("term", "block").agg(F.sum("doc_gap").alias("_sum"))
    ahead = sums.select("term", "block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_ahead"))
    upto = Window.partitionBy("term", "block").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return coded.join(ahead, ["term", "block"]).withColumn("_to", F.sum("doc_gap").over(upto)).withColumn(name, F.col("_ahead") + F.col("_to")).drop("_ahead", "_to")


def gap_lists(rows: DataFrame, terms: Column, id_col: str = "doc_id", bits: int = 20) -> DataFrame:
    """(term, block, gaps): ``gaps`` of documents' terms as a list for each term and range of 2**bits ids.

    Texts are dealt by range, where a term's documents of a range are met; a list is sent once, by term, to take its
    first gap from the list before. ``documents_of_gaps`` is the way back, and needs no further exchange.
    """
    block = F.shiftright(F.col(id_col).cast("long"), bits)
    each = dealt_by(rows, block).select(id_col, F.explode(F.array_distinct(terms)).alias("term"))
    lists = each.groupBy("term", block.alias("block")).agg(F.sort_array(F.collect_set(F.col(id_col).cast("long"))).alias("docs"))
    lists = lists.withColumn("before", F.lag(F.element_at("docs", -1), 1, 0).over(Window.partitionBy("term").orderBy("block")))
    return lists.select("term", "block", F.transform("docs", lambda x, i: x - F.coalesce(F.get("docs", i - 1), F.col("before"))).alias("gaps"))


def _summed(batches: Iterable[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """(term, ``name``) of (term, ahead, gaps): sums of a batch's gaps, each list's from its own start."""
    for b in batches:
        gaps = b.column("gaps")
        sizes = pc.list_value_length(gaps).to_numpy(zero_copy_only=False)
        sums = np.cumsum(gaps.flatten().to_numpy(zero_copy_only=False))
        starts = np.append(0, sums)[np.cumsum(sizes) - sizes]  # what the batch has before a list
        docs = sums + np.repeat(b.column("ahead").to_numpy(zero_copy_only=False) - starts, sizes)
        terms = b.column("term").take(pa.array(np.repeat(np.arange(b.num_rows), sizes)))
        yield pa.RecordBatch.from_arrays([terms, pa.array(docs, pa.int64())], names=["term", name])


def documents_of_gaps(coded: DataFrame, name: str = "doc_id") -> DataFrame:
    """(term, ``name``): the documents of ``gap_lists``."""
    before = Window.partitionBy("term").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = F.aggregate("gaps", F.lit(0).cast("long"), lambda a, x: a + x)
    ahead = coded.select("term", F.coalesce(F.sum(total).over(before), F.lit(0)).alias("ahead"), "gaps")
    return ahead.mapInArrow(lambda batches: _summed(batches, name), f"term string, {name} long")


def position_gaps(positions: Column) -> Column:
    return F.transform(positions, lambda x, i: x - F.coalesce(F.get(positions, i - 1), F.lit(0)))


@dataclass
class Index:
    """Tables of one corpus. ``write`` deals postings and lexicon to barrels; a term's barrel prunes the scan.

    ``derived`` says that lexicon and lengths follow from the postings: then ``write`` takes them from the postings
    that it has written, and the texts are cut into terms once. What is written has more than what is built: postings
    have their documents' lengths, so that a search joins no table of documents, and their words' ids, if the lexicon
    has them, so that a forward index joins none of terms; corpus is its one row of statistics;
    blocks are the postings' ranges of ids with their greatest scores, and completions the best terms of each prefix.
    An index that ``write_documents`` writes has its forward index too.
    """

    docs: DataFrame
    postings: DataFrame
    lexicon: DataFrame
    doc_stats: DataFrame
    derived: bool = False
    corpus: DataFrame | None = None
    blocks: DataFrame | None = None
    completions: DataFrame | None = None
    forward: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.postings.sparkSession

    def stats(self) -> DataFrame:
        """One row: documents, terms, tokens, mean length."""
        terms = self.lexicon.agg(F.count("*").alias("terms"))
        return corpus_stats(self.docs, self.doc_stats).crossJoin(F.broadcast(terms))

    def write(self, path: str) -> None:
        found = with_lengths(self.postings, None if self.derived else self.doc_stats)
        if not self.derived and "word_id" in self.lexicon.columns and "word_id" not in found.columns:
            found = found.join(self.lexicon.select("term", "word_id"), "term")  # once, and never to read them
        self._deal(found, f"{path}/postings", "doc_id", id_range=F.shiftright(F.col("doc_id").cast("long"), RANGE_BITS))
        found = self.spark.read.parquet(f"{path}/postings")
        words, sizes = (lexicon(found), lengths(found)) if self.derived else (self.lexicon, self.doc_stats)
        self._deal(words, f"{path}/lexicon")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        sizes.write.mode("overwrite").parquet(f"{path}/doc_stats")
        self._written_corpus(path).write.mode("overwrite").parquet(f"{path}/corpus")
        corpus = self.spark.read.parquet(f"{path}/corpus")
        own = found.select("barrel_id", "term", "doc_id", "tf", "dl").repartitionByRange("barrel_id", "term", F.shiftright(F.col("doc_id").cast("long"), RANGE_BITS))
        blocks = posting_blocks(own, corpus, RANGE_BITS, "doc_id", "barrel_id")  # grouped where they are dealt to
        blocks.sortWithinPartitions("barrel_id", "term", "block").write.mode("overwrite").partitionBy("barrel_id").parquet(f"{path}/blocks")
        words = self.spark.read.parquet(f"{path}/lexicon")
        suggest.write_completions(words, f"{path}/completions", words.count())

    def _written_corpus(self, path: str) -> DataFrame:
        read = self.spark.read.parquet
        return corpus_stats(read(f"{path}/docs"), read(f"{path}/doc_stats"))

    @staticmethod
    def _deal(table: DataFrame, path: str, *more: str, **derived: Column) -> None:
        """A range of terms in each file, so that statistics of row groups prune lookups and prefixes; with ``more``,
        a very frequent term is split among files. ``derived`` columns, and barrels, are not moved but made there."""
        barrel = barrel_of(F.col("term"))
        dealt = table.drop("barrel_id").repartitionByRange(barrel, "term", *more).withColumns(derived | {"barrel_id": barrel})
        dealt.sortWithinPartitions("barrel_id", "term", *more).write.mode("overwrite").partitionBy("barrel_id").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """A written index; one of old, without the tables that only served searches read, is searched without them."""
        tables = [spark.read.parquet(f"{path}/{n}") for n in ("docs", "postings", "lexicon", "doc_stats")]
        more = [spark.read.parquet(f"{path}/{n}") if exists(spark, f"{path}/{n}") else None for n in ("corpus", "blocks", "completions", "forward")]
        return cls(*tables, False, *more)


def write_documents(rows: DataFrame, tokens: Column, path: str) -> None:
    """Writes the index of documents (doc_id and more) that are a row each. Word ids come to documents in their row,
    where the forward index is written first; postings are its terms, and are dealt once."""
    found, words = numbered_documents(rows, tokens)
    found.write.mode("overwrite").parquet(f"{path}/forward")
    held = rows.sparkSession.read.parquet(f"{path}/forward")
    each = held.select("doc_id", "dl", F.explode("postings").alias("p")).select("p.term", "doc_id", F.size("p.positions").alias("tf"), "p.positions", "dl", "p.word_id")
    docs = rows.select("doc_id", F.col("doc_id").cast("string").alias("orig_id"))
    sizes = docs.select("doc_id").join(held.select("doc_id", "dl"), "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"))
    Index(docs, each, words, sizes).write(path)


def build(tokens: DataFrame, docs: DataFrame, id_col: str = "doc_id", positions: bool = True) -> Index:
    """An index of tokens; ``docs`` has (doc_id, orig_id) of all documents, those without a token too."""
    renamed = tokens.withColumnRenamed(id_col, "doc_id")
    found = postings(renamed) if positions else counts(renamed)
    counted = counts(renamed)
    return Index(docs, found, lexicon(counted), lengths(counted), derived=True)
