"""Words of alike use, from a corpus: contexts weighed by positive pointwise mutual information, compared by cosine."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.operators import order
from quillstack.sources.shared import written

#: Tokens to either side that are a token's context.
NEAR = 2
#: Times that a pair is seen at least, contexts of a term, and terms of a context: more say little of any.
LEAST, MOST_CONTEXTS, MOST_TERMS = 2, 20, 1000
#: Entries of two blocks of terms that meet, and products that are summed at a time.
BLOCK, MOST_PAIRS = 4_000_000, 2_000_000
_MICRO = 1_000_000


def pairs(tokens: DataFrame, near: int = NEAR, id_col: str = "doc_id") -> DataFrame:
    """(term, context, n): how often another token is within ``near`` of one. Tokens that follow each other meet by
    windows over a text, and counts combine before the shuffle. Texts that are a list each need no window: ``unordered``."""
    order = Window.partitionBy(id_col).orderBy("pos")
    after = tokens.select("term", F.array_compact(F.array(*(F.lead("term", k).over(order) for k in range(1, near + 1)))).alias("l"))
    each = after.select("term", F.explode("l").alias("context"))
    both = each.select(F.explode(F.array(F.struct("term", "context"), F.struct(F.col("context").alias("term"), F.col("term").alias("context")))).alias("p"))
    return both.groupBy("p.term", "p.context").agg(F.count("*").alias("n"))


def unordered(lists: DataFrame, near: int = NEAR, least: int = LEAST) -> DataFrame:
    """(a, b, n), a not after b: how often one token is the other's context, ``least`` times at least, in the lists of
    tokens ``l``. Neighbours meet in their own row; a pair is counted one way, as both ways are as often. Two tokens of
    one term are each other's context, so that counts twice."""
    after = F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, near), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))))
    each = lists.select(F.explode(F.flatten(after)).alias("p"))
    counted = each.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    return counted.withColumn("n", F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n"))).where(F.col("n") >= least)


def neighbours(lists: DataFrame, near: int = NEAR) -> DataFrame:
    """(term, of): how many tokens are within ``near`` of a term's tokens, which is what its pairs add up to."""
    last = F.size("l") - 1
    own = F.transform("l", lambda x, i: F.struct(x.alias("term"), (F.least(i, F.lit(near)) + F.least(last - i, F.lit(near))).alias("of")))
    return lists.select(F.explode(own).alias("t")).groupBy("t.term").agg(F.sum("t.of").alias("of")).where("of > 0")


def weights(counted: DataFrame, least: int = LEAST, contexts: int = MOST_CONTEXTS, sums: DataFrame | None = None) -> DataFrame:
    """(term, context, weight): positive pointwise mutual information in millionths, of each term's strongest contexts.

    ``sums`` are (term, of) of all pairs, where ``counted`` lacks those that are seen less often.
    """
    if sums is None:
        sums = counted.groupBy("term").agg(F.sum("n").alias("of"))
    total = sums.agg(F.sum("of").alias("total"))
    seen = counted.where(F.col("n") >= least).join(sums.select(F.col("term").alias("context"), F.col("of").alias("with")), "context").join(sums, "term")
    mutual = F.log(F.col("n").cast("double") * F.col("total") / (F.col("of").cast("double") * F.col("with")))
    seen = seen.crossJoin(F.broadcast(total)).select("term", "context", F.round(mutual * _MICRO).cast("long").alias("weight")).where("weight > 0")  # one row
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("weight"), "context"))
    return seen.withColumn("r", rank).where(F.col("r") <= contexts).drop("r")


def _best(of: np.ndarray, other: np.ndarray, likeness: np.ndarray, k: int) -> np.ndarray:
    """Places of each ``of``'s k greatest likenesses, ties by the order of rows, which is that of ``other``."""
    order = np.argsort(of << 21 | 2 * _MICRO - likeness, kind="stable")  # a likeness is a million, about, at most
    first = np.flatnonzero(np.diff(of[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    return order[rank < k]


def _entries(held: pa.ChunkedArray, context: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, weight, norm, context) of all entries of lists, the context's place for each."""
    lists = held.combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    columns = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
    return *columns, np.repeat(context, pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def _likest(own: pa.Table, k: int) -> pa.Table:
    """(id, other, likeness): the k nearest that each term of two blocks has in the other one, or in its own.

    Dots of a term are summed over the contexts that it shares, MOST_PAIRS products at a time or a term's.
    """
    place = np.arange(own.num_rows)
    x, wx, nx, cx = _entries(own.column("a"), place)
    y, wy, ny, cy = _entries(own.column("b"), place)
    within = len(y) == 0  # a block with itself
    if within:
        y, wy, ny, cy = x, wx, nx, cx
    ids, y = np.unique(y, return_inverse=True)
    norms = np.zeros(len(ids))
    norms[y] = ny
    begin = np.searchsorted(cy, place)  # rows come in their order, so a context's entries follow each other
    count = np.searchsorted(cy, place, side="right") - begin
    by = np.argsort(x, kind="stable")
    x, wx, nx, cx = x[by], wx[by], nx[by], cx[by]
    sizes = count[cx]
    heads = np.flatnonzero(np.diff(x, prepend=-1))  # where a term's entries begin
    upto = np.append(0, np.cumsum(sizes))
    ends = np.append(heads[1:], len(x))
    found, held, least = [], [], np.full(len(ids), -1, np.int64)

    def keep(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        of, other, likeness = (np.concatenate(c) for c in zip(*rows, strict=True))
        best = _best(of, other, likeness, k)
        kth = best[k - 1 :][of[best[k - 1 :]] == of[best[: max(0, len(best) - k + 1)]]]
        least[of[kth]] = likeness[kth]
        return of[best], other[best], likeness[best]

    at = 0
    while at < len(heads):
        to = max(at + 1, int(np.searchsorted(upto[ends], upto[heads[at]] + MOST_PAIRS, side="right")))
        one = np.arange(heads[at], ends[to - 1])
        at, n = to, sizes[one]
        left = np.repeat(one, n)
        right = np.repeat(begin[cx[one]] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(len(left))
        if within:  # each pair once
            other = x[left] < ids[y[right]]
            left, right = left[other], right[other]
        if not len(left):
            continue
        pair = x[left].astype(np.int64) * len(ids) + y[right]
        order = np.argsort(pair, kind="stable")
        pair, left, right = pair[order], left[order], right[order]
        heads_ = np.flatnonzero(np.diff(pair, prepend=-1))
        dot = np.add.reduceat(wx[left] * wy[right], heads_)
        left, of = left[heads_], y[right[heads_]]
        exact = dot / np.sqrt(nx[left] * norms[of]) * _MICRO
        likeness = np.floor(exact).astype(np.int64)
        likeness += exact - likeness >= 0.5
        best = _best(x[left].astype(np.int64), of, likeness, k)
        found.append((x[left[best]], ids[of[best]], likeness[best]))
        more = likeness > least[of]  # terms come in their order, so that a later one of the same likeness is none
        held.append((of[more], x[left[more]].astype(np.int64), likeness[more]))
        held = [keep(held)]
    for of, other, likeness in held:
        found.append((ids[of], other, likeness))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
    if within and found:  # what a term has before it and after it
        order = np.lexsort((columns[1], columns[0]))
        columns = [c[order] for c in columns]
        best = _best(columns[0].astype(np.int64), columns[1], columns[2], k)
        columns = [c[best] for c in columns]
    return pa.table({"id": pa.array(columns[0], pa.int32()), "other": pa.array(columns[1], pa.int32()), "likeness": pa.array(columns[2], pa.int64())})


def _blocks(rows: int, cores: int) -> int:
    """Into how many blocks terms are dealt, of so many entries: no more than BLOCK of them in a pair of blocks, and pairs
    of blocks for all cores where there is work for them."""
    return max(-(-2 * rows // BLOCK), min(1 + rows // 50_000, 1 + math.isqrt(4 * cores)))


def nearest(weighed: DataFrame, k: int = 2, most_terms: int = MOST_TERMS, blocks: int | None = None) -> DataFrame:
    """(term, synonym, rank, likeness): each term's ``k`` nearest by cosine, in millionths, ties by term.

    Terms meet where they share a context; contexts of over ``most_terms`` terms tell none apart and bring none
    together, so a context makes no more pairs than that for each of its terms. Weights are whole numbers, so sums are exact.

    Terms are dealt to blocks. Each pair of blocks is a group, which has the contexts that both are in, a list for each:
    an entry is sent to as many groups as there are blocks, however many terms it meets, and no pair of terms is sent
    but the ``k`` best of a group for each of its terms.
    """
    spark = weighed.sparkSession
    weighed = written(weighed, "weights")
    often = weighed.groupBy("context").agg(F.count("*").alias("n")).where(F.col("n").between(2, most_terms))
    blocks = blocks or _blocks(often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], spark.sparkContext.defaultParallelism)
    norms = weighed.groupBy("term").agg(F.sum(F.col("weight").cast("double") * F.col("weight")).alias("norm"))
    words = written(order.numbered(norms, "term", None, "id"), "words")
    shared = weighed.join(often.select("context"), "context").join(words, "term")
    entry = F.struct("id", "weight", "norm")
    lists = shared.select("context", F.pmod("id", F.lit(blocks)).alias("block"), entry.alias("e")).repartition("context")
    lists = lists.groupBy("context", "block").agg(F.collect_list("e").alias("l"))  # most_terms at most
    lists = lists.groupBy("context").agg(F.collect_list(F.struct("block", "l")).alias("of"))
    group = lambda i, j: F.struct((i["block"] * blocks + j["block"]).alias("group"), i["l"].alias("a"), F.when(i["block"] < j["block"], j["l"]).otherwise(F.slice(j["l"], 1, 0)).alias("b"))
    met = F.transform("of", lambda i: F.transform(F.filter("of", lambda j: (i["block"] < j["block"]) | ((i["block"] == j["block"]) & (F.size(i["l"]) > 1))), lambda j: group(i, j)))
    likest = lambda own: _likest(own, k)
    groups = lists.select(F.inline(F.flatten(met))).repartition(2 * blocks * (blocks + 1), "group")  # four times as many as there are, so that few share a task
    best = groups.groupBy("group").applyInArrow(likest, "id int, other int, likeness long")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("likeness"), "other"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= k)
    named = best.join(words.select("id", "term"), "id").join(words.select(F.col("id").alias("other"), F.col("term").alias("synonym")), "other")
    return named.select("term", "synonym", "rank", "likeness")


def synonyms(tokens: DataFrame, k: int = 2, near: int = NEAR, id_col: str = "doc_id") -> DataFrame:
    """(term, synonym, rank, likeness) of all terms of a corpus that share a context; ``search_semantic`` takes it as it is."""
    return nearest(weights(written(pairs(tokens, near, id_col), "pairs")), k)


def synonyms_of(lists: DataFrame, k: int = 2, near: int = NEAR) -> DataFrame:
    """The same of texts that are a list of tokens ``l`` each: only pairs that are seen ``LEAST`` times are written."""
    sums = written(neighbours(lists, near), "neighbours")
    once = written(unordered(lists, near), "pairs")
    one = F.struct(F.col("a").alias("term"), F.col("b").alias("context"), "n")
    other = F.struct(F.col("b").alias("term"), F.col("a").alias("context"), "n")
    counted = once.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(one, other))))
    return nearest(weights(counted, sums=sums), k)
