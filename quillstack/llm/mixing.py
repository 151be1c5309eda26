"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import batched, materialize, named, rows, with_rows
from quillstack.operators.order import numbered, running

WORD = r"[^\x20\x09-\x0D]+"
#: Words and rows of a shard, about, whose thin rows are one task's group; and shards whose quotas one task gives.
SHARD_WORDS, SHARD_ROWS, SHARDS = 1 << 20, 1 << 17, 4096
#: Blocks of a target, about, at least: of a small one they have half the words, a quarter and so on, down to one.
LEAST_BLOCKS = 100
#: Sources that the driver plans for; of more, executors make the same plan.
MOST_SOURCES = 100_000
#: Rows of one source, id and size that one task counts, about. It changes no result.
MOST_EQUAL = 4096
#: Ranges of quotients in which seats are counted, and sources that one task counts. They change no result.
QUOTIENT_RANGES, TIED_SOURCES_BITS = 1 << 16, 12


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: Sequence[int], weights: Sequence[int], cap: int) -> list[Fraction]:
    """The sum of sizes, shared by weight; no target is above cap times its size, the excess is reshared by weight."""
    found: list[Fraction] = [Fraction(0)] * len(sizes)
    open_, rest = [i for i, s in enumerate(sizes) if s], sum(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] > cap * sizes[i] * weight]
        if not over:
            for i in open_:
                found[i] = Fraction(rest * weights[i], weight)
            break
        for i in over:
            found[i] = Fraction(cap * sizes[i])
            rest -= cap * sizes[i]
        stopped = set(over)
        open_ = [i for i in open_ if i not in stopped]
    return found


def sainte_lague(shares: Sequence[Fraction | int], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients share / (2 s + 1), ties to the earlier; none gets over ``most``.

    Equal to giving out one seat after another; it starts near the end, so that it takes a step per share.
    """
    most = [seats] * len(shares) if most is None else most
    total = sum(shares)
    seats = min(seats, sum(m for m, x in zip(most, shares, strict=True) if x))
    if not total or seats <= 0:
        return [0] * len(shares)
    found = [min(m, max(0, (2 * x * seats + total) // (2 * total) - 1)) for x, m in zip(shares, most, strict=True)]
    found = [int(x) for x in found]
    last = lambda i: Fraction(shares[i], 2 * found[i] - 1) if found[i] else None
    high = [(-Fraction(x, 2 * s + 1), i) for i, (x, s) in enumerate(zip(shares, found, strict=True)) if x and s < most[i]]
    heapq.heapify(high)
    given = sum(found)
    while given < seats:
        _, i = heapq.heappop(high)
        found[i] += 1
        given += 1
        if found[i] < most[i]:
            heapq.heappush(high, (-Fraction(shares[i], 2 * found[i] + 1), i))
    while high:  # a seat that a lower quotient holds goes to the higher one
        i = min((i for i, s in enumerate(found) if s), key=lambda i: (last(i), -i))
        q, j = high[0]
        if not (-q > last(i) or (-q == last(i) and j < i)) or i == j:
            break
        heapq.heappop(high)
        found[i] -= 1
        found[j] += 1
        if found[j] < most[j]:
            heapq.heappush(high, (-Fraction(shares[j], 2 * found[j] + 1), j))
        heapq.heappush(high, (-Fraction(shares[i], 2 * found[i] + 1), i))
        high = [(q, k) for q, k in high if -q == Fraction(shares[k], 2 * found[k] + 1)]
        heapq.heapify(high)
    return found


def _shard_rows(seed: int):  # noqa: ANN202
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "id", "size", "row"], kind="stable", na_position="last")
        number, shard, quota, block_words = (int(group[c].iloc[0]) for c in ("number", "shard", "given", "block_words"))
        size = group["size"].to_numpy(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1])
        blocks = count_blocks(total, block_words)
        bounds = np.arange(blocks + 1, dtype=np.int64) * total // max(blocks, 1)
        times = np.full(max(blocks, 1), quota // max(blocks, 1), dtype=np.int64)
        pick = np.random.Generator(np.random.PCG64([seed, number, shard])).permutation(max(blocks, 1))
        times[pick[: quota % max(blocks, 1)]] += 1
        ahead = np.append(0, np.cumsum(np.diff(bounds) * times[:blocks]))
        block = lambda x: np.clip(np.searchsorted(bounds, x, side="right") - 1, 0, max(blocks - 1, 0))
        upto = lambda x: ahead[b := block(x)] + (x - bounds[b]) * times[b]
        starts = ends - size
        first, last = block(starts), block(np.maximum(ends - 1, starts))
        spans = []
        for s, e, a, b in zip(starts.tolist(), ends.tolist(), first.tolist(), last.tolist(), strict=True):
            own: list[list[int]] = []
            for k in range(a, b + 1) if e > s else ():
                lo, hi, n = max(s, int(bounds[k])) - s, min(e, int(bounds[k + 1])) - s, int(times[k])
                if own and own[-1][2] == n:
                    own[-1][1] = hi
                elif n:
                    own.append([lo, hi, n])
                else:
                    own.append([lo, hi, 0])
            spans.append([{"from": x, "to": y, "times": n} for x, y, n in own if n])
        return pd.DataFrame({"id": group["id"], "size": size, "source_size": group["source_size"], "target": group["target"], "taken": upto(ends) - upto(starts) if blocks else 0 * size, "spans": spans, "row": group["row"]})

    return run


def count_blocks(total: int, block_words: int) -> int:
    return max(1, round(total / block_words)) if total else 0


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, most_block_words: int = 64, blocks_a_source: int = 1000, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """(id_col, size, source_size, target, taken, spans, row) for every row.

    Sources in code point order, null last, weigh ``weights``, repeated, and share all words; a target stops at
    ``cap`` times its source's size. Blocks have ``most_block_words`` words, or fewer in a small corpus, so that a
    source has about ``blocks_a_source`` of them; sources whose target has few of those have blocks of half the words,
    of a quarter and so on. Among the sources of each size of block, Sainte-Laguë gives its blocks by highest
    quotients, then each source's to its shards (by way of groups of shards, where there are over SHARDS). A seeded
    choice takes the quota's blocks of the shard's words, each of which is taken ``cap`` times at most. spans are the
    taken word ranges of a row with the times they are taken.

    A null text has size 0 and takes nothing; an empty string source is a source of its own; repeated rows count
    each; null ids stay null; a corpus without words has targets 0; an empty table gives an empty result. Rows are
    dealt to shards by id, size and how many rows of that source, id and size are before them, so that a rerun on
    another copy of the table gives the same, however many rows or sources there are.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), named(row_col).alias("row"))
    thin = materialize(with_rows(thin, "place"), "sizes")
    sums = materialize(thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows")), "sources")
    total, sources = sums.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    block_words = max(1, min(most_block_words, total // max(1, blocks_a_source * sources)))
    known = materialize((_planned if sources <= MOST_SOURCES else _levelled)(sums, weights, cap, block_words), "targets")

    order = F.xxhash64(F.lit(seed), "id", "size", "nth")
    dealt = _counted(thin).select("id", "source", "size", "row", order.alias("order")).join(known.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("source_rows") / SHARD_ROWS))
    dealt = dealt.withColumn("shard", F.pmod("order", shards).cast("int"))
    dealt = materialize(dealt.select("id", "size", "row", "order", "number", "shard", F.ceil(shards / SHARDS).cast("int").alias("groups"), "source_size", "target", "quota", "block_words"), "dealt")
    plan = materialize(_quotas(dealt, cap), "quotas")
    kinds = "id long, size long, source_size long, target double, taken long, spans array<struct<from: int, to: int, times: int>>, row string"
    taken = dealt.join(plan, ["number", "shard"]).groupBy("number", "shard").applyInPandas(_shard_rows(seed), kinds)
    return taken.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "spans", "row")


def _quotas(dealt: DataFrame, cap: int) -> DataFrame:
    """(number, shard, given): each source's quota of blocks, shared among groups of its shards, then among their shards.

    A source has as many groups as SHARDS of its shards make, one in most corpora; none gets over ``cap`` times its blocks.
    """

    def shares(key: str):  # noqa: ANN202
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(key)
            return group[[*(c for c in ("number", "group", "shard") if c in group)]].assign(given=sainte_lague(group["size"].tolist(), int(group["quota"].iloc[0]), group["most"].tolist()))

        return run

    parts = dealt.groupBy("number", (F.col("shard") % F.col("groups")).alias("group"), "shard", "quota", "block_words").agg(F.sum("size").alias("size"))
    blocks = F.when(F.col("size") > 0, F.greatest(F.lit(1.0), F.rint(F.col("size") / F.col("block_words")))).otherwise(0.0)  # count_blocks
    parts = materialize(parts.withColumn("most", (cap * blocks).cast("long")), "shards")
    wide = parts.groupBy("number", "group", "quota").agg(F.sum("size").alias("size"), F.sum("most").alias("most"))
    given = wide.groupBy("number").applyInPandas(shares("group"), "number long, group int, given long")
    given = given.select(F.col("number").alias("of"), F.col("group").alias("_group"), "given")
    inner = parts.drop("quota").join(given, (F.col("number") == F.col("of")) & (F.col("group") == F.col("_group"))).withColumnRenamed("given", "quota")
    return inner.select("number", "group", "shard", "quota", "size", "most").groupBy("number", "group").applyInPandas(shares("shard"), "number long, group int, shard int, given long").drop("group")


def _counted(thin: DataFrame) -> DataFrame:
    """``thin`` with ``nth``: from 0 up for the rows of one source, id and size, in parts of MOST_EQUAL rows or so."""
    same = ["source", "id", "size"]
    like = lambda table: [F.col(c).eqNullSafe(table[f"_{c}"]) for c in same]
    repeated = thin.groupBy(*(F.col(c).alias(f"_{c}") for c in same)).agg(F.count("*").alias("copies")).where("copies > 1")
    marked = thin.join(repeated, like(repeated), "left").withColumn("part", F.pmod(F.xxhash64("place"), F.ceil(F.col("copies") / MOST_EQUAL)))
    marked = materialize(marked.select(*thin.columns, "part"), "marked")
    own = marked.where("part is not null")
    parts = own.groupBy(*(F.col(c).alias(f"_{c}") for c in same), F.col("part").alias("_part")).count()
    before = Window.partitionBy(*(f"_{c}" for c in same)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(*same, "part").orderBy("place"))
    own = own.withColumn("within", within).join(parts, [*like(parts), F.col("part") == F.col("_part")])
    alone = marked.where("part is null").select(*thin.columns, F.lit(0).cast("long").alias("nth"))
    return alone.union(own.select(*thin.columns, (F.col("ahead") + F.col("within") - 1).cast("long")))


def _own_words(size: int, target: Fraction, block_words: int) -> int:
    """Words of a source's blocks: ``block_words``, or half of it, a quarter and so on, where the target is small."""
    own = block_words
    while own > 1 and own * LEAST_BLOCKS > min(size, target):
        own //= 2
    return own


_PLAN = "source string, source_size long, source_rows long, number long, target double, quota long, block_words int"


def _planned(sums: DataFrame, weights: Sequence[int], cap: int, block_words: int) -> DataFrame:
    """(source, source_size, source_rows, number, target, quota, block_words) of every source: quotas by Sainte-Laguë.

    Sources of one size of block share as many blocks as their targets together have.
    """
    found = sorted(((r["source"], r["source_size"], r["source_rows"]) for r in sums.collect()), key=lambda x: (x[0] is None, x[0] or ""))  # MOST_SOURCES rows at most
    sizes = [s for _, s, _ in found]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(found))], cap)
    each = [_own_words(s, t, block_words) for s, t in zip(sizes, targets, strict=True)]
    quotas = [0] * len(found)
    for own in set(each):
        level = [i for i, x in enumerate(each) if x == own]
        for i, quota in zip(level, sainte_lague([targets[i] for i in level], round(sum(targets[i] for i in level) / own)), strict=True):
            quotas[i] = quota
    plan = [(n, s, r, k, float(t), q, own) for k, ((n, s, r), t, q, own) in enumerate(zip(found, targets, quotas, each, strict=True))]
    return sums.sparkSession.createDataFrame(plan, _PLAN)


def _levelled(sums: DataFrame, weights: Sequence[int], cap: int, block_words: int) -> DataFrame:
    """The same of any number of sources, of which only sums reach the driver."""
    numbered_ = numbered(sums.withColumn("key", F.struct(F.col("source").isNull(), "source")), "key", None, "number")
    rows_ = numbered_.select("source", "source_size", "source_rows", (F.col("number") - 1).cast("long").alias("number"))
    rows_ = materialize(rows_.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("long")), "weights")
    whole = "decimal(38,0)"
    open_ = rows_.where("source_size > 0")
    rest, weight = open_.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    total, all_weight = rest, weight
    over = lambda r, w: F.lit(r).cast(whole) * F.col("weight") > F.lit(cap).cast(whole) * F.col("source_size") * F.lit(w).cast("decimal(19,0)")
    while True:  # the level rises with each source that stops at its cap
        stopped, gone = open_.where(over(rest, weight)).agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first() if weight else (0, 0)
        if (total - cap * stopped, all_weight - gone) == (rest, weight):
            break
        rest, weight = total - cap * stopped, all_weight - gone
    scale = weight or 1
    schema = pa.schema([("source", pa.string()), ("source_size", pa.int64()), ("source_rows", pa.int64()), ("number", pa.int64()), ("target", pa.float64()), ("quota", pa.int64()), ("block_words", pa.int32()), ("units", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for source, size, n, number, own in rows(batches, "source", "source_size", "source_rows", "number", "weight"):
                target = Fraction(0) if not size else Fraction(cap * size) if not weight or rest * own > cap * size * weight else Fraction(rest * own, weight)
                yield source, size, n, number, float(target), 0, _own_words(size, target, block_words), str(int(target * scale))

        yield from batched(each(), schema)

    plan = materialize(rows_.mapInArrow(run, f"{_PLAN}, units string"), "levelled")
    seats = None
    for own, units in plan.where("units <> '0'").groupBy("block_words").agg(F.sum(F.col("units").cast(whole))).collect():  # a row for each size of block
        level = _seats(plan.where((F.col("block_words") == own) & (F.col("units") != "0")).select("number", "units"), int(units), round(Fraction(int(units), scale * own)))
        seats = level if seats is None else seats.union(level)
    if seats is None:
        return plan.drop("units")
    found = plan.join(seats.withColumnRenamed("number", "_number"), F.col("number") == F.col("_number"), "left")
    return found.withColumn("quota", F.coalesce("seats", "quota")).select("source", "source_size", "source_rows", "number", "target", "quota", "block_words")


def _seats(shares: DataFrame, total: int, seats: int) -> DataFrame:
    """(number, seats): ``sainte_lague`` of shares (number, units over 0), whose sum is ``total``, ties to the lesser number.

    Of n shares, quotients of at least total / (2 seats - n) belong to no more seats than there are, those of at least
    total / (2 seats + n) to enough; in between lie 2 n at most, of which the highest have the seats that are left.
    """
    n = shares.count()
    least, most = max(0, 2 * seats - n), 2 * seats + n
    given = lambda units, m: (units * m + total) // (2 * total)
    sure_schema = pa.schema([("number", pa.int64()), ("seats", pa.int64())])
    schema = pa.schema([("number", pa.int64()), ("range", pa.int64()), ("key", pa.binary())])

    def sure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(((number, given(int(units), least)) for number, units in rows(batches, "number", "units")), sure_schema)

    def open_(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for number, units in rows(batches, "number", "units"):
                x = int(units)
                for odd in range(2 * given(x, least) + 1, 2 * given(x, most), 2):
                    # quotients of divisors under 2**63 differ by over 2**-126; the higher comes first
                    key = (1 << 256) - 1 - (x << 128) // odd
                    yield number, (odd * total - least * x) * QUOTIENT_RANGES // (x * (most - least)), key.to_bytes(32, "big")

        yield from batched(each(), schema)

    sure_ = materialize(shares.mapInArrow(sure, "number long, seats long"), "seats_sure")
    left = seats - sure_.agg(F.sum("seats")).first()[0]
    if not left:
        return sure_
    open_seats = materialize(shares.mapInArrow(open_, "number long, range long, key binary"), "seats_open")
    upto = running(open_seats.groupBy("range", "key").agg(F.count("*").alias("n")), "key", F.col("range"), {"before": "n"})
    last = upto.where(F.col("before") < left).agg(F.max(F.struct("key", "before"))).first()[0]
    key = F.lit(bytearray(last["key"]))
    ties = running(open_seats.where(F.col("key") == key).select("number", F.lit(1).cast("long").alias("one")), "number", F.shiftright("number", TIED_SOURCES_BITS), {"before": "one"})
    number = ties.where(F.col("before") < left - last["before"]).agg(F.max("number")).first()[0]
    more = open_seats.where((F.col("key") < key) | ((F.col("key") == key) & (F.col("number") <= number))).select("number", F.lit(1).cast("long"))
    return sure_.union(more).groupBy("number").agg(F.sum("seats").alias("seats"))
