"""Exact top-k search by inner product, with multi-resolution segment statistics.

A vector is cut into segments, few at the coarse level and more at each finer one. With the mean and the deviation
(the length of what remains without the mean) of two vectors' segments, the product of a segment is at most
length * mean * mean + deviation * deviation: by Cauchy and Schwarz, the lower bound of a distance. Candidates meet
queries in tiles of alike ones, which the ranges of their means and deviations bound as a whole. A candidate stays in
for a query while its bounds, the tile's and its own at each level, reach the query's k-th best score so far; what
survives all levels is computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import batched, lowest, materialize, packed, partitions, unpacked, with_rows

LEVELS = (1, 4, 16)
#: Rows of a block of queries at most, and of a tile of candidates that is bounded as a whole.
QUERY_BLOCK, TILE = 16_384, 512
#: Queries of a cell, about, where there are many.
CELL_QUERIES = 1024
#: Cells that vectors are dealt to, at most; larger ones are groups of parts.
MOST_CELLS = 1024
#: Rows of a table of cells that is broadcast, at most.
MOST_BROADCAST = 1 << 16
#: Bytes of a group's queries and of its candidates, about, and of candidates that are worth a group where cores are idle.
QUERY_BYTES, GROUP_BYTES, LEAST_BYTES = 8 << 20, 64 << 20, 16 << 20
#: Where at least this share of a tile survives, one matrix product is cheaper than a product for each query.
DENSE = 0.05
#: Integers under this many are exact in float64.
EXACT = 2.0**53
MOST = 1 << 62


def quantized(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), x as double; beyond 2**62 either way it stays there."""
    return np.clip(np.floor(scale * values.astype(np.float64)), -MOST, MOST).astype(np.int64)


def vectors(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, row, dim, q, stats) of the rows that take part; row tells apart those that share an id, q are packed integers.

    stats are the finest level's means, then its deviations.
    """
    out = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("dim", pa.int32()), ("q", pa.binary()), ("stats", pa.list_(pa.float64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, names, qs = [], [], []
            for i, name, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False)
                if np.isfinite(x).all():
                    ids.append(i)
                    names.append(name)
                    qs.append(quantized(x, scale))
            stats: list[np.ndarray] = [np.zeros(0)] * len(qs)
            for dim in {len(q) for q in qs} - {0}:
                own = [k for k, q in enumerate(qs) if len(q) == dim]
                _, mean, deviation = _segments(np.stack([qs[k] for k in own]).astype(np.float64), min(LEVELS[-1], dim))
                for k, x in zip(own, np.hstack([mean, deviation]), strict=True):
                    stats[k] = x
            columns = [pa.array(ids, pa.int64()), pa.array(names, pa.int64()), pa.array([len(q) for q in qs], pa.int32()), pa.array([packed(q) for q in qs], pa.binary()), pa.array(stats, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    thin = with_rows(table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")))
    return thin.select("id", F.xxhash64("row").alias("row"), "v").mapInArrow(run, "id long, row long, dim int, q binary, stats array<double>")


def _segments(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, means and deviations of n segments."""
    cuts = np.arange(n) * x.shape[1] // n
    length = np.diff(np.append(cuts, x.shape[1]))
    mean = np.add.reduceat(x, cuts, axis=1) / length
    rest = x - np.repeat(mean, length, axis=1)
    return length, mean, np.sqrt(np.add.reduceat(rest * rest, cuts, axis=1))


def _exact(q: np.ndarray, c: np.ndarray, wide: bool) -> np.ndarray:
    """Inner products of rows; of integers too large for float64 in whole numbers, which stop at the ends of a long."""
    if not wide:
        return q @ c.T
    found = q.astype(object) @ c.astype(object).T
    return np.clip(found, -(2**63), 2**63 - 1)


def _tiles(stats: np.ndarray) -> list[np.ndarray]:
    """Groups of rows with alike statistics, TILE of them at most: of the rows nearest to each of some rows."""
    n = len(stats)
    pivots = stats[np.random.default_rng(0).choice(n, max(1, int(n**0.5)), replace=False)]
    near = np.concatenate([(part @ pivots.T - 0.5 * (pivots * pivots).sum(1)).argmax(1) for part in np.array_split(stats, -(-n // 8192))])
    order = np.argsort(near, kind="stable")
    found, held = [], []
    for own in np.split(order, np.flatnonzero(np.diff(near[order])) + 1):
        if held and sum(map(len, held)) + len(own) > TILE:
            found.append(np.concatenate(held))
            held = []
        found += [own[x : x + TILE] for x in range(0, len(own) - TILE, TILE)]
        held.append(own[(len(own) - 1) // TILE * TILE :])
        if len(held[-1]) * 8 > TILE:  # enough for a tile of its own
            found.append(np.concatenate(held))
            held = []
    return found + ([np.concatenate(held)] if held else [])


class Search:
    """The best candidates of a block of queries, over tiles of candidates in any order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, k: int, bar: np.ndarray | None = None) -> None:
        """bar: scores that a candidate must reach, from candidates met before."""
        self.ids, self.names, self.q, self.k = ids, rows, q, k
        self.levels = sorted({min(n, q.shape[1]) for n in LEVELS}) if q.shape[1] else []
        self.f = q.astype(np.float64)
        self.longest = (self.f * self.f).sum(1).max(initial=0)
        self.stats = [_segments(self.f, n) for n in self.levels]
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, object), np.zeros(0, np.int64))] * len(ids)
        self.bar = np.full(len(ids), -np.inf) if bar is None else bar.copy()  # the k-th best score so far
        #: pairs that are left by tiles' bounds, by each level, and for exact scores; of all
        self.survived, self.met = [0] * (len(self.levels) + 2), 0

    def tile_bounds(self, m: np.ndarray, d: np.ndarray) -> np.ndarray:
        """For each query, a bound on its score with any of a tile's candidates, from the finest means and deviations."""
        length, mean, deviation = self.stats[-1]
        at = mean * length
        return np.maximum(at, 0) @ m.max(0) + np.minimum(at, 0) @ m.min(0) + deviation @ d.max(0)

    def meet(self, ids: np.ndarray, rows: np.ndarray, c: np.ndarray) -> None:
        """All candidates of a group, in tiles of alike ones: each query first meets the tile with its highest bound."""
        if not len(ids):
            return
        if not self.levels:
            self.add(ids, rows, c)
            return
        _, m, d = _segments(c.astype(np.float64), self.levels[-1])
        tiles = _tiles(np.hstack([m, d]))
        bounds = np.stack([self.tile_bounds(m[t], d[t]) for t in tiles])
        first = bounds.argmax(0)
        for early in (True, False):
            for k in np.argsort(-bounds.max(1), kind="stable").tolist():
                t = tiles[k]
                self.add(ids[t], rows[t], c[t], bounds[k], np.flatnonzero((first == k) == early))

    def add(self, ids: np.ndarray, rows: np.ndarray, c: np.ndarray, bounds: np.ndarray | None = None, who: np.ndarray | None = None) -> None:
        """Candidates meet queries ``who``, or all; bounds are what their tile lets each query reach."""
        who = np.arange(len(self.ids)) if who is None else who
        if not len(who) or not len(ids):
            return
        f = c.astype(np.float64)
        reach = np.sqrt(self.longest * (f * f).sum(1).max(initial=0))
        slack = 1e-9 * reach + 1e-6  # of rounding in the bounds
        self.met += len(who) * len(ids)
        who = who if bounds is None else who[bounds[who] >= self.bar[who] - slack]
        if not len(who):
            return
        self.survived[0] += len(who) * len(ids)
        keep = (ids[None, :] != self.ids[who, None]) | (rows[None, :] != self.names[who, None])
        for level, n in enumerate(self.levels):
            if np.isneginf(self.bar[who]).all():
                break
            length, mean, deviation = self.stats[level]
            _, m, d = _segments(f, n)
            keep &= (mean[who] * length) @ m.T + deviation[who] @ d.T >= self.bar[who, None] - slack
            self.survived[level + 1] += int(keep.sum())
            some, left = keep.any(axis=0), keep.any(axis=1)
            if not some.all() or not left.all():
                keep, ids, c, f, who = keep[left][:, some], ids[some], c[some], f[some], who[left]
            if not len(who):
                return
        wide = bool(reach >= EXACT)
        self.survived[-1] += int(keep.sum())
        if wide or keep.mean() > DENSE:
            scores = _exact(self.q[who] if wide else self.f[who], c if wide else f, wide)
            keep &= (scores >= self.bar[who, None]).astype(bool)
        else:
            scores = None
        for j in np.flatnonzero(keep.any(axis=1)).tolist():
            i, at = int(who[j]), np.flatnonzero(keep[j])
            own = f[at] @ self.f[i] if scores is None else scores[j, at]
            if len(own) > self.k and not wide:
                above = own >= np.partition(own, len(own) - self.k)[len(own) - self.k]
                at, own = at[above], own[above]
            score = np.concatenate([self.best[i][0], own.astype(object) if wide else own.astype(np.int64)])
            near = np.concatenate([self.best[i][1], ids[at]])
            first = sorted(range(len(near)), key=lambda x: (-int(score[x]), near[x]))[: self.k]
            self.best[i] = score[first], near[first]
            if len(first) == self.k:
                self.bar[i] = float(score[first[-1]]) if not wide else np.nextafter(float(score[first[-1]]), -np.inf)

    def rows(self) -> pd.DataFrame:
        found = [(int(q), int(n), int(w), int(s)) for q, n, (score, who) in zip(self.ids, self.names, self.best, strict=True) for s, w in zip(score, who, strict=True)]
        return pd.DataFrame(found, columns=["query_id", "query_row", "vec_id", "score"]).astype("int64")


def _cells(found: DataFrame, pivots: int) -> DataFrame:
    """``found`` with cell: by which of ``pivots`` vectors of its dimension, those with the least rows' hashes, is nearest.

    Only the pivots' statistics leave the table.
    """
    known: dict[int, list[tuple[int, list[float]]]] = {}
    for r in lowest(found.select("row", "dim", "stats"), "row", pivots).collect():  # MOST_CELLS rows at most
        known.setdefault(r["dim"], []).append((r["row"], r["stats"]))
    near = found.sparkSession.sparkContext.broadcast({d: np.array([x for _, x in sorted(own)]) for d, own in known.items()})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, cell = b.column(2).to_numpy(), np.zeros(b.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                own, at = np.flatnonzero(dims == dim), near.value.get(dim)
                if at is not None and at.shape[1]:
                    x = np.stack(b.column(4).take(pa.array(own)).to_numpy(zero_copy_only=False))
                    cell[own] = (x @ at.T - 0.5 * (at * at).sum(1)).argmax(1)
            yield b.append_column("cell", pa.array(cell))

    return found.mapInArrow(run, "id long, row long, dim int, q binary, stats array<double>, cell int")


def _extents(found: DataFrame) -> DataFrame:
    """(dim, cell, n, low, high, away): each cell's rows, least and greatest means and greatest deviations by segment."""
    names = ("low", "high", "away")

    def one(own: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(own["stats"].to_numpy()) if len(own["stats"].iloc[0]) else np.zeros((len(own), 0))
        n = x.shape[1] // 2
        return pd.DataFrame({"dim": [own["dim"].iloc[0]], "cell": [own["cell"].iloc[0]], "n": [len(own)], "low": [x[:, :n].min(0)], "high": [x[:, :n].max(0)], "away": [x[:, n:].max(0)]})

    def some(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield from (one(own) for _, own in part.groupby(["dim", "cell"]))

    def whole(own: pd.DataFrame) -> pd.DataFrame:
        low, high, away = (np.stack(own[c].to_numpy()) if len(own[c].iloc[0]) else np.zeros((len(own), 0)) for c in names)
        return pd.DataFrame({"dim": [own["dim"].iloc[0]], "cell": [own["cell"].iloc[0]], "n": [own["n"].sum()], "low": [low.min(0)], "high": [high.max(0)], "away": [away.max(0)]})

    kinds = "dim int, cell int, n long, low array<double>, high array<double>, away array<double>"
    return found.select("dim", "cell", "stats").mapInPandas(some, kinds).groupBy("dim", "cell").applyInPandas(whole, kinds)


def _reach(queries: DataFrame, extents: DataFrame) -> DataFrame:
    """(dim, block, cell): the other cells of which some query of a block may still get a better candidate.

    A cell's extent bounds its candidates as a whole. Cells are MOST_CELLS and one for each dimension at most.
    """
    of: dict[int, list] = {}
    for r in extents.collect():
        of.setdefault(r["dim"], []).append(r)
    known = {d: (np.array([r["cell"] for r in own]), *(np.array([r[c] for r in own], float).reshape(len(own), -1) for c in ("low", "high", "away"))) for d, own in of.items() if len(own) > 1}
    near = queries.sparkSession.sparkContext.broadcast(known)
    out = pa.schema([("dim", pa.int32()), ("block", pa.string()), ("cell", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for b in batches:
            for dim, block, own, stats, bar in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if dim not in near.value:
                    continue
                cells, low, high, away = near.value[dim]
                n = low.shape[1]
                cuts = np.arange(n) * dim // n
                length = np.diff(np.append(cuts, dim))
                mean, deviation = np.array(stats[:n]) * length, np.array(stats[n:])
                bound = np.maximum(mean, 0) @ high.T + np.minimum(mean, 0) @ low.T + deviation @ away.T
                slack = 1e-9 * np.abs(bound) + 1e-6
                found.update((dim, block, c) for c in cells[(bound >= (-np.inf if bar is None else bar) - slack) & (cells != own)].tolist())
        yield from batched(sorted(found), out)

    return queries.select("dim", "block", "cell", "stats", "bar").mapInArrow(run, "dim int, block string, cell int").distinct()


def search(table: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates by integer inner product, ties to smaller ids.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's own. Vectors that are
    null or hold null or non-finite components, and rows without an id, take no part; vectors meet those of their own
    dimension only; a query alone in its dimension has no row. Scores stop at the ends of a long. Rows that repeat an
    id are queries and candidates of their own. An empty table gives an empty result.

    Vectors are dealt to cells of alike ones. Queries first meet the candidates of their own cell, in groups of
    GROUP_BYTES, about, of any dimension; then, in blocks, those cells alone whose extents let some query of the block
    reach its k-th best score so far. A group is a block of up to QUERY_BLOCK queries and a part of a cell: a vector is
    sent once for each block that reaches its cell, packed. What leaves a group is k rows a query at most.
    """
    found = materialize(vectors(table, id_col, vector_col, scale), "vectors")
    width = 8 * F.greatest("dim", F.lit(1)).cast("long")
    most = found.groupBy("dim").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * width).alias("bytes"), F.sum("n").alias("n")).first()
    # cells whose candidates fill a group, or that have CELL_QUERIES
    pivots = max(1, -(-(most["bytes"] or 0) // GROUP_BYTES), (most["n"] or 0) // (CELL_QUERIES * every))
    found = materialize(_cells(found, min(MOST_CELLS, pivots)), "cells")
    extents = materialize(_extents(found), "extents")
    query = F.col("id") % every == 0
    per = found.where(query).groupBy("dim", "cell").agg(F.count("*").alias("queries"))
    # a row for each cell: next to the vectors, whose largest cell a shuffle by cell would bring together
    few = (lambda rows: F.broadcast(rows)) if extents.count() <= MOST_BROADCAST else (lambda rows: rows)
    # groups of GROUP_BYTES at most, and enough of them for all cores where there are fewer
    spread = F.ceil(F.col("n") * F.lit(partitions(table.sparkSession, 0, 1)) / F.lit(most["n"] or 1))
    parts_of = F.greatest(F.ceil(F.col("n") * width / GROUP_BYTES), F.least(spread, F.ceil(F.col("n") * width / LEAST_BYTES)))
    every_cell = few(extents.select("dim", "cell", parts_of.cast("int").alias("parts")))
    block_rows = F.greatest(F.lit(1), F.least(F.lit(QUERY_BLOCK), F.floor(F.lit(QUERY_BYTES) / width)))
    blocks = few(per.select("dim", "cell", F.ceil(F.col("queries") / block_rows).alias("blocks")))
    h = F.pmod(F.xxhash64("row"), F.lit(2**31))
    queries = found.where(query).join(blocks, ["dim", "cell"]).withColumn("block", F.concat_ws("/", "cell", h % F.col("blocks"))).drop("blocks")
    others = found.join(every_cell, ["dim", "cell"]).withColumn("part", (h % F.col("parts")).cast("int")).drop("parts", "stats")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in ("query_id", "query_row", "vec_id", "score")})
        matrix = lambda part: unpacked(part["q"].tolist(), int(left["dim"].iloc[0]))
        own = Search(left["id"].to_numpy(), left["row"].to_numpy(), matrix(left), k, left["bar"].to_numpy(float, na_value=-np.inf))
        own.meet(right["id"].to_numpy(), right["row"].to_numpy(), matrix(right))
        return own.rows()

    def met(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """The best of candidates of cells for the blocks that they are paired with."""
        key = ["dim", "block", "cell", "part"]
        parts = pairs.join(every_cell, ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        left = asked.select("dim", "block", "id", "row", "q", "bar").join(parts, ["dim", "block"])
        right = others.join(parts, ["dim", "cell", "part"]).select(*(F.col(c).alias(c) for c in (*key, "id", "row", "q")))  # columns of its own
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, "query_id long, query_row long, vec_id long, score long")

    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    top = lambda rows: rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    home = queries.select("dim", "block", "cell").distinct()
    first = materialize(top(met(home, queries.withColumn("bar", F.lit(None).cast("double")))), "near")
    # the score that a query's k-th best has; integers that a double can't hold are rounded down
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("query_row").alias("row"), (F.col("score").cast("double") - F.when(F.abs("score") >= F.lit(EXACT), F.lit(2048.0)).otherwise(F.lit(0.0))).alias("bar"))
    asked = queries.join(kth, ["id", "row"], "left")
    pairs = materialize(_reach(asked, extents), "pairs")
    return top(first.drop("rank").unionByName(met(pairs, asked))).select("query_id", "rank", "vec_id", "score")
