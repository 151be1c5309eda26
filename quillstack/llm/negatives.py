"""Hard-negative mining, with an orthogonal PCA rotation that lets most pairs go early.

Vectors are rotated to the principal axes of all of them. Inner products stay the same, and the leading components
hold most of each: the product so far, plus and minus the product of the norms of what is left, bounds the whole.
Slack for rounding is added, so no pair that belongs is lost; what survives all levels is computed from the integers.

An anchor's positives come first. Their scores then tell which scores a negative can have: an interval for each
positive, whose lower end rises as better ones are found. A pair goes once its bounds miss all intervals.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import materialize, packed, partitions, unpacked, with_rows
from quillstack.llm.topk import EXACT, quantized

#: Shares of the leading components after which pairs are discarded.
LEVELS = (0.125, 0.25, 0.5, 0.75)
#: Bytes of a group's anchors and of its candidates, as doubles.
ANCHOR_BYTES, GROUP_BYTES = 16 << 20, 64 << 20
#: Rows of anchors and of candidates that are multiplied at once.
ANCHOR_TILE, TILE = 1024, 4096
#: Dimensions, the most frequent ones, that are rotated, and components of such vectors, at most: rotations are
#: broadcast. Others are compared in the components that they have.
MOST_ROTATED, MOST_COMPONENTS = 8, 1024
#: One of so many parts is met first, and tells which scores a negative needs in the others. It changes no result.
EARLY = 16
#: Survivors that wait to be ranked.
PENDING = 1 << 20


def vectors(table: DataFrame, scale: float, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, row, label, dim, q) of the rows that take part; q are the packed integers floor(scale * x), x as double."""
    out = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("q", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, dims, qs = [], [], []
            for k, v in enumerate(b.column(3)):
                if not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False)
                if np.isfinite(x).all():
                    kept.append(k)
                    dims.append(len(x))
                    qs.append(packed(quantized(x, scale)))
            rest = b.select([0, 1, 2]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(dims, pa.int32()), pa.array(qs, pa.binary())], schema=out)

    thin = with_rows(table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v")))
    thin = thin.where("id IS NOT NULL AND label IS NOT NULL").select("id", F.xxhash64("row").alias("row"), "label", "v")
    return thin.mapInArrow(run, "id long, row long, label long, dim int, q binary")


def rotations(found: DataFrame) -> dict[int, np.ndarray]:
    """For each of the MOST_ROTATED most frequent dimensions the principal axes of its vectors, as columns.

    They are those of the sums of all products of two components, which each task adds up before they are shuffled, a
    row of the matrix in each group. Any orthogonal axes give right results; these let pairs go early.
    """
    often = found.where((F.col("dim") > 1) & (F.col("dim") <= MOST_COMPONENTS)).groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MOST_ROTATED)
    dims = [r["dim"] for r in often.collect()]  # MOST_ROTATED rows at most
    schema = pa.schema([("dim", pa.int32()), ("at", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {d: np.zeros((d, d)) for d in dims}
        for b in batches:
            own = b.column(0).to_numpy()
            for d in dims:
                at = np.flatnonzero(own == d)
                if len(at):
                    x = unpacked(b.column(1).take(pa.array(at)).to_pylist(), d).astype(np.float64)
                    x /= max(1.0, np.abs(x).max(initial=0) / 1e100)  # squares stay finite
                    sums[d] += x.T @ x
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(list(s), schema.field("sums").type)], schema=schema)

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [group["dim"].iloc[0]], "at": [group["at"].iloc[0]], "sums": [np.sum(np.stack(group["sums"].to_numpy()), axis=0)]})

    kinds = "dim int, at int, sums array<double>"
    each = found.where(F.col("dim").isin(dims)).select("dim", "q").mapInArrow(run, kinds).groupBy("dim", "at").applyInPandas(whole, kinds).collect() if dims else []
    axes = {}
    for d in dims:
        sums = np.stack([r["sums"] for r in sorted((r for r in each if r["dim"] == d), key=lambda r: r["at"])])  # dim rows
        axes[d] = np.linalg.eigh(sums)[1][:, ::-1] if np.isfinite(sums).all() else np.eye(d)
    return axes


class Rotated:
    """Some vectors of one dimension: their integers, their rotated components, the norms of what is left at each level."""

    def __init__(self, rows: list[bytes], dim: int, axes: np.ndarray | None) -> None:
        self.q = unpacked(rows, dim)
        f = self.q.astype(np.float64)
        self.f = f
        self.r = f if axes is None or not dim else f @ axes
        self.norm = np.sqrt((f * f).sum(1))
        self.cuts = sorted({min(dim, max(1, int(dim * x))) for x in LEVELS} - {dim}) if dim else []
        self.rest = [np.sqrt((self.r[:, c:] ** 2).sum(1)) for c in self.cuts]
        self.dim = dim

    def exact(self, own: np.ndarray, other: Rotated, at: np.ndarray) -> np.ndarray:
        """Integer products of pairs; where doubles may not hold them, in whole numbers that stop at the ends of a long."""
        if not self.dim:
            return np.zeros(len(own), np.int64)
        if float(self.norm.max(initial=0)) * float(other.norm.max(initial=0)) < EXACT / 4:
            return np.einsum("ij,ij->i", self.f[own], other.f[at]).astype(np.int64)
        found = (self.q[own].astype(object) * other.q[at].astype(object)).sum(axis=1)
        return np.clip(found, -(2**63), 2**63 - 1).astype(np.int64)


def survivors(left: Rotated, who: np.ndarray, right: Rotated, which: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``left`` and ``right`` whose product may be from ``low`` to ``high``, a row of ``left`` each.

    With each level the leading components' products are added, and rows and columns that no pair is left of go.
    """
    part = np.zeros((len(who), len(which)))
    keep = np.ones(part.shape, bool)
    begin = 0
    for level, cut in enumerate((*left.cuts, left.dim)):
        part += left.r[who, begin:cut] @ right.r[which, begin:cut].T
        begin = cut
        slack = 1e-9 * left.norm[who][:, None] * right.norm[which] + 1e-6
        if level < len(left.cuts):
            slack += left.rest[level][who][:, None] * right.rest[level][which]
        keep &= (part + slack >= low[who][:, None]) & (part - slack <= high[who][:, None])
        some, any_ = keep.any(axis=0), keep.any(axis=1)
        if not some.all() or not any_.all():
            keep, part, who, which = keep[any_][:, some], part[any_][:, some], who[any_], which[some]
        if not len(who):
            return who, which[:0]
    i, j = np.nonzero(keep)
    return who[i], which[j]


class Best:
    """For each anchor and each of its intervals of scores, the ``k`` highest scores within, ties to smaller ids."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        """low and high: a row for each anchor, a column for each interval; no interval where low is over high."""
        self.lows, self.highs, self.k = low, high, k
        self.bar = low.astype(np.float64)
        empty = np.zeros(0, np.int64)
        self.found = [(empty, empty, empty)] * low.shape[1]
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def window(self) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that an anchor still has a use for; doubles that leave room for rounding."""
        sound = self.lows <= self.highs
        low = np.where(sound, self.bar, np.inf).min(axis=1, initial=np.inf)
        high = np.where(sound, self.highs.astype(np.float64), -np.inf).max(axis=1, initial=-np.inf)
        wide = lambda x: np.where(np.isfinite(x), np.abs(x) * 1e-15, 0)
        return low - wide(low), high + wide(high)

    def add(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.pending.append((who, ids, scores))
        self.waiting += len(who)
        if self.waiting >= PENDING:
            self.settle()

    def settle(self) -> None:
        if not self.pending:
            return
        new = [np.concatenate(c) for c in zip(*self.pending, strict=True)]
        self.pending, self.waiting = [], 0
        for i in range(self.lows.shape[1]):
            fits = (new[2] >= self.lows[new[0], i]) & (new[2] <= self.highs[new[0], i])
            who, ids, scores = (np.concatenate([a, b[fits]]) for a, b in zip(self.found[i], new, strict=True))
            order = np.lexsort((ids, -scores, who))
            who, ids, scores = who[order], ids[order], scores[order]
            first = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
            rank = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
            self.found[i] = who[rank < self.k], ids[rank < self.k], scores[rank < self.k]
            full = rank == self.k - 1
            self.bar[who[full], i] = scores[full]

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        self.settle()
        for i, found in enumerate(self.found):
            yield i, *found


def _lowest(score: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """The least whole number n with share[0] * score <= share[1] * n, in whole numbers."""
    a, b = share
    small = np.abs(score) < (1 << 62) // a
    found = -((-a * np.where(small, score, 0)) // b)
    if not small.all():
        found[~small] = [-((-a * s) // b) for s in score[~small].tolist()]
    return found


def _blocks(rows_: DataFrame, per: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows_`` with ``name``: a number under the one that ``per`` has for their keys, by a hash of the row."""
    return rows_.join(per, keys).withColumn(name, (F.pmod(F.xxhash64(F.lit(7), "row"), F.lit(1 << 31)) % F.col(name)).cast("int"))


def mine(
    table: DataFrame,
    positives: int = 5,
    k: int = 5,
    share: tuple[int, int] = (80, 100),
    every: int = 100,
    scale: float = 256.0,
    relabel: int | None = 7,
    labels: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): each anchor's and positive's hard negatives.

    Components become floor(scale * x); scores are integer inner products, which stop at the ends of a long. Anchors
    are rows whose id is divisible by ``every``. An anchor's positives are the ``positives`` highest other rows of its
    label, ties to smaller ids. Negatives of a positive are the ``k`` highest rows of other labels with
    share[0] * positive_score <= share[1] * negative_score <= share[1] * positive_score, ties to smaller ids; ranks
    begin at 1. Where the id is divisible by ``relabel``, the label first becomes (label + 1) % labels.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part. Vectors meet those of
    their own dimension only. Rows that repeat an id are anchors, positives and negatives of their own. An anchor alone
    in its label has no row, nor has a positive without a negative in its interval, or with a score under 0. An empty
    table gives an empty result. Every pair of an anchor and a row is bounded, in groups of ANCHOR_BYTES of anchors
    and GROUP_BYTES of rows, which a label or dimension that most rows have is split into like any other.
    """
    spark = table.sparkSession
    found = vectors(table, scale, id_col, vector_col, label_col)
    if relabel:
        found = found.withColumn("label", F.when(F.col("id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    found = materialize(found, "vectors")
    axes = spark.sparkContext.broadcast(rotations(found))  # MOST_ROTATED square matrices at most
    n = found.count()
    width = 8 * F.greatest("dim", F.lit(1)).cast("long")
    anchors = found.where(F.col("id") % every == 0)
    least = partitions(spark, 0, 1)

    def dealt(keys: list[str]) -> tuple[DataFrame, DataFrame]:
        """(anchors with block, for each part; rows with part), by keys whose rows meet."""
        sizes = found.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(F.when(F.col("id") % every == 0, 1).otherwise(0)).alias("asked")).where("asked > 0")
        # groups of GROUP_BYTES at most, and enough of them for all cores where there are fewer
        parts = F.greatest(F.ceil(F.col("rows") * width / GROUP_BYTES), F.ceil(F.col("rows") * F.lit(least) / F.lit(max(n, 1)))).cast("int")
        sizes = materialize(sizes.select(*keys, parts.alias("part"), F.ceil(F.col("asked") * width / ANCHOR_BYTES).cast("int").alias("block")), "sizes")
        own = _blocks(anchors, sizes.select(*keys, "block"), keys, "block")
        own = own.join(sizes.select(*keys, F.col("part").alias("_parts")), keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        rows_ = _blocks(found, sizes.select(*keys, "part"), keys, "part")
        rows_ = rows_.join(sizes.select(*keys, F.col("block").alias("_blocks")), keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
        return own, rows_

    def sides(own: DataFrame, rows_: DataFrame, key: list[str], of_own: list[str], of_rows: list[str]) -> list[DataFrame]:
        """Both with columns of their own, as they come from one table; keys under names by side."""
        both = ((own, "l_", of_own), (rows_, "r_", of_rows))
        return [part.select(*(F.col(c).alias(f"{side}{c}") for c in key), *(F.col(c).alias(c) for c in rest)) for part, side, rest in both]

    def meet(left: pd.DataFrame, right: pd.DataFrame, lows: np.ndarray, highs: np.ndarray, same: bool, k: int) -> Best:
        """The best rows of one group for its anchors; of the same label, or of others."""
        dim = int(left["dim"].iloc[0])
        a, b = (Rotated(part["q"].tolist(), dim, axes.value.get(dim)) for part in (left, right))
        ids, names, tags = (right[c].to_numpy() for c in ("id", "row", "label"))
        best = Best(lows, highs, k)
        for x in range(0, len(right), TILE):
            which = np.arange(x, min(x + TILE, len(right)))
            low, high = best.window()
            for y in range(0, len(left), ANCHOR_TILE):
                who = np.arange(y, min(y + ANCHOR_TILE, len(left)))
                i, j = survivors(a, who, b, which, low, high)
                fits = (left["label"].to_numpy()[i] == tags[j]) == same
                fits &= left["row"].to_numpy()[i] != names[j]
                i, j = i[fits], j[fits]
                if len(i):
                    best.add(i, np.arange(len(right))[j] if same else ids[j], a.exact(i, b, j))
            best.settle()
        return best

    # positives: a group has one label; ties among its rows go by id
    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        kinds = {"row": "int64", "nth_id": "int64", "nth_row": "int64", "score": "int64"}
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in kinds.items()})
        right = right.sort_values(["id", "row"]).reset_index(drop=True)  # a row's place orders as its id does
        ends = np.full((len(left), 1), -(2**63), np.int64), np.full((len(left), 1), 2**63 - 1, np.int64)
        ((_, who, at, score),) = meet(left, right, *ends, True, positives).rows()
        return pd.DataFrame({"row": left["row"].to_numpy()[who], "nth_id": right["id"].to_numpy()[at], "nth_row": right["row"].to_numpy()[at], "score": score}).astype(kinds)

    own, others = dealt(["dim", "label"])
    key = ["dim", "label", "block", "part"]
    left, right = sides(own, others, key, ["dim", "label", "id", "row", "q"], ["dim", "label", "id", "row", "q"])
    near = left.groupBy(*(f"l_{c}" for c in key)).cogroup(right.groupBy(*(f"r_{c}" for c in key))).applyInPandas(nearest, "row long, nth_id long, nth_row long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "nth_id", "nth_row")
    near = near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= positives)
    near = materialize(near.select(F.col("row").alias("anchor_row"), "nth", F.col("nth_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # negatives: within the intervals that the positives' scores give
    def hard(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        kinds = {"row": "int64", "nth": "int32", "negative_id": "int64", "negative_score": "int64"}
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in kinds.items()})
        lows, highs = np.zeros((len(left), positives), np.int64), np.full((len(left), positives), -1, np.int64)
        scores = left["scores"].tolist()
        at = np.repeat(np.arange(len(left)), [len(s) for s in scores]), np.concatenate([np.arange(len(s)) for s in scores])
        highs[at] = np.concatenate([np.asarray(s, np.int64) for s in scores])
        lows[at] = np.maximum(_lowest(highs[at], share), np.stack(left["bars"].to_numpy())[at])
        found = [pd.DataFrame({"row": left["row"].to_numpy()[who], "nth": i + 1, "negative_id": ids, "negative_score": score}) for i, who, ids, score in meet(left, right, lows, highs, False, k).rows()]
        return pd.concat(found).astype(kinds)

    asked = near.groupBy("anchor_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))), lambda p: p["positive_score"]).alias("scores"))  # ``positives`` at most
    own, others = dealt(["dim"])
    own = own.join(asked, F.col("row") == F.col("anchor_row")).drop("anchor_row")
    key = ["dim", "block", "part"]
    none = F.array_repeat(F.lit(-(2**63)).cast("long"), positives)
    best = Window.partitionBy("row", "nth").orderBy(F.desc("negative_score"), "negative_id")
    top = lambda rows: rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def met(own: DataFrame, rows_: DataFrame) -> DataFrame:
        left, right = sides(own, rows_, key, ["dim", "row", "label", "q", "scores", "bars"], ["id", "row", "label", "q"])
        return left.groupBy(*(f"l_{c}" for c in key)).cogroup(right.groupBy(*(f"r_{c}" for c in key))).applyInPandas(hard, "row long, nth int, negative_id long, negative_score long")

    early = F.col("part") % EARLY == 0
    first = materialize(top(met(own.where(early).withColumn("bars", none), others.where(early))), "early")
    kth = first.where(F.col("rank") == k).groupBy(F.col("row").alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct("nth", "negative_score"))).alias("_kth"))
    bars = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda n: F.coalesce(F.try_element_at("_kth", n), F.lit(-(2**63)).cast("long")))
    later = own.where(~early).join(kth, F.col("row") == F.col("_row"), "left").withColumn("bars", F.when(F.col("_kth").isNull(), none).otherwise(bars)).drop("_row", "_kth")
    negatives = top(first.drop("rank").unionByName(met(later, others.where(~early))))
    ids = anchors.select(F.col("id").alias("anchor_id"), F.col("row").alias("_row"))
    named = near.join(ids, F.col("anchor_row") == F.col("_row")).select("anchor_id", "anchor_row", F.col("nth").alias("_nth"), "positive_id", "positive_score")
    both = negatives.join(named, (F.col("row") == F.col("anchor_row")) & (F.col("nth") == F.col("_nth")))
    return both.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
