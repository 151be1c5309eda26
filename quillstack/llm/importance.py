"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import lowest, materialize, named, rows

#: Words and runs of punctuation are tokens; what is not ASCII counts as a letter.
TOKEN = re.compile(rb"[^\x00-/:-@\[-`{-\x7f]+|[!-/:-@\[-`{-~]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 14
    #: Labelled rows of each class that fit and calibrate the model, at most; those with the lowest hashes are taken.
    most_labelled: int = 20_000
    #: The target model starts with so many counts a bucket, dealt as the raw model's.
    smoothing: float = 1.0
    #: A text's log importance weight is that of so many of its n-grams, in expectation, whatever its length; the
    #: Gumbel noise has unit scale against it.
    grams: int = 32
    seed: int = 42


def features(text: str | None, buckets: int) -> np.ndarray:
    """Buckets of a text's tokens and pairs of neighbours, repeats included; pairs of equal tokens share a bucket."""
    found = TOKEN.findall((text or "").encode("utf-8", "replace"))
    if not found:
        return np.zeros(0, dtype=np.int64)
    digest = xxhash.xxh3_64_intdigest
    one = np.array([digest(t) for t in found], dtype=np.uint64)
    a, b = one[:-1], one[1:]
    two = (a ^ (a >> np.uint64(31))) * MIX + (b ^ (b >> np.uint64(29)))
    two = np.where(a == b, np.uint64(1), two ^ (two >> np.uint64(32)))
    return (np.concatenate([one, two]) % np.uint64(buckets)).astype(np.int64)


def _counted(docs: DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket, of all rows and of those with fit = 1."""
    out = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = (np.zeros(settings.buckets, dtype=np.int64) for _ in "rt")
        for text, fit in rows(batches, "text", "fit"):
            own = np.bincount(features(text, settings.buckets), minlength=settings.buckets)
            raw += own
            if fit:
                target += own
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], schema=out)

    sums = docs.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = (np.zeros(settings.buckets) for _ in "rt")
    for r in sums.collect():  # a row for each bucket
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray, smoothing: float) -> np.ndarray:
    """log p_target - log p_raw of each bucket; the target is drawn to the raw model where it has few counts."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    base = raw + 0.1 * raw.mean()
    base /= base.sum()
    prior = smoothing * len(raw)
    model = (target + prior * base) / (target.sum() + prior)
    return np.log(model) - np.log(base)


def gumbel(i: int | None, text: str | None, seed: int) -> float:
    """Standard Gumbel noise, drawn by a row's id, or by its text where that is null."""
    noise = xxhash.xxh3_64_intdigest((text or "" if i is None else str(i)).encode("utf-8", "replace"), seed)
    return float(-np.log(-np.log(((noise >> 12) + 0.5) / 2.0**52)))


def _scored(docs: DataFrame, ratio: np.ndarray, settings: Settings) -> DataFrame:
    ratio = docs.sparkSession.sparkContext.broadcast(ratio)
    out = pa.schema([("id", pa.int64()), ("n_features", pa.int64()), ("log_weight", pa.float64()), ("gumbel_key", pa.float64()), ("row", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for i, text, row in rows([batch], "id", "text", "row"):
                own = features(text, settings.buckets)
                weight = settings.grams * float(ratio.value[own].mean()) if len(own) else float("-inf")
                held.append((i, len(own), weight, weight + gumbel(i, text, settings.seed), row))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)] if held else [pa.array([], f.type) for f in out], schema=out)

    return docs.mapInArrow(run, "id long, n_features long, log_weight double, gumbel_key double, row string")


def threshold(weights: np.ndarray, good: np.ndarray) -> float:
    """The log weight that splits good from other rows with the best balanced accuracy; 0 with one class only."""
    if not good.any() or good.all():
        return 0.0
    order = np.argsort(-weights, kind="stable")
    w, g = weights[order], good[order]
    hit, miss = np.cumsum(g) / g.sum(), np.cumsum(~g) / (~g).sum()
    ends = np.flatnonzero(np.append(w[1:] != w[:-1], True))
    best = ends[np.argmax(hit[ends] - miss[ends])]
    below = w[best + 1] if best + 1 < len(w) else w[best]
    return float((w[best] + below) / 2) if np.isfinite(below) else float(w[best])


def sortable(key: Column) -> Column:
    """Doubles as longs of the same order, in steps of 2**-20 and up to 2**41 either way."""
    bound = F.greatest(F.least(key, F.lit(2.0**41)), F.lit(-(2.0**41)))
    return F.floor(bound * F.lit(2.0**20)).cast("long")


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows with the highest long ``key``, and whatever ties with the last of them.

    Two histograms of 2**16 intervals each at most reach the driver a pass; no rows do, and nothing is sorted.
    """
    if k <= 0:
        return df.limit(0)
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    if lo is None or df.count() <= k:
        return df
    while lo < hi:
        width = max(1, -(-(hi - lo + 1) // 65536))
        near = df.where((F.col(key) >= lo) & (F.col(key) <= hi))
        counts = near.groupBy(F.floor((F.col(key) - F.lit(lo)) / F.lit(width)).cast("long").alias("b")).count().collect()
        above = df.where(F.col(key) > hi).count()
        for b, n in sorted(((r["b"], r["count"]) for r in counts), reverse=True):
            if above + n >= k:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            above += n
    return df.where(F.col(key) >= lo)


def _labelled(labels: DataFrame, settings: Settings, id_col: str, label_col: str) -> DataFrame:
    """(label_id, good, fit) of the labelled sample: most_labelled rows of each class at most; half of them fit."""
    thin = labels.select(F.col(id_col).cast("long").alias("label_id"), (F.col(label_col) > 0).alias("good")).where(F.col("label_id").isNotNull() & F.col("good").isNotNull())
    thin = thin.groupBy("label_id").agg(F.min("good").alias("good")).withColumn("h", F.xxhash64("label_id", F.lit(settings.seed)))
    thin = materialize(thin, "labels")
    some = [lowest(thin.where(F.col("good") == good), "h", settings.most_labelled) for good in (True, False)]
    return some[0].union(some[1]).select("label_id", "good", (F.col("good") & (F.pmod("h", F.lit(2)) == 0)).alias("fit"), (F.pmod("h", F.lit(2)) == 1).alias("held"))


def weigh(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", row_col: str | None = None) -> tuple[DataFrame, int]:  # noqa: B008
    """((id, n_features, log_weight, gumbel_key, row) of every row, rows to keep).

    log_weight is the mean log ratio over a text's n-grams times ``grams``, so that length alone decides nothing.
    The raw model counts the n-grams of all rows; the target model those of labelled good rows, of which half fit
    it. The other half, with labelled bad rows, calibrates the threshold whose count of rows is the k to keep.
    """
    spark = docs.sparkSession
    sample = spark.createDataFrame([tuple(r) for r in _labelled(labels, settings, id_col, label_col).collect()], "label_id long, good boolean, fit boolean, held boolean")
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), named(row_col).alias("row"))
    marked = thin.join(F.broadcast(sample), F.col("id") == F.col("label_id"), "left")
    raw, target = _counted(marked.select("text", F.coalesce("fit", F.lit(False)).alias("fit")), settings)
    scored = materialize(_scored(thin, log_ratio(raw, target, settings.smoothing), settings), "weights")
    held = scored.join(F.broadcast(sample.where("held")), F.col("id") == F.col("label_id")).select("log_weight", "good").toPandas()  # the sample's rows
    at = threshold(held["log_weight"].to_numpy(float), held["good"].to_numpy(bool))
    return scored, scored.where(F.col("log_weight") >= at).count()


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", row_col: str | None = None) -> DataFrame:  # noqa: B008
    """(id_col, n_features, log_weight, gumbel_key, row) of the k rows that Gumbel top-k keeps.

    Without k, as many as have a log importance weight over the calibrated threshold. Texts without a token (null,
    empty, blank) have weight -inf and are kept only if k asks for them; repeated rows have one key and are kept or
    rejected together, as are other ties with the last row kept; a row with a null id draws its noise by its text.
    Without labelled good rows all weights are 0. An empty table gives an empty result.
    """
    scored, count = weigh(docs, labels, settings, id_col, text_col, label_col, row_col)
    found = top_k(scored.withColumn("order", sortable(F.col("gumbel_key"))), "order", count if k is None else k)
    return found.drop("order").withColumnRenamed("id", id_col)
