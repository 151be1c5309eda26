"""Stupid-backoff scores, computed relationally in blocks.

Three relations, each dealt by a hash: documents in batches; the n-grams of each batch with their counts, dealt by the
n-gram's hash; and the count tables, of which each part holds all counts of its hashes. Batches join the tables on
the hash, and the scores of a document's n-grams are summed. Rows of the relations are packed: an n-gram is eight
bytes of a sorted array (its gap to the one before, by byte planes), not a row, which keeps a shuffle of all n-grams of a corpus near the corpus's own size.

Every document is scored by all others: its own occurrences are taken off the counts, so that an n-gram that only it
has backs off.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import named, text_bytes, with_rows

_M = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    order: int = 2
    alpha: float = 0.4
    #: Text of a batch: more where there are so many parts that a batch would have under ``cell_grams`` for each.
    batch_bytes: int = 8 << 20
    most_batch_bytes: int = 64 << 20
    cell_grams: int = 64
    #: n-grams of a part of the count tables, about.
    part_grams: int = 2_000_000
    #: Batches and parts of a small corpus.
    least: int = 16


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M
    return h ^ (h >> np.uint64(29))


class Batch:
    """The n-grams of some documents: for each order, hashes of all and the place of each occurrence's."""

    def __init__(self, texts: list[str | None], order: int) -> None:
        known: dict[bytes, int] = {}
        found, self.lengths = [], []
        for text in texts:
            own = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z, and \x20 \x09-\x0D
            found.append(np.fromiter((known.setdefault(w, len(known)) for w in own), dtype=np.int64, count=len(own)))
            self.lengths.append(len(own))
        words = np.array([xxhash.xxh64_intdigest(w) for w in known], dtype=np.uint64)
        del known
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        starts = np.cumsum([0, *self.lengths[:-1]]) if texts else np.zeros(0, np.int64)
        self.place = np.arange(len(flat)) - np.repeat(starts, self.lengths)
        #: by order: sorted hashes, their counts; for each token the index of the n-gram that ends there, or -1
        self.grams: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        one = words[flat]
        h = one
        for n in range(1, order + 1):
            ends = np.flatnonzero(self.place >= n - 1)
            if n > 1:
                h = np.append(np.uint64(0), _mixed(h[:-1] + np.uint64(n)) * _M + one[1:]) if len(h) else h
            grams, inverse, counts = np.unique(h[ends], return_inverse=True, return_counts=True)
            at = np.full(len(flat), -1, dtype=np.int64)
            at[ends] = inverse
            self.grams.append(grams)
            self.counts.append(counts)
            self.at.append(at)

    def own(self, n: int) -> np.ndarray:
        """For each token, how often its document has the n-gram that ends there."""
        at = self.at[n]
        out = np.zeros(len(at), dtype=np.int64)
        ends = np.flatnonzero(at >= 0)
        if len(ends):
            _, inverse, counts = np.unique(self.doc[ends] * np.int64(len(self.grams[n])) + at[ends], return_inverse=True, return_counts=True)
            out[ends] = counts[inverse]
        return out


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """Hashes to parts, by their high bits: a part of a sorted array is a slice of it."""
    return ((grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers by their bytes, lowest first: the planes of high bytes are zeros, which a shuffle compresses away."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def packed(grams: np.ndarray) -> bytes:
    """Sorted hashes as their gaps."""
    return _planes(np.diff(grams, prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data), dtype=np.uint64)


def log_scores(batch: Batch, totals: list[np.ndarray], tokens: int, alpha: float) -> np.ndarray:
    """The log score of each token, by the counts of all documents but its own."""
    lengths = np.array(batch.lengths, dtype=np.int64)
    rest = np.maximum(tokens - lengths[batch.doc], 0)
    left = []  # by order: counts without the document's own
    for n, total in enumerate(totals):
        at = batch.at[n]
        left.append(np.where(at >= 0, total[np.maximum(at, 0)] - batch.own(n), 0) if len(total) else np.zeros(len(at), np.int64))
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(left[0] > 0, np.log(left[0]) - np.log(rest), -np.log(rest + 1.0)) if totals else np.zeros(0)
        for n in range(1, len(totals)):
            context = np.append(0, left[n - 1][:-1])
            score = np.where(left[n] > 0, np.log(left[n]) - np.log(context), np.where(batch.place >= n, math.log(alpha), 0.0) + score)
    return score


def score(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:  # noqa: B008
    """(id_col, n_tokens, log_score, mean_log_score, row) for every row.

    A token's score is c(n-gram) / c(its context) where the n-gram occurs in other documents, else ``alpha`` times the
    score with one word of context less; a word that occurs in no other document has 1 / (tokens of others + 1).
    log_score is their logarithms' sum, mean_log_score the mean. Texts without a word (null, empty, blank) have sum 0
    and a null mean. Repeated rows are documents of their own, and so score high. An empty table gives an empty
    result.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), named(row_col).alias("row"))
    thin = with_rows(thin, "place")
    size = text_bytes(thin, "text")
    # by the corpus alone: a row for each batch and part that meet, however many partitions the session has
    parts = max(settings.least, int(settings.order * size / 6 / settings.part_grams) + 1)
    each = min(settings.most_batch_bytes, max(settings.batch_bytes, 6 * settings.cell_grams * parts))
    batches = max(settings.least, size // each + 1)
    tokens = thin.agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)))).first()[0] or 0
    # by its place: equal rows are dealt as others are
    dealt = thin.withColumn("batch", F.pmod(F.xxhash64("place"), F.lit(batches)).cast("int")).drop("place")

    def grams(group: pd.DataFrame) -> pd.DataFrame:
        batch, found = Batch(group["text"].tolist(), settings.order), []
        for n in range(settings.order):
            cuts = np.searchsorted(part_of(batch.grams[n], parts), np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[p], cuts[p + 1])
                found.append((p, int(group["batch"].iloc[0]), n, packed(batch.grams[n][own]), _planes(batch.counts[n][own])))
        return pd.DataFrame(found, columns=["part", "batch", "n", "grams", "counts"])

    def tables(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for n, rows in group.groupby("n"):
            keys = np.concatenate([unpacked(g) for g in rows["grams"]])
            counts = np.concatenate([_from_planes(c) for c in rows["counts"]]).astype(np.int64)
            order = np.argsort(keys)
            ranked = keys[order]
            first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
            total = np.empty(len(keys), dtype=np.int64)
            total[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.append(first, len(keys))))
            ends = np.cumsum([len(g) // 8 for g in rows["grams"]])
            for b, t in zip(rows["batch"], np.split(total, ends[:-1]), strict=True):
                found.append((int(b), int(group["part"].iloc[0]), int(n), _planes(t)))
        return pd.DataFrame(found, columns=["batch", "part", "n", "totals"])

    def summed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        batch = Batch(left["text"].tolist(), settings.order)
        totals = []
        for n in range(settings.order):
            own = right[right["n"] == n].sort_values("part")
            totals.append(np.concatenate([_from_planes(t) for t in own["totals"]]).astype(np.int64) if len(own) else np.zeros(0, np.int64))
        each = log_scores(batch, totals, tokens, settings.alpha)
        sums = np.bincount(batch.doc, weights=each, minlength=len(left)) if len(each) else np.zeros(len(left))
        return pd.DataFrame({"id": left["id"].astype("Int64"), "n_tokens": np.array(batch.lengths, dtype=np.int64), "log_score": sums, "row": left["row"]})

    relation = dealt.groupBy("batch").applyInPandas(grams, "part int, batch int, n int, grams binary, counts binary")
    counted = relation.groupBy("part").applyInPandas(tables, "batch int, part int, n int, totals binary")
    found = dealt.groupBy("batch").cogroup(counted.groupBy("batch")).applyInPandas(summed, "id long, n_tokens long, log_score double, row string")
    return found.select(F.col("id").alias(id_col), "n_tokens", "log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")).alias("mean_log_score"), "row")
