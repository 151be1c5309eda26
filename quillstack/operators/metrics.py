"""Query and indexing metrics, as rows and their aggregates."""

from __future__ import annotations

import resource
import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillstack import schemas
from quillstack.operators import order

SLOW_MS = 100.0


def percentiles(rows: DataFrame, value: str, by: Sequence[str], ps: Sequence[float]) -> DataFrame:
    """p<p>: the value at floor(p n / 100) of a group's sorted values, the last one at most; of all rows without ``by``.

    Equal values combine first. How many are before a value comes from sums over ranges of (group, value) that are
    about equal, so that neither a large group nor values close together are one task's.
    """
    key = list(by)
    each = rows.where(F.col(value).isNotNull()).groupBy(*key, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = order.running(each.withColumn("_key", F.struct(*key, "_v")), "_key", None, {"_before": "_n"})
    group = [F.col(c).alias(f"_of_{k}") for k, c in enumerate(key)]
    groups = placed.groupBy(*group).agg(F.min("_before").alias("_first"), F.sum("_n").alias("_of"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{k}")) for k, c in enumerate(key)]
    both = placed.join(groups, same) if key else placed.crossJoin(F.broadcast(groups))  # one row
    before, at = F.col("_before") - F.col("_first"), lambda p: F.least(F.floor(F.lit(p) * F.col("_of") / F.lit(100.0)), F.col("_of") - 1)
    return both.groupBy(*key).agg(*(F.max(F.when((before <= at(p)) & (before + F.col("_n") > at(p)), F.col("_v"))).alias(f"p{p:g}") for p in ps))


def query_stats(rows: DataFrame, value: str = "time_ms") -> DataFrame:
    """One row: count, sum, mean, least and greatest, and percentiles by nearest rank."""
    v = F.col(value)
    sums = rows.agg(F.count(v).alias("query_count"), F.sum(v).alias("total_ms"), F.avg(v).alias("avg_time_ms"), F.min(v).alias("min_time_ms"), F.max(v).alias("max_time_ms"))
    ranks = percentiles(rows, value, (), (50, 95, 99)).select(*(F.col(f"p{p}").alias(f"p{p}_time_ms") for p in (50, 95, 99)))
    return sums.crossJoin(ranks)  # one row each


def memory_stats(rows: DataFrame, value: str = "mem_kb", at: str = "query_id") -> DataFrame:
    """One row: the latest and the greatest memory, in MB."""
    mb = lambda c: c / F.lit(1024.0)
    return rows.agg(mb(F.max_by(value, at)).alias("current_memory_mb"), mb(F.max(value)).alias("peak_memory_mb"))


def stats_rows(stats: DataFrame) -> DataFrame:
    """(key, value) rows of query_count, avg_time_ms, p95_time_ms and peak_memory_mb."""
    names = ("query_count", "avg_time_ms", "p95_time_ms", "peak_memory_mb")
    pairs = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    return stats.selectExpr(f"stack({len(names)}, {pairs}) as (key, value)")


def slow(rows: DataFrame, limit_ms: float = SLOW_MS) -> DataFrame:
    return rows.where(F.col("time_ms") > limit_ms)


def throughput(docs: Column, seconds: Column) -> Column:
    """Documents a second, whole seconds counted."""
    return docs / (F.floor(seconds) + F.lit(0.01))


def memory_kb() -> int:
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss


@dataclass
class PerformanceMonitor:
    """Times queries on the driver; its rows are a DataFrame for the functions above."""

    index_kb: int = 0
    rows: list[tuple[int, float, int]] = field(default_factory=list)

    @contextmanager
    def query(self) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((len(self.rows), (time.perf_counter() - began) * 1000, memory_kb()))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, schemas.METRICS)

    def report(self, spark: SparkSession) -> DataFrame:
        """One row of times and memory."""
        frame = self.frame(spark)
        both = query_stats(frame).crossJoin(memory_stats(frame))  # one row each
        return both.withColumn("index_memory_mb", F.lit(self.index_kb / 1024.0))

    def save(self, spark: SparkSession, path: str) -> None:
        from quillstack.sources.writers import stats_csv

        stats_csv(stats_rows(self.report(spark)), path)


@dataclass
class IndexingMonitor:
    """How fast documents are indexed. A job counts them as it reads them, by ``watch``; ``record`` is for others."""

    began: float = field(default_factory=time.perf_counter)
    docs: int = 0
    seen: Observation | None = None

    def record(self, n: int = 1) -> None:
        self.docs += n

    def watch(self, rows: DataFrame, **counts: Column) -> DataFrame:
        """``rows``, which are counted while a job reads them: no further pass is made for it. ``counts`` are more
        aggregates of them."""
        self.seen = Observation()
        return rows.observe(self.seen, F.count("*").alias("docs"), *(c.alias(n) for n, c in counts.items()))

    def summary(self) -> dict[str, float]:
        """Once a job has read what is watched: it waits for that."""
        seconds = time.perf_counter() - self.began
        seen = self.seen.get if self.seen else {}
        docs = self.docs + seen.get("docs", 0)
        return {**seen, "docs": docs, "seconds": seconds, "docs_per_second": docs / (int(seconds) + 0.01)}
