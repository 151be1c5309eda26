"""Small inputs on all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of files; an input with more has enough splits of its own, on however many cores.
SMALL = 256 << 20
#: Bytes of a part of a large input, by the same estimate.
PIECE = 32 << 20


def estimate(rows: DataFrame) -> int:
    """The optimizer's estimate of bytes."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces(rows: DataFrame, each: int = PIECE) -> int:
    """Into how many parts to deal ``rows``, so that a part grows with no input."""
    return max(1, -(-estimate(rows) // each))


def spread(rows: DataFrame, *keys: str, small: int = SMALL) -> DataFrame:
    """``rows`` dealt over all cores where their files are small, as a single row group is a single task otherwise.

    With ``keys``, by those: what is then grouped by a document and more, as its terms are, is not shuffled again.

    The size is the optimizer's estimate, from the files' lengths; an input over ``small`` bytes is left as it is, so
    that nothing large is shuffled for it.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = estimate(rows)
    return rows.repartition(cores, *keys) if 1 < cores and size <= small else rows
