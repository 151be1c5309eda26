"""What the training-data operators share: the shared folder, written tables, row access."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.sources.shared import new_path, remove


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    It cuts the lineage, so that lost executors cost at most one stage, and lets both sides of a later join be
    plain exchanges, which adaptive execution splits where a key is skewed.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``materialize`` gave and that nothing will read again."""
    for table in tables:
        remove(table.sparkSession, table.written_at)


def with_rows(df: DataFrame, name: str = "row") -> DataFrame:
    """``df`` with a string that tells its rows apart, the same whenever and wherever it is read.

    It is the place in the Parquet file that a row comes from; what comes from elsewhere is written first.
    """
    place = F.concat_ws("#", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index"))
    try:
        found = df.withColumn(name, place)
        found.schema  # noqa: B018  resolves it
    except AnalysisException:
        found = materialize(df, "rows").withColumn(name, place)
    return found


def named(column: str | None) -> Column:
    """A column that tells rows apart, where a caller has one; null else."""
    return (F.lit(None) if column is None else F.col(column)).cast("string")


def partitions(spark: SparkSession, amount: float, each: float) -> int:
    """Partitions for ``amount`` at about ``each`` apiece, the session's shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(amount // each) + 1)


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a whole column."""
    return df.agg(F.sum(F.octet_length(F.col(column))).alias("n")).first()["n"] or 0


def lowest(df: DataFrame, by: str, n: int) -> DataFrame:
    """The n rows with the lowest ``by``, a hash as a long that few rows share.

    A histogram of the hashes' high bits cuts away nearly all other rows first: else every task would send n rows to
    the driver, to be merged there.
    """
    high = F.shiftright(by, 48)
    counts = sorted((r["b"], r["count"]) for r in df.groupBy(high.alias("b")).count().collect())  # 2**16 rows at most
    cut, total = None, 0
    for b, count in counts:
        cut, total = b, total + count
        if total >= n:
            break
    return df.where(high <= F.lit(cut)).orderBy(by).limit(n)


def rows(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of Arrow batches, as Python values, a few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def batched(found: Iterable[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Arrow batches of ``size`` rows at most."""
    held: list[tuple] = []
    for row in found:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def packed(q: np.ndarray) -> bytes:
    """Integers in as few bytes each as all of them fit in: two, four or eight."""
    low, high = (int(q.min()), int(q.max())) if len(q) else (0, 0)
    kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return q.astype(kind).tobytes()


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    """The integers of rows of one dimension."""
    found = np.zeros((len(rows), dim), np.int64)
    if dim:
        width = np.array([len(r) // dim for r in rows])
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            found[at] = np.frombuffer(b"".join(rows[k] for k in at.tolist()), f"<i{w}").reshape(-1, dim)
    return found
