"""Global numbering and running sums without a global sort: a window within each bucket, and one over the buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.sources.shared import written


def numbered(rows: DataFrame, by: str, bucket: Column | None, name: str) -> DataFrame:
    """``name``: 1 for the row with the least ``by``, and so on. ``bucket`` must order rows as ``by`` does, if less finely."""
    return running(rows, by, bucket, {}, number=name)


def ranged(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``_bucket``: the number of the range of ``by`` that a row is in, of ranges about equal in rows.

    They are written, as another reading may draw other ranges.
    """
    return written(rows.repartitionByRange(*by).withColumn("_bucket", F.spark_partition_id()), "ranged")


def running(rows: DataFrame, by: str, bucket: Column | None, sums: dict[str, str], number: str | None = None) -> DataFrame:
    """Sums over the rows before in the order of ``by``, of the columns that ``sums`` names by what it adds; and
    ``number``, which counts the rows up to this one.

    Only one row for each bucket meets in a single task. Without ``bucket``, buckets are ranges that the rows themselves
    give, so that none is longer for what the values have in common; ``by`` then tells rows apart.
    """
    rows = ranged(rows, by) if bucket is None else rows.withColumn("_bucket", bucket)
    wanted = {name: F.col(value) for name, value in sums.items()} | ({number: F.lit(1).cast("long")} if number else {})
    upto = {name: 0 if name == number else -1 for name in wanted}
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy("_bucket").agg(*(F.sum(v).alias(f"_{k}") for k, v in wanted.items()))
    ahead = each.select("_bucket", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in wanted))
    own = {k: Window.partitionBy("_bucket").orderBy(by).rowsBetween(Window.unboundedPreceding, upto[k]) for k in wanted}
    found = rows.join(ahead, "_bucket").withColumns({k: F.col(f"_{k}") + F.coalesce(F.sum(v).over(own[k]), F.lit(0)) for k, v in wanted.items()})
    if number:
        found = found.withColumn(number, F.col(number).cast("int"))
    return found.drop("_bucket", *(f"_{k}" for k in wanted))


def by_number(column: str, bits: int = 16) -> Column:
    """Numbers by all but their low bits."""
    return F.shiftright(column, bits)
