"""Row numbers and running totals over whole tables, without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brevia.session import stage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row in the lower 33 bits, the partition above


def rank_rows(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """Number all rows by ``order``, which must be unique, from ``start``.

    Rows are range-partitioned and sorted inside each partition; the row count of the earlier partitions is then added.
    The laid-out rows are staged, so both reads see the same layout even if an executor is lost in between.
    """
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = stage(laid.withColumn("_at", F.monotonically_increasing_id()), "rank")
    part = F.shiftright("_at", _ROW_BITS)
    row = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sizes = laid.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    # One row per shuffle partition, so at most spark.sql.shuffle.partitions rows are broadcast.
    return laid.join(F.broadcast(before), part == F.col("_part")).select(
        *df.columns, (F.col("_before") + row + F.lit(start)).cast("bigint").alias(name)
    )


def running_total(
    df: DataFrame, group: list[str], order: str, value: str, name: str, chunk: int = 4096
) -> DataFrame:
    """Running sum of ``value`` in each group, ``order`` being a whole number from 0.

    Totals are taken inside chunks of the order first and the total of the earlier chunks is added, so a group with most
    of the rows is still shared between tasks. The rows are read twice and staged for it.
    """
    keyed = stage(df, "running").withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))
    inside = Window.partitionBy(*group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = keyed.groupBy(*group, "_chunk").agg(F.sum(value).alias("_sum"))
    before = chunks.select(*group, "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_before"))
    totals = keyed.withColumn("_inside", F.sum(value).over(inside)).join(before, [*group, "_chunk"])
    return totals.select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name))
