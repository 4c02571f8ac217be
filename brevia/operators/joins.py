"""Joins against tables whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Up to this many rows and text bytes a table may be broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
# A join key with more left rows than this, and more than an even share of them, is split over several tasks.
HOT_ROWS = 200_000


def fits_broadcast(
    df: DataFrame, texts: tuple[str, ...] = (), rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES
) -> bool:
    """Whether a table is small enough to broadcast: counted rows, and bytes of its text columns."""
    text_bytes = sum((F.coalesce(F.octet_length(F.col(t).cast("string")), F.lit(0)) for t in texts), F.lit(0))
    found = df.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(text_bytes.cast("bigint")), F.lit(0)).alias("bytes")
    ).first()
    return found["rows"] <= rows and found["bytes"] <= size


def skew_join(
    left: DataFrame, right: DataFrame, on: list[str], by: list[str], small: bool, how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join a table with repeated keys to a lookup table with one row, or few, for each key.

    A small lookup table is broadcast. Otherwise the left rows of each key are counted; a key with more than
    ``hot_rows``, and more than the rows over the number of shuffle partitions, is split into parts of that size by a hash
    of ``by``, and only that key's lookup rows are copied to each part. By that limit there are fewer hot keys, and fewer
    parts of one, than partitions, whatever the data. Hot keys are named by hash; two keys of one hash are only both
    split.
    """
    if small:
        return left.join(F.broadcast(right), on, how)
    key = F.xxhash64(*on)
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(hot_rows, -(-left.count() // partitions))
    counts = left.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > share)
    hot = counts.select("_key", F.ceil(F.col("_rows") / F.lit(share)).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    split = left.withColumn("_key", key).join(F.broadcast(hot), "_key", "left").withColumn(
        "_part", F.pmod(F.xxhash64(*by), parts).cast("int")
    ).drop("_key", "_parts")
    copies = right.withColumn("_key", key).join(F.broadcast(hot), "_key", "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), parts - 1))
    ).drop("_key", "_parts")
    return split.join(copies, [*on, "_part"], how).drop("_part")
