"""Shuffled batches, curriculum rows and training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brevia.functions.sequences import prefix_keep, shift_input, shift_label

_BUCKET_ROWS = 500_000  # rows of an epoch that are numbered in one task, about
_LEAST_DIGITS, _MOST_DIGITS = 3, 12  # hexadecimal digits of the shuffle key that name a bucket
_BROADCAST_OFFSETS = 1_000_000


def shuffle_key(key: Column, epoch: Column, seed: int) -> Column:
    """A pseudo-random order that differs in every epoch and is the same on every run."""
    return F.md5(F.concat_ws("-", key.cast("string"), epoch.cast("string"), F.lit(str(seed))))


def _bucket_digits(rows: int) -> int:
    """Digits for buckets of at most about ``_BUCKET_ROWS``."""
    digits = _LEAST_DIGITS
    while digits < _MOST_DIGITS and rows > _BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def assign_batches(
    df: DataFrame, batch_size: int, epochs: int = 1, seed: int = 0, key: str = "doc_id", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Batch number and place in the batch for every document and epoch; the last batch may be smaller.

    The order is that of a hash, so its leading digits cut an epoch into even buckets, as many as the rows need. Rows are
    numbered inside their bucket and the sizes of the earlier buckets are added: no task sees a whole epoch. Another
    number of passes over the rows, as a curriculum makes, is another number of epochs: each has its own order.
    """
    if batch_size < 1 or epochs < 1:
        raise ValueError("batch_size and epochs must be at least 1")
    rows = df.select(F.col(key), *carry, F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    rows = rows.withColumn("_order", shuffle_key(F.col(key), F.col("epoch"), seed))
    digits = _bucket_digits(df.count())
    rows = rows.withColumn("_bucket", F.conv(F.substring("_order", 1, digits), 16, 10).cast("bigint"))
    earlier = Window.partitionBy("epoch").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("epoch", "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.select("epoch", "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    if epochs * 16**digits <= _BROADCAST_OFFSETS:
        before = F.broadcast(before)
    inside = Window.partitionBy("epoch", "_bucket").orderBy("_order", key, *carry)
    numbered = rows.withColumn("_row", F.row_number().over(inside)).join(before, ["epoch", "_bucket"])
    at = F.col("_before") + F.col("_row") - F.lit(1)
    return numbered.select(
        "epoch", key, *carry, F.floor(at / F.lit(batch_size)).cast("bigint").alias("batch"),
        (at % F.lit(batch_size)).cast("int").alias("place"),
    )


def expand_steps(df: DataFrame, steps: int, epochs: int = 1) -> DataFrame:
    """Every row once for each epoch and curriculum step."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(steps)))
    )


def prefix_curriculum(
    df: DataFrame, target_size: int | Column, target: str = "target", input_size: int | Column | None = None,
    source: str = "input",
) -> DataFrame:
    """Cut the target of each expanded row to its step's prefix; with ``input_size`` the input too."""
    cut = {target: prefix_keep(F.col(target), F.col("step"), target_size)}
    if input_size is not None:
        cut[source] = prefix_keep(F.col(source), F.col("step"), input_size)
    return df.withColumns(cut)


def assign_passes(
    df: DataFrame, batch_size: int, epochs: int, steps: int, seed: int = 0, key: str = "doc_id",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``assign_batches`` for a curriculum: a new order in each step of each epoch, numbered through."""
    passes = assign_batches(df, batch_size, epochs * steps, seed, key, carry).withColumnRenamed("epoch", "_pass")
    at = F.col("_pass") - F.lit(1)
    return passes.select(
        (F.floor(at / F.lit(steps)) + 1).cast("int").alias("epoch"), (at % F.lit(steps) + 1).cast("int").alias("step"),
        key, *carry, "batch", "place",
    )


def next_token_pairs(df: DataFrame, ids: str = "ids") -> DataFrame:
    """Decoder input and label of each sequence."""
    return df.withColumns({"input_ids": shift_input(F.col(ids)), "label_ids": shift_label(F.col(ids))})


def next_token_rows(df: DataFrame, key: list[str], ids: str = "ids") -> DataFrame:
    """Decoder input and label per position. The pairs come from inside each row, so nothing is shuffled."""
    pairs = F.arrays_zip(shift_input(F.col(ids)).alias("prev"), shift_label(F.col(ids)).alias("real"))
    return df.select(*key, F.posexplode(pairs).alias("pos", "_pair")).select(
        *key, "pos", F.col("_pair.prev").alias("prev"), F.col("_pair.real").alias("real")
    )


def concat_chunks(df: DataFrame, key: str = "doc_id", chunk: str = "chunk", ids: str = "ids") -> DataFrame:
    """Put the slices of each document back in order."""
    slices = F.sort_array(F.collect_list(F.struct(F.col(chunk).alias("c"), F.col(ids).alias("v"))))
    return df.groupBy(key).agg(F.flatten(F.transform(slices, lambda s: s["v"])).alias(ids))
