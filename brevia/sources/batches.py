"""Training rows laid out by batch, so that a range of batches is read without a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FILE_BATCHES = 64  # batches that lie in one file
MOST_FILES = 256  # files of an epoch; where they would be more, each holds more batches
_LAYOUT = "_layout"
_ENTRY = "epoch int, batches bigint, file_batches bigint"


def write_batches(rows: DataFrame, path: str, file_batches: int = FILE_BATCHES, batches: int | None = None) -> None:
    """Write rows with ``epoch, batch, place`` into a new folder: one file for each ``file_batches`` batches of an epoch.

    Rows lie in their file by batch and place. They are shuffled once, by the file that they go to. An epoch of more than
    ``MOST_FILES`` such files has a multiple of ``file_batches`` batches in each, as many folders of a few rows cost more than
    their rows; the layout has the number, and Parquet's statistics skip the other batches of a file. ``batches`` is the
    number of batches of the longest epoch, counted here where it is not given. The layout is entered when all files are
    there; a folder without it, of a job that stopped, is not read.
    """
    if file_batches < 1:
        raise ValueError("file_batches must be at least 1")
    if batches is None:
        batches = (rows.agg(F.max("batch")).first()[0] or 0) + 1
    file_batches *= max(1, -(-batches // (file_batches * MOST_FILES)))
    laid = rows.withColumn("epoch", F.col("epoch").cast("int")).withColumn(
        "part", F.floor(F.col("batch") / F.lit(file_batches)).cast("bigint"))
    order = ["epoch", "part", "batch", "place"]
    laid.repartition("epoch", "part").sortWithinPartitions(*order).write.partitionBy("epoch", "part").parquet(path)
    # Read back, batch column only: counting the rows themselves would run their job again.
    spark = rows.sparkSession
    written = spark.read.schema(laid.select("batch", "epoch", "part").schema).parquet(path)
    last = written.groupBy("epoch").agg((F.max("batch") + 1).cast("bigint").alias("batches"))
    entries = last.withColumn("file_batches", F.lit(file_batches).cast("bigint"))
    entries.coalesce(1).write.parquet(f"{path}/{_LAYOUT}")


def batch_counts(spark: SparkSession, path: str) -> DataFrame:
    """``epoch, batches, file_batches`` of a finished layout."""
    return spark.read.schema(_ENTRY).parquet(f"{path}/{_LAYOUT}")


def read_batches(spark: SparkSession, path: str, epoch: int, first: int = 0, last: int | None = None) -> DataFrame:
    """The rows of the batches ``first`` to ``last`` (included; none: to the end) of an epoch.

    Only files that hold one of them are opened, and in these Parquet's statistics skip row groups of other batches. Rows
    come without an order between files. An epoch that is not there has no rows; batches beyond the last have none either.
    """
    entry = batch_counts(spark, path).filter(F.col("epoch") == epoch).first()
    rows = spark.read.parquet(path) if entry is None else spark.read.option("basePath", path).parquet(f"{path}/epoch={epoch}")
    if entry is None:
        return rows.drop("part").limit(0)
    last = entry["batches"] - 1 if last is None else last
    size = entry["file_batches"]
    return rows.filter(F.col("part").between(first // size, last // size) & F.col("batch").between(first, last)).drop("part")
