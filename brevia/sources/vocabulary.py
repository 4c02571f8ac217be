"""Saving and loading vocabularies, one per side and cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

VOCABULARY_SCHEMA = "token STRING, token_id INT, n BIGINT, df BIGINT, side STRING, cap INT"


def write_vocab(vocab: DataFrame, path: str, side: str, cap: int) -> None:
    """Write one side's vocabulary into its own ``side``/``cap`` folder, replacing an earlier one there."""
    folder = f"{path.rstrip('/')}/side={side}/cap={cap}"
    vocab.select("token", "token_id", "n", "df").write.mode("overwrite").parquet(folder)


def read_vocab(spark: SparkSession, path: str, side: str, cap: int) -> DataFrame:
    """Read one side's vocabulary; the filter prunes the other folders."""
    stored = spark.read.schema(VOCABULARY_SCHEMA).parquet(path)
    return stored.filter((F.col("side") == side) & (F.col("cap") == cap)).select("token", "token_id", "n", "df")
