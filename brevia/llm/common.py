"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brevia.session import ship_modules

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# Rows and bytes of an Arrow batch, in place of Spark's defaults: a task holds some batches of texts at a time.
_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b"),
}


def ship_package(spark: SparkSession) -> None:
    """``ship_modules``; Arrow batches of texts are made smaller than Spark's defaults, settings of the user's own left alone."""
    for name, (default, smaller) in _BATCHES.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, smaller)
    ship_modules(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with a column of ``df``, whatever its case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` except these, whatever their case."""
    left_out = {name.lower() for name in names}
    return [c for c in df.columns if c.lower() not in left_out]


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def crc32_mod(value: Column, modulus: int) -> Column:
    """Remainder of the CRC-32 of a value written as text; null for null."""
    return F.pmod(F.crc32(F.encode(value.cast("string"), "UTF-8")), F.lit(modulus))
