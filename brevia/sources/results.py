"""Result, failure and report tables, and restart against what is already written."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Tags of the two texts of a result and the width of its number.
GOLD_TAG = "encoder"
GENERATED_TAG = "decoder"
NUMBER_WIDTH = 6

# Each run writes a folder of its own, named by this column, and is then entered in the manifest beside the folders.
RUN = "run_id"
_MANIFEST = "_runs"
_ENTRY = "run_id string, number bigint, columns string, replaces array<string>"
_PAIR = "num bigint, tag string, text string, name string"
_FAILURE = "num bigint, name string, doc string, gold string, error string"


def padded_number(num: Column) -> Column:
    """Zero-padded to six digits; longer numbers stay whole."""
    text = num.cast("string")
    return F.when(F.length(text) >= NUMBER_WIDTH, text).otherwise(F.lpad(text, NUMBER_WIDTH, "0"))


def pair_rows(df: DataFrame, num: str = "num", gold: str = "gold", generated: str = "generated") -> DataFrame:
    """Two rows per result, one for each text, named by number and tag."""
    pairs = F.explode(F.array(
        F.struct(F.lit(GOLD_TAG).alias("tag"), F.col(gold).alias("text")),
        F.struct(F.lit(GENERATED_TAG).alias("tag"), F.col(generated).alias("text")),
    ))
    rows = df.select(F.col(num).alias("num"), pairs.alias("p")).select("num", "p.tag", "p.text")
    return rows.withColumn("name", F.concat(padded_number(F.col("num")), F.lit("_"), F.col("tag"), F.lit(".txt")))


def _committed(spark: SparkSession, path: str) -> list[Row]:
    """Manifest entries of the runs that count: those that were written to their end and not compacted since.

    The manifest has one entry a run. No folder yet means no run; other faults are not hidden.
    """
    try:
        entries = spark.read.schema(_ENTRY).option("recursiveFileLookup", "true").parquet(f"{path}/{_MANIFEST}")
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    replaced = entries.select(F.explode("replaces").alias(RUN))
    return entries.join(replaced, RUN, "left_anti").orderBy("number", RUN).collect()


def _write_run(df: DataFrame, path: str, partition: tuple[str, ...] = (), replaces: list[Row] | None = None) -> None:
    """Write ``df`` as a run and commit it. A run that stops before its commit leaves a folder that no one reads.

    Folders are named at random, so runs at the same time touch no file of each other. A run is later than all that
    were committed before it; of two that are committed together the greater name counts as the later one. A run that
    ``replaces`` others takes their place in the order.
    """
    if RUN in df.columns:
        raise ValueError(f"{RUN} is the column that names the run")
    spark, run = df.sparkSession, uuid.uuid4().hex
    df.write.partitionBy(*partition).parquet(f"{path}/{RUN}={run}")
    earlier = _committed(spark, path) if replaces is None else replaces
    number = max((entry["number"] for entry in earlier), default=0) + (replaces is None)
    entry = (run, number, df.schema.json(), [entry[RUN] for entry in replaces or ()])
    spark.createDataFrame([entry], _ENTRY).coalesce(1).write.parquet(f"{path}/{_MANIFEST}/{run}")


def _stored(spark: SparkSession, path: str, runs: list[Row]) -> DataFrame:
    """The rows of some runs with their place in the order; columns that an earlier run did not have are null there.

    Only the folders of these runs are listed, and no footer is read for the columns.
    """
    fields = {}
    for columns in dict.fromkeys(entry["columns"] for entry in runs):
        for field in StructType.fromJson(json.loads(columns)):
            if fields.setdefault(field.name, field).dataType != field.dataType:
                raise ValueError(f"runs in {path} differ in the type of {field.name}")
    schema = StructType([*fields.values(), StructField(RUN, StringType())])
    rows = spark.read.schema(schema).option("basePath", path).parquet(*(f"{path}/{RUN}={entry[RUN]}" for entry in runs))
    order = spark.createDataFrame([(entry[RUN], entry["number"]) for entry in runs], f"{RUN} string, _number bigint")
    return rows.join(order, RUN)


def _latest(stored: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the last run for each key."""
    rest = [c for c in stored.columns if c not in (*keys, RUN, "_number")]
    last = stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_number", RUN, *rest)).alias("_row"))
    return last.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def _read(spark: SparkSession, path: str, keys: list[str], empty: str) -> DataFrame:
    runs = _committed(spark, path)
    return _latest(_stored(spark, path, runs), keys) if runs else spark.createDataFrame([], empty)


def _compact(spark: SparkSession, path: str, keys: list[str], partition: tuple[str, ...] = ()) -> int:
    """Put the last rows of all committed runs in one run; the number of runs that it replaces.

    Runs that are committed meanwhile stay. Readers that have begun still find the replaced folders, which may be removed
    once these have ended.
    """
    runs = _committed(spark, path)
    if len(runs) > 1:
        _write_run(_latest(_stored(spark, path, runs), keys), path, partition, runs)
    return len(runs) if len(runs) > 1 else 0


def write_pairs(df: DataFrame, path: str) -> None:
    """Write the texts of all results, one folder per tag. A text written again replaces the earlier one."""
    write_texts(pair_rows(df), path)


def write_texts(rows: DataFrame, path: str) -> None:
    """Write rows ``num, tag, text, name`` as a run of its own."""
    _write_run(rows, path, ("tag",))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``num, tag, text, name``: one row for each number and tag, that of the last committed run. None where no run is."""
    return _read(spark, path, ["num", "tag"], _PAIR)


def compact_pairs(spark: SparkSession, path: str) -> int:
    """Replace the runs of a folder of texts by one with the rows that count."""
    return _compact(spark, path, ["num", "tag"], ("tag",))


def split_failures(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without an error and rows with one."""
    good = df.filter(F.col(error).isNull()).drop(error)
    bad = df.filter(F.col(error).isNotNull())
    return good, bad


def failure_rows(bad: DataFrame, num: str = "num", doc: str = "articles", gold: str = "gold") -> DataFrame:
    """Number, text, gold summary and error of each failed document."""
    return bad.select(
        F.col(num).alias("num"), padded_number(F.col(num)).alias("name"), F.col(doc).alias("doc"),
        F.col(gold).alias("gold"), "error",
    )


def write_failures(bad: DataFrame, path: str) -> None:
    """Write the failure table. A document that fails again replaces its earlier row."""
    _write_run(bad, path)


def read_failures(spark: SparkSession, path: str, done: DataFrame | None = None) -> DataFrame:
    """One row for each failed number, the one written last; without those that ``done`` holds both texts of by now."""
    latest = _read(spark, path, ["num"], _FAILURE)
    return latest if done is None else latest.join(finished(done), "num", "left_anti")


def finished(done: DataFrame) -> DataFrame:
    """Numbers for which both texts exist."""
    has = {tag: F.max(F.col("tag") == tag) for tag in (GOLD_TAG, GENERATED_TAG)}
    return done.groupBy("num").agg(*[there.alias(tag) for tag, there in has.items()]).filter(
        F.col(GOLD_TAG) & F.col(GENERATED_TAG)
    ).select("num")


def pending(df: DataFrame, done: DataFrame) -> DataFrame:
    """Documents that do not have both texts yet."""
    return df.join(finished(done), "num", "left_anti")


def compact_failures(spark: SparkSession, path: str) -> int:
    """Replace the runs of a failure table by one with the rows that count."""
    return _compact(spark, path, ["num"])


def write_metrics(report: DataFrame, path: str) -> None:
    """Add report rows as a run."""
    _write_run(report, path)


def read_metrics(spark: SparkSession, path: str, keys: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """One row for each epoch (and step, if ``keys`` names it): an epoch that ran again replaces its earlier row."""
    runs = _committed(spark, path)
    if not runs:
        raise ValueError(f"no run was committed in {path}")
    return _latest(_stored(spark, path, runs), list(keys))
