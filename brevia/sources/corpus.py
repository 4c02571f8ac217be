"""Reading (article, abstract) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from brevia.operators.joins import fits_broadcast, skew_join
from brevia.operators.numbering import rank_rows
from brevia.session import stage

CORPUS_COLUMNS = ("id_articles", "articles", "abstracts")
NULL_MODES = ("strict", "literal", "drop")
MALFORMED = "malformed record"
MISSING_TEXT = "missing text in column"


def read_corpus(
    spark: SparkSession, path: str, fmt: str = "parquet", columns: tuple[str, ...] = CORPUS_COLUMNS,
    path_column: str | None = None, **options: str,
) -> DataFrame:
    """Read the named columns, every one as a string and without type inference.

    A column that is not there is an error. CSV columns are found by the header's names, in whatever order they stand;
    quoted texts may hold line breaks, and quotes in them are doubled. ``path_column`` adds the file of each row.
    """
    if fmt == "csv":
        options = {"header": "true", "multiLine": "true", "escape": '"', "inferSchema": "false", **options}
    reader = spark.read.options(**options).format(fmt)
    if fmt == "json":
        reader = reader.schema(T.StructType([T.StructField(name, T.StringType()) for name in columns]))
    names = [F.col(name).cast("string").alias(name) for name in columns]
    found = [F.col("_metadata.file_path").alias(path_column)] if path_column else []
    return reader.load(path).select(*names, *found)


def read_records(
    spark: SparkSession, path: str, fmt: str, columns: tuple[str, ...] = CORPUS_COLUMNS, required: tuple[str, ...] = (),
    **options: str,
) -> DataFrame:
    """Every record of the files: the named columns as strings, ``file``, ``raw`` and ``error``.

    A record that cannot be read has its own text in ``raw`` and no columns: a line that is no JSON object, or a CSV row with
    more or fewer fields than the header. One that lacks a ``required`` text has what was read. Neither stops the job. All CSV
    files of a path have the same header. Records of parquet can always be read.
    """
    taken = {c.lower() for c in columns}
    raw = next(name for name in ("_raw", "__raw", "___raw") if name not in taken)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        plain = {"header": "true", "multiLine": "true", "escape": '"', "inferSchema": "false", **options}
        names = spark.read.options(**plain).csv(path).columns
        # Without pruning every row is parsed in full, whichever columns are asked for.
        reader = reader.options(**plain, enforceSchema="false", columnPruning="false")
    elif fmt == "json":
        names = list(columns)
        reader = reader.options(**options)
    else:
        names, reader = None, reader.options(**options)
    if names is not None:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", raw).schema(
            T.StructType([T.StructField(name, T.StringType()) for name in (*names, raw)]))
    found = reader.load(path)
    broken = F.col(raw).cast("string") if names is not None else F.lit(None).cast("string")
    values = [F.when(broken.isNull(), F.col(name).cast("string")).alias(name) for name in columns]
    error = F.when(broken.isNotNull(), F.lit(MALFORMED))
    for name in required:
        error = error.when(F.col(name).isNull(), F.lit(f"{MISSING_TEXT} {name}"))
    return found.select(*values, F.col("_metadata.file_path").alias("file"), broken.alias("raw"), error.alias("error"))


def read_checked(
    spark: SparkSession, path: str, fmt: str, columns: tuple[str, ...] = CORPUS_COLUMNS, required: tuple[str, ...] = (),
    **options: str,
) -> tuple[DataFrame, DataFrame]:
    """The good rows of ``read_records``, and those with an error together with their file, own text and cause.

    Every record is in one of the two. The files are parsed once; the records are staged for it.
    """
    found = stage(read_records(spark, path, fmt, columns, required, **options), "records")
    good = found.filter(F.col("error").isNull()).select(*columns)
    return good, found.filter(F.col("error").isNotNull())


def project_corpus(
    df: DataFrame, key: str = "id_articles", article: str = "articles", abstract: str = "abstracts",
    key_type: str = "bigint",
) -> DataFrame:
    """Keep the key, the article and the abstract; the key replaces pairing by row order.

    ``key_type`` is ``string`` for ids of any form. Ids may repeat: later operators keep such rows apart.
    """
    return df.select(
        F.col(key).cast(key_type).alias("doc_id"), F.col(article).alias("articles"), F.col(abstract).alias("abstracts")
    )


def apply_null_policy(df: DataFrame, mode: str, columns: tuple[str, ...] = ("articles", "abstracts")) -> DataFrame:
    """``strict`` fails on a missing text, ``literal`` writes ``nan`` for it, ``drop`` removes the row."""
    if mode not in NULL_MODES:
        raise ValueError(f"mode must be one of {NULL_MODES}, not {mode!r}")
    if mode == "drop":
        return df.na.drop(subset=list(columns))
    instead = {
        "strict": lambda name: F.raise_error(F.lit(f"missing text in column {name}")).cast("string"),
        "literal": lambda name: F.lit("nan"),
    }[mode]
    return df.withColumns({name: F.coalesce(F.col(name), instead(name)) for name in columns})


def start_number(path: Column) -> Column:
    """Number in a file name: its part before the first dot, second field between underscores."""
    file_name = F.element_at(F.split(path, "/", -1), -1)
    stem = F.split_part(file_name, F.lit("."), F.lit(1))
    return F.split_part(stem, F.lit("_"), F.lit(2)).cast("bigint")


def number_rows(df: DataFrame, order_by: str, path: str, start: int | None = None, name: str = "num") -> DataFrame:
    """Number the rows of each file in key order from the number its name carries, or from ``start``.

    A file may hold most rows, so no file is handled by one task: rows are ranked over all files at once, and the
    lowest rank of each file is taken off. The rows are laid out anew for it, so pass the columns that are needed only.
    """
    ranked = rank_rows(df, [F.col(path), F.col(order_by)], "_rank")
    first = ranked.groupBy(path).agg(F.min("_rank").alias("_first"))
    base = F.lit(start).cast("bigint") if start is not None else start_number(F.col(path))
    placed = skew_join(ranked, first, [path], [order_by], fits_broadcast(first, (path,)))
    return placed.select(*df.columns, (base + F.col("_rank") - F.col("_first")).alias(name))


def read_numbered(
    spark: SparkSession, path: str, fmt: str = "parquet", columns: tuple[str, ...] = CORPUS_COLUMNS, name: str = "num",
    start: int | None = None, **options: str,
) -> DataFrame:
    """The named columns as strings, and for each row its place in its file added to the number in the file's name, or to
    ``start``.

    Parquet files know the place of each row, so nothing is sorted or shuffled. Rows of text files are ranked by file, the
    start of their split and their order in it.
    """
    base = F.lit(start).cast("bigint") if start is not None else start_number(F.col("_metadata.file_name"))
    if fmt == "parquet":
        names = [F.col(c).cast("string").alias(c) for c in columns]
        found = spark.read.options(**options).parquet(path)
        return found.select(*names, (base + F.col("_metadata.row_index")).alias(name))
    if fmt == "csv":
        options = {"header": "true", "multiLine": "true", "escape": '"', "inferSchema": "false", **options}
    reader = spark.read.options(**options).format(fmt)
    if fmt == "json":
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    rows = reader.load(path).select(
        *(F.col(c).cast("string").alias(c) for c in columns), base.alias("_base"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_place"))
    ranked = rank_rows(stage(rows, "lines"), [F.col("_file"), F.col("_split"), F.col("_place")], "_rank")
    first = ranked.groupBy("_file").agg(F.min("_rank").alias("_first"))
    placed = skew_join(ranked, first, ["_file"], ["_rank"], fits_broadcast(first, ("_file",)))
    return placed.select(*columns, (F.col("_base") + F.col("_rank") - F.col("_first")).alias(name))


def corpus_size(df: DataFrame) -> DataFrame:
    """Number of documents."""
    return df.agg(F.count(F.lit(1)).alias("documents"))


def length_stats(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Count, least, largest, mean and median of each length column.

    Lengths are counted first, so the median is taken over distinct lengths and not over rows.
    """
    sides = F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), length.cast("bigint").alias("length")) for side, length in columns.items()
    ]))
    counts = df.select(sides.alias("s")).groupBy("s.side", "s.length").agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows")
    return counts.groupBy("side").agg(
        total.alias("documents"),
        F.min("length").alias("shortest"),
        F.max("length").alias("longest"),
        (F.sum(F.col("length") * F.col("rows")) / total).alias("mean_length"),
        F.percentile("length", 0.5, F.col("rows")).alias("median_length"),
    )
