"""Session settings and staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, tempfile.TemporaryDirectory] = {}
_shipped: set[str] = set()
_restaged: dict[int, tuple[DataFrame, str]] = {}


def local_session(cpus: int | str = "*", app: str = "brevia", memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and local benchmarks. On a cluster the submitted session is used as it is."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    settings = {
        "spark.ui.enabled": "false",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_modules(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once an application, for sessions started without them."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Where it is unset a temporary folder stands in, but only for a local master: there is one machine then.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.TemporaryDirectory(prefix="brevia-")
    return _local_folders[context.applicationId].name


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; everything of one application lies under one folder."""
    base = shared_folder(spark).rstrip("/")
    return f"{base}/brevia/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, by Spark's own or another ``compression``, and read it back.

    Used where a plan must be cut or a result is read more than once. A written table survives lost executors,
    is computed once, and gives the optimiser its true size.
    """
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def restage(df: DataFrame, name: str, old: DataFrame | None = None) -> DataFrame:
    """``stage`` for a table that replaces an earlier one: the files of ``old``, itself a result of this function, are
    removed once the new ones are written. Only for tables that nothing else reads."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.parquet(path)
    new = spark.read.schema(df.schema).parquet(path)
    _restaged[id(new)] = (new, path)
    if old is not None:
        discard(old)
    return new


def discard(old: DataFrame) -> None:
    """Remove the files of a result of ``restage`` that nothing reads any more."""
    if id(old) in _restaged:
        _, gone = _restaged.pop(id(old))
        spark = old.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(gone)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition a bare scan by ``key`` when it has too few splits to use the cluster.

    A wide scan is returned as it is, without a shuffle. A narrow one is small by that very fact: fewer splits than
    cores, each at most ``spark.sql.files.maxPartitionBytes``. Grouping by ``key`` later needs no further shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)
