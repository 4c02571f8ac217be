"""Encoding corpus files as they arrive."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brevia.functions.sequences import pad_truncate
from brevia.functions.text import tokenise
from brevia.operators.encoding import encode
from brevia.session import discard, restage

MISSING = "missing text"
NO_ID = "missing id"
REPEATED = "repeated id"
# Texts of one id that a task holds before it names them as repeated; rows without id are spread over so many groups.
HELD = 1000
_SPREAD = 1024
_ID, _NONE = "=", "-"
_QUERY_ID = "sql.streaming.queryId"
_MARKED = "key STRING, articles STRING, digest BIGINT, error STRING"


def _folder(spark: SparkSession, path: str) -> None:
    """Make a folder where there is none, so that it can be read as a stream from the start."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)


def stored_keys(spark: SparkSession, sink: str, key_type: str = "bigint") -> DataFrame:
    """The ids and text digests in the sink as a stream of its files: a query reads each file once, whoever wrote it."""
    _folder(spark, sink)
    reader = spark.readStream.schema(f"doc_id {key_type}, digest BIGINT").option("ignoreMissingFiles", "true")
    return reader.parquet(sink).select("doc_id", "digest")


def mark_group(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The rows of one id, each with its error; the one without is taken, and its digest becomes the state.

    An id is taken once. Of several texts in one micro-batch the least counts, whatever their order; the others are named as
    repeated, but for copies of the text that was taken, which is there already. Beyond ``HELD`` different texts of one id in
    a micro-batch a copy of what the sink holds may be named too.
    """
    taken = state.get[0] if state.exists else None
    known, best, others = taken is not None, None, {}

    def marked(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *row) for row in rows], columns=["key", "articles", "digest", "error"])

    for frame in frames:
        out = []
        for text, digest, stored in zip(frame["articles"], frame["digest"], frame["stored"]):
            if stored:
                taken, known = digest, True
            elif text is None:
                out.append((None, digest, MISSING))
            elif key[0].startswith(_NONE):
                out.append((text, digest, NO_ID))
            elif best is None:
                best = (text, digest)
            elif digest != best[1]:
                best, (other, other_digest) = min(best, (text, digest)), max(best, (text, digest))
                others[other_digest] = other
        if len(others) > HELD:
            out += [(text, digest, REPEATED) for digest, text in others.items()]
            others = {}
        if out:
            yield marked(out)
    out = [(text, digest, REPEATED) for digest, text in others.items() if digest != taken]
    if best is not None and not known:
        taken = best[1]
        out.append((*best, None))
    elif best is not None and best[1] != taken:
        out.append((*best, REPEATED))
    if taken is not None and not state.exists:
        state.update((int(taken),))
    if out:
        yield marked(out)


def marked_rows(source: DataFrame, sink: str) -> DataFrame:
    """``key, articles, digest, error`` for a stream of ``doc_id, articles``: what is to be encoded, and what is left out.

    The ids that were taken are keyed state, in Spark's state store: a micro-batch looks up its own ids only, however many
    there are. What other runs have written to the sink, before or meanwhile, comes in as a stream of its own.
    """
    spark = source.sparkSession
    spread = F.pmod(F.xxhash64("articles"), F.lit(_SPREAD)).cast("string")
    key = F.coalesce(F.concat(F.lit(_ID), F.col("doc_id").cast("string")), F.concat(F.lit(_NONE), spread))
    new = source.select(key.alias("key"), "articles", F.xxhash64("articles").alias("digest"), F.lit(False).alias("stored"))
    stored = stored_keys(spark, sink, source.schema["doc_id"].dataType.simpleString()).select(
        F.concat(F.lit(_ID), F.col("doc_id").cast("string")).alias("key"),
        F.lit(None).cast("string").alias("articles"), F.coalesce("digest", F.lit(0)).alias("digest"), F.lit(True).alias("stored"))
    return new.unionByName(stored).groupBy("key").applyInPandasWithState(
        mark_group, _MARKED, "digest BIGINT", "append", GroupStateTimeout.NoTimeout)


def encode_batch(
    batch: DataFrame, number: int, vocab: DataFrame, sink: str, failures: str, length: int, cap: int, mode: str, run: str,
    key_type: str = "bigint",
) -> None:
    """Encode the taken rows of one micro-batch (``marked_rows``) to the sink; the others go to ``failures`` with text and
    cause.

    Each micro-batch owns one folder, named by its run and number, and replaces nothing else: a replay after a crash writes
    the same rows again. Nothing is written where there are no rows. The micro-batch is staged, as it is read twice.
    """
    arrived = restage(batch, "arrived")
    folder = f"run={run}/batch={number}"
    doc_id = F.when(F.col("key").startswith(_ID), F.expr(f"substring(key, {len(_ID) + 1})")).cast(key_type)
    rows = arrived.select(doc_id.alias("doc_id"), "articles", "digest", "error")
    taken, failed = rows.filter(F.col("error").isNull()), rows.filter(F.col("error").isNotNull())
    if not taken.isEmpty():
        tokens = taken.select("doc_id", "digest", tokenise(F.col("articles"), mode).alias("tokens"))
        ids = encode(tokens, vocab, length, cap, carry=("digest",)).withColumn("ids", pad_truncate(F.col("ids"), length))
        ids.select("doc_id", "digest", "ids").write.mode("overwrite").parquet(f"{sink}/{folder}")
    if not failed.isEmpty():
        failed.select("doc_id", "articles", "error").write.mode("overwrite").parquet(f"{failures}/{folder}")
    discard(arrived)


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """Name of the run: Spark's id of the query, which a checkpoint keeps over restarts and a new one gets anew."""
    query = spark.sparkContext.getLocalProperty(_QUERY_ID)
    return hashlib.md5(f"{checkpoint}|{query or ''}".encode()).hexdigest()


def encode_stream(
    source: DataFrame, vocab: DataFrame, sink: str, failures: str, checkpoint: str, length: int, cap: int = -1,
    mode: str = "filters", **trigger: Any,
) -> StreamingQuery:
    """Start encoding a stream of ``doc_id, articles`` with a saved vocabulary.

    Every row that arrives is in the sink or, with its text and a cause, in ``failures``: a missing text, a missing id, or
    another text for an id that has one. A copy of a row in the sink is there already. Runs with checkpoints of their own
    may share a sink, one after the other; of two at the same time each may take an id that neither has seen.

    The state holds one number for each id. For many ids set ``spark.sql.streaming.stateStore.providerClass`` to Spark's
    RocksDB provider, which keeps it on disk.
    """
    key_type = source.schema["doc_id"].dataType.simpleString()

    def write(batch: DataFrame, number: int) -> None:
        run = _run_id(batch.sparkSession, checkpoint)
        encode_batch(batch, number, vocab, sink, failures, length, cap, mode, run, key_type)

    writer = marked_rows(source, sink).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
