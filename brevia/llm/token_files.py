"""Token ids as binary files: Huffman-coded from global counts, in ascending order of the documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from brevia.llm.huffman import BLOCK_IDS, MOST_BITS, Code, code_lengths, pack, unpack
from brevia.llm.word_tokenizer import tokenizer
from brevia.session import stage

# Documents are encoded in groups of about this many characters, and packed and unpacked in groups of so many ids.
TEXT_GROUP = 1 << 22
GROUP = 1 << 20
_CODE, _DOCS, _PARTS = "code", "documents", "parts"


def _groups(sizes: list[int], limit: int = GROUP) -> Iterator[slice]:
    """Slices of neighbours of about ``limit`` together; a larger one stands alone."""
    start, total = 0, 0
    for at, size in enumerate(sizes):
        if at > start and total + size > limit:
            yield slice(start, at)
            start, total = at, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def _binaries(ids: np.ndarray, sizes: np.ndarray, width: int) -> pa.Array:
    """Sequences laid end to end as an array of little-endian unsigned ids of so many bytes."""
    ends = np.concatenate([[0], width * sizes.cumsum()]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(f"<u{width}"))])


def token_ids(
    docs: DataFrame, tokenizer_path: str, end_id: int, text: str = "text", doc_id: str = "doc_id", counted: bool = False,
    width: int = 4,
) -> DataFrame:
    """(doc_id, ids): ids of each whole text and the end id, little-endian unsigned, ``width`` bytes each; a null text is
    empty.

    With ``counted`` the rows have a third column, null but for one more row of each task: it holds the counts of all ids in
    the task's texts, little-endian signed 64 bit, in the order of the ids.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokenizer(tokenizer_path, end_id)
        names = ["doc_id", "ids", "counts"] if counted else ["doc_id", "ids"]
        counts = np.zeros(0, np.int64)
        for batch in batches:
            texts = batch.column("text")
            for group in _groups(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), TEXT_GROUP):
                ids, sizes = codec.encode(texts[group.start:group.stop])
                columns = [batch.column("doc_id")[group.start:group.stop], _binaries(ids, sizes, width)]
                if counted:
                    found = np.bincount(ids, minlength=len(counts))
                    found[: len(counts)] += counts
                    counts = found
                    columns.append(pa.nulls(len(sizes), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)
        if counted:
            one = pa.array([counts.astype("<i8").tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), one], names)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, ids binary" + (", counts binary" if counted else ""))


def _summed(found: DataFrame) -> DataFrame:
    return found.groupBy("id").agg(F.sum("count").alias("count"))


def unpacked_counts(counts: DataFrame) -> DataFrame:
    """(id, count) over all rows of ``counts``, as ``token_ids`` writes them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                found = np.frombuffer(raw.as_py(), "<i8")
                used = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[used])], ["id", "count"])

    return _summed(counts.mapInArrow(work, "id bigint, count bigint"))


def id_counts(ids: DataFrame, width: int = 4) -> DataFrame:
    """(id, count) over all rows of ``ids``; each task sends one row for each id it has seen."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            raws = batch.column("ids").to_pylist()
            for group in _groups([len(raw) // width for raw in raws]):
                found = np.bincount(np.frombuffer(b"".join(raws[group]), f"<u{width}"), minlength=len(counts))
                found[: len(counts)] += counts
                counts = found
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "count"])

    return _summed(ids.select("ids").mapInArrow(work, "id bigint, count bigint"))


def write_tokens(ids: DataFrame, path: str, most_bits: int = MOST_BITS, counts: DataFrame | None = None, width: int = 4) -> None:
    """Write rows (doc_id, ids) to a new folder, in ascending order of doc_id; ids are ``width`` bytes each.

    The folder holds ``code`` (id and code length: the canonical code follows from them), ``documents`` (one row each with
    the number of ids, the Huffman-coded payload and its checkpoints, in range partitions sorted by doc_id) and ``parts``
    (the ids before each partition). Rows are written by Spark, so a lost task leaves no half file. Null ids come first;
    documents of one id stand in the order of a hash of their ids. ``ids`` is read more than once: stage it. ``counts``
    (id, count) are those of all its ids where they are known. Ids are laid out before they are packed, so that each is
    packed once.

    Only the counts, at most one for each id of the vocabulary, pass the driver.
    """
    spark = ids.sparkSession
    found = (id_counts(ids, width) if counts is None else counts).collect()
    totals = np.zeros(max((row["id"] for row in found), default=-1) + 1, np.int64)
    for row in found:
        totals[row["id"]] = row["count"]
    lengths = code_lengths(totals, max(most_bits, (len(found) - 1).bit_length()))
    rows = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(rows, "id bigint, bits int").coalesce(1).write.parquet(f"{path}/{_CODE}")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, before = Code(lengths), TaskContext.get().partitionId(), 0
        for batch in batches:
            raws = batch.column("ids").to_pylist()
            for group in _groups([len(raw) // width for raw in raws]):
                some = raws[group]
                sizes = np.array([len(raw) // width for raw in some], np.int64)
                ends = sizes.cumsum()
                payloads, points = pack(code, np.frombuffer(b"".join(some), f"<u{width}").astype(np.int64), ends)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[group.start:group.stop], pa.array(sizes), pa.array(payloads, pa.binary()),
                     pa.array(points, pa.list_(pa.int64())), pa.array(np.full(len(sizes), part)), pa.array(before + ends - sizes)],
                    ["doc_id", "n_tokens", "payload", "checkpoints", "part", "before"],
                )
                before += int(ends[-1])

    fields = "doc_id bigint, n_tokens bigint, payload binary, checkpoints array<bigint>, part bigint, before bigint"
    rows = ids.select("doc_id", "ids", F.xxhash64("ids").alias("tie"))
    laid = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids")
    laid.select("doc_id", "ids").mapInArrow(encode, fields).write.parquet(f"{path}/{_DOCS}")
    sizes = spark.read.parquet(f"{path}/{_DOCS}").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).collect()
    base, parts = 0, []
    for row in sorted(sizes, key=lambda r: r["part"]):  # one row for each partition written
        parts.append((row["part"], base))
        base += row["n_tokens"]
    spark.createDataFrame(parts, "part bigint, base bigint").coalesce(1).write.parquet(f"{path}/{_PARTS}")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from a folder of ``write_tokens``: start counts the ids of all documents before.

    Each file split is decoded by itself, in groups of documents, each from its checkpoints. ``ids`` is little-endian
    unsigned 32 bit.
    """
    found = spark.read.parquet(f"{path}/{_CODE}").collect()
    lengths = np.zeros(max((row["id"] for row in found), default=-1) + 1, np.int64)
    for row in found:
        lengths[row["id"]] = row["bits"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        table = code.table()
        for batch in batches:
            counts = batch.column("n_tokens").to_numpy()
            for group in _groups(counts.tolist()):
                some, size = counts[group], group.stop - group.start
                part = batch.slice(group.start, size)
                points = [np.asarray(p, np.int64) for p in part.column("checkpoints").to_pylist()]
                ids = unpack(table, code.bits, part.column("payload").to_pylist(), points, some).astype("<u4")
                ends = np.cumsum(some)
                raws = pa.array([ids[e - n:e].tobytes() for n, e in zip(some, ends)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("doc_id", "part", "before", "n_tokens")] + [raws],
                    ["doc_id", "part", "before", "n_tokens", "ids"],
                )

    rows = spark.read.parquet(f"{path}/{_DOCS}").mapInArrow(
        decode, "doc_id bigint, part bigint, before bigint, n_tokens bigint, ids binary"
    )
    # One row for each partition written.
    return rows.join(F.broadcast(spark.read.parquet(f"{path}/{_PARTS}")), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids"
    )


def write_documents(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, text: str = "text", doc_id: str = "doc_id"
) -> None:
    """Encode and write all documents; the ids are staged, as they are counted first and packed after, in two bytes where
    the vocabulary allows it."""
    width = 2 if max(end_id, tokenizer(tokenizer_path, end_id).most_id) < 1 << 16 else 4
    found = stage(token_ids(docs, tokenizer_path, end_id, text, doc_id, counted=True, width=width), "ids")
    counts = unpacked_counts(found.select("counts").filter(F.col("counts").isNotNull()))
    write_tokens(found.filter(F.col("counts").isNull()).select("doc_id", "ids"), path, counts=counts,
                 width=width)
