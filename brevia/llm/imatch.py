"""I-Match fingerprints: hashes of a document's terms inside randomised subsets of a lexicon of middling frequency."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from brevia.llm.common import ship_package
from brevia.session import stage

# The lexicon: terms in at most the first and at least the second share of all documents, a band of inverse document
# frequency. It holds fewer terms than the mean of distinct terms a document over the least share, however many documents.
MOST_SHARE = 0.05
LEAST_SHARE = 0.0002
# A fingerprint has one hash for the whole lexicon and, for each of these shares of it, one for each of so many subsets.
SHARES = tuple(2.0**-level for level in range(2, 13))  # each half of the one before
DRAWS = 12
SEED = 11
# Terms a task counts before it hands the counts on.
HELD_TERMS = 1 << 18
_SUBSETS = 1 + DRAWS * len(SHARES)
_SPACED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_TOP = 54 + int(np.log2(SHARES[0]))
_DRAW_SEEDS = np.random.default_rng(SEED).integers(1, 1 << 63, DRAWS, dtype=np.uint64)[:, None] | np.uint64(1)


def terms(text: str | None) -> set[bytes]:
    """The distinct terms of a text: in lower case, runs of ASCII letters and digits and of all characters beyond ASCII."""
    return set((text or "").lower().encode().translate(_SPACED).split())


def _keys(words: Iterable[bytes]) -> np.ndarray:
    return np.array([*map(xxhash.xxh3_64_intdigest, words)], np.uint64)


def _levels(keys: np.ndarray) -> np.ndarray:
    """For each draw (row) and term the number of subsets that hold it: those of a draw lie one in the other."""
    mixed = (keys ^ _DRAW_SEEDS) * _DRAW_SEEDS
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    _, exponent = np.frexp((mixed >> np.uint64(11)).astype(np.float64))  # a number below 2**exponent, of 53 bits
    return np.clip(_TOP - exponent, 0, len(SHARES))


def _digests(keys: np.ndarray) -> np.ndarray:
    """The hash of each subset, 0 if it holds none of the keys; ``keys`` stand in the order of their terms."""
    found = np.zeros(_SUBSETS, np.uint16)
    if not len(keys):
        return found
    levels = _levels(keys)
    draw, term = levels.nonzero()
    levels = levels[draw, term]
    ends = levels.cumsum()
    first = draw * len(SHARES) + 1 - (ends - levels)
    subset = (np.arange(len(first) and ends[-1]) + first.repeat(levels)).astype(np.uint16)
    members = keys[term.repeat(levels)[subset.argsort(kind="stable")]]
    sizes = np.bincount(subset, minlength=_SUBSETS)
    some = sizes.nonzero()[0]
    end = 8 * sizes[some].cumsum()
    data, digest = memoryview(members.tobytes()), xxhash.xxh3_64_intdigest
    found[some] = [digest(data[s:e]) % 0xFFFF + 1 for s, e in zip((end - 8 * sizes[some]).tolist(), end.tolist())]
    found[0] = digest(keys.tobytes()) % 0xFFFF + 1
    return found


def fingerprint(text: str | None, lexicon: np.ndarray) -> bytes:
    """The hashes of a text's lexicon terms, two bytes each; ``lexicon`` holds the sorted keys of its terms.

    A text without a lexicon term is hashed by all its terms, so that it still equals its copies; one without any term has
    zeros only.
    """
    keys = _keys(sorted(terms(text)))
    if len(keys) and len(lexicon):
        kept = lexicon[np.minimum(np.searchsorted(lexicon, keys), len(lexicon) - 1)] == keys
        keys = keys[kept] if kept.any() else keys
    return _digests(keys).astype(">u2").tobytes()


def likeness(one: bytes, other: bytes) -> float:
    """How alike two fingerprints are, from 0 to 1: the share of equal hashes among the subsets that hold a term of either.

    A subset so large that it always holds a term says little beside one that holds a few, so the subsets of a share weigh
    what part of them is empty in both. Where none is empty all weigh alike. Equal fingerprints are 1 alike, also those
    without terms.
    """
    if one == other:
        return 1.0
    a, b = (np.frombuffer(f, ">u2") for f in (one, other))
    some = (a != 0) | (b != 0)
    equal = some & (a == b)
    each_some, each_equal = (v[1:].reshape(DRAWS, len(SHARES)).sum(axis=0) for v in (some, equal))
    weights = DRAWS - each_some
    total = float(weights @ each_some)
    return float(weights @ each_equal) / total if total else float(equal.sum()) / max(1, int(some.sum()))


def document_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(key, found): the 64-bit key of each term and the number of rows that hold it. Tasks send sums, not rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def counted() -> pa.RecordBatch:
            keys, found = _keys(held).view(np.int64), np.fromiter(held.values(), np.int64, len(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(found)], ["key", "found"])

        for batch in batches:
            for value in batch.column(0):
                held.update(terms(value.as_py()))
                if len(held) > HELD_TERMS:
                    yield counted()
        yield counted()

    texts = df.select(F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull())
    return texts.mapInArrow(work, "key bigint, found bigint").groupBy("key").agg(F.sum("found").alias("found"))


def fit_lexicon(
    df: DataFrame, text: str = "text", most_share: float = MOST_SHARE, least_share: float = LEAST_SHARE
) -> np.ndarray:
    """The sorted keys of the terms in at most ``most_share`` and at least ``least_share`` of all rows, null texts among them.

    Only these keys reach the driver: fewer than the mean of distinct terms a row over ``least_share``, eight bytes each.
    """
    ship_package(df.sparkSession)
    rows = df.count()
    band = document_counts(df, text).filter(F.col("found").between(least_share * rows, most_share * rows))
    keys = band.select("key").toArrow().column("key").combine_chunks().to_numpy(zero_copy_only=False)
    return np.sort(keys.astype(np.int64).view(np.uint64))


def fingerprints(df: DataFrame, lexicon: np.ndarray, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The rows with the fingerprint of the whole of ``text``, as hexadecimal digits, in ``name``, a column that is replaced
    if there.

    Equal texts have equal fingerprints, a null text that of an empty one. Rows are taken one by one and nothing is shuffled.
    """
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(value.as_py(), shared.value).hex() for value in batch], pa.string())

    return df.withColumn(name, of(F.col(text).cast("string")))


def edited_text(text: str, following: str) -> str:
    """The text with its second half, the shorter one, replaced by as much of the start of another."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_FOUND = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_KINDS = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
_FIELDS = [StructField(name, kind) for name, kind in zip(_FOUND, (
    LongType(), StringType(), BinaryType(), BinaryType(), DoubleType(), DoubleType()))]


def _compared(text: str, mark: bytes, following: str, next_mark: bytes, lexicon: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    edited_mark = fingerprint(edited, lexicon)
    return (
        len(text), hashlib.sha256(edited.encode()).hexdigest(), mark, edited_mark, likeness(mark, edited_mark),
        likeness(mark, next_mark))


def compare_edited(df: DataFrame, lexicon: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    A row's text is compared with its edited one and with the next row's in ascending order of doc_id; the first follows the
    last, so that a single row follows itself. Rows without id come first, rows of one id stand in the order of a hash of
    their text. A null text is empty.

    Texts are compressed and laid out in ranges once; each task reads its range in order with one text in hand. The last
    row of a range meets the first of the next afterwards: two rows for each partition.
    """
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(lexicon)
    key = df.schema[doc_id].dataType

    def pack_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor().compress
        for batch in batches:
            packed = pa.array([pack((value.as_py() or "").encode()) for value in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), packed], ["doc_id", "tie", "packed"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, out = TaskContext.get().partitionId(), None, []
        unpack = zstandard.ZstdDecompressor().decompress

        def rows(kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 10
            kinds = [pa.string(), pa.int64(), kind, pa.binary(), *_KINDS]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "part", "doc_id", "packed", *_FOUND])

        def edge(kind: str, one: object, packed: bytes, mark: bytes) -> tuple:
            return kind, part, one, packed, None, None, mark, None, None, None

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for one, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed"))):
                now = unpack(packed).decode()
                mark = fingerprint(now, shared.value)
                out.append(edge("first", one, packed, mark) if held is None else (
                    "whole", part, held[0], None, *_compared(held[1], held[2], now, mark, shared.value)))
                held, last = (one, now, mark), packed
            yield rows(kind)
            out.clear()
        if held is not None:
            out.append(edge("last", held[0], last, held[2]))
            yield rows(kind)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            found = [
                _compared(unpack(packed).decode(), mark, unpack(following).decode(), next_mark, shared.value)
                for packed, mark, following, next_mark in zip(*(
                    batch.column(c).to_pylist() for c in ("packed", "mark", "next_packed", "next_mark")))]
            columns = list(zip(*found)) or [()] * len(_FOUND)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, _KINDS))], ["doc_id", *_FOUND])

    whole = F.col(text).cast("string")
    rows = df.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("tie")).mapInArrow(
        pack_all, StructType([
            StructField("doc_id", key), StructField("tie", LongType()), StructField("packed", BinaryType())]))
    laid = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "packed")
    found = stage(laid.mapInArrow(work, StructType([
        StructField("kind", StringType()), StructField("part", LongType()), StructField("doc_id", key),
        StructField("packed", BinaryType()), *_FIELDS])), "fingerprints")
    firsts = found.filter("kind = 'first'")
    # One row for each partition that has rows.
    order = Window.orderBy("part")
    following = firsts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    lasts = found.filter("kind = 'last'").select("part", "doc_id", "packed", F.col("fingerprint").alias("mark")).join(
        following, "part").join(firsts.select(
            F.col("part").alias("next"), F.col("packed").alias("next_packed"), F.col("fingerprint").alias("next_mark")), "next")
    closed = lasts.select("doc_id", "packed", "mark", "next_packed", "next_mark").mapInArrow(
        close, StructType([StructField("doc_id", key), *_FIELDS]))
    both = found.filter("kind = 'whole'").select("doc_id", *_FOUND).union(closed)
    return both.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
