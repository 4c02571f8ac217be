"""Byte-level BPE with the tiktoken library and a local file of ranks."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F

from brevia.llm.common import fresh

# Texts longer than this are split at safe boundaries, in pieces of about this many characters.
CHUNK_CHARS = 1 << 16
# Bytes of texts that are encoded before their ids are handed back to Spark.
GROUP = 1 << 22
# No match of a pattern holds white space after something else, and none looks back: a text may be cut before a space
# or line break that follows another character, and the matches of the parts are those of the whole.
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")
# How patterns of this family end. A run of white space is then one match, without its last character if text follows: the
# library would walk back over the run and give up on a long one, so these are found here.
RUNS = r"|\s+(?!\S)|\s+"
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a file of lines "base64 rank", without special tokens; read once in each Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Parts of a text that can be encoded one by one; a part without safe boundary stays whole."""
    start = 0
    while len(text) - start > size:
        cut = _BOUNDARY.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def _around_runs(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of a text, and for each whether it is a long match of white space."""
    start = 0
    for found in _LONG_RUN.finditer(text):
        end = found.end() if found.end() == len(text) else found.end() - 1
        if found.start() > start:
            yield text[start:found.start()], False
        yield text[found.start():end], True
        start = end
    if start < len(text) or not text:
        yield text[start:], False


def ids_of(codec: tiktoken.Encoding, text: str, size: int = CHUNK_CHARS) -> np.ndarray:
    """The ids of a whole text. Patterns that end in ``RUNS`` may meet white space of any length."""
    if not codec._pat_str.endswith(RUNS):
        parts = [codec.encode_to_numpy(part, disallowed_special=()) for part in chunks(text, size)]
    else:
        parts = []
        for piece, run in _around_runs(text):
            if run:
                parts.append(np.array(codec._encode_single_piece(piece), np.uint32))
            else:
                parts += [codec.encode_to_numpy(part, disallowed_special=()) for part in chunks(piece, size)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _slices(sizes: Iterable[int], limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of about ``limit`` together, so that a task never holds the ids of a whole Arrow batch twice."""
    start = total = at = 0
    for at, size in enumerate(sizes, start=1):
        total += size
        if total >= limit:
            yield start, at
            start, total = at, 0
    if at > start or at == 0:
        yield start, at


def _id_lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    ids = np.concatenate([np.empty(0, np.uint32), *found]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))


def _encode(codec: tiktoken.Encoding, batches: Iterator[pa.Array], size: int) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        for start, end in _slices(pc.fill_null(pc.binary_length(batch), 0).to_pylist()):
            yield [ids_of(codec, text.as_py() or "", size) for text in batch[start:end]]


def encoded(text: Column, path: str, pattern: str, size: int = CHUNK_CHARS) -> Column:
    """array<int> of the ids of each text; of a null text as of an empty one, no ids."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found in _encode(encoding(path, pattern), batches, size):
            yield _id_lists(found)

    return encode(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The raw bytes of each array of ids, null for null; an id without rank stops the job.

    Bytes, not text: ids cut from a longer sequence may end inside a character.
    """

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = encoding(path, pattern)
        for batch in batches:
            yield pa.array([None if not row.is_valid else codec.decode_bytes(row.as_py()) for row in batch], pa.binary())

    return decode(ids)


def round_trip(text: Column, path: str, pattern: str, size: int = CHUNK_CHARS) -> Column:
    """A struct (ids, raw) for each text: its ids, and the bytes decoded from them, by one Python worker."""

    @F.arrow_udf("ids array<int>, raw binary")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = encoding(path, pattern)
        for found in _encode(codec, batches, size):
            raw = pa.array([codec.decode_bytes(ids.tolist()) for ids in found], pa.binary())
            yield pa.StructArray.from_arrays([_id_lists(found), raw], ["ids", "raw"])

    return both(text)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with the ids of the whole of ``text`` in ``ids``, a column that is replaced if there. Rows are taken one by
    one: repeated rows stay, and an empty table stays empty."""
    return df.withColumn(ids, encoded(F.col(text), path, pattern))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", raw: str = "raw") -> DataFrame:
    """The rows with the bytes of ``ids`` in ``raw``, a column that is replaced if there; repeated rows stay, and an empty
    table stays empty."""
    return df.withColumn(raw, decoded(F.col(ids), path, pattern))


def encode_and_decode(
    df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", raw: str = "raw"
) -> DataFrame:
    """The rows with the ids of ``text`` and the bytes of these ids, as ``encode`` and ``decode`` after it give."""
    found = fresh(df, "found_")[0]
    return df.withColumn(found, round_trip(F.col(text), path, pattern)).withColumns(
        {ids: F.col(f"{found}.ids"), raw: F.col(f"{found}.raw")}).drop(found)
