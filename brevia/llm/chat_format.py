"""Conversations as marked text with a loss mask, checked by reading the text back."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

# A turn is "### Role: text" and a line of its own with the end mark. Roles other than these are written as JSON.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
START, END = "###", "</turn>"
# A conversation's text is cut between turns into parts of about this many characters; nearly all have one part.
PART_CHARS = 4_000_000
# A run of backslashes is looked at from its start only and never given back, so that a long one costs its length once.
_CONTROL = re.compile(r"(?<!\\)(\\*+)(###|</turn>)")
_HEADER = re.compile(r'### (System|User|Assistant|null|"(?:[^"\\]|\\.)*"): ', re.DOTALL)
_NAMES = {shown: role for role, shown in ROLES.items()}


class GrammarError(ValueError):
    """A text that is not a sequence of turns."""


def escape(text: str) -> str:
    """One more backslash before each control string, whatever the number there already."""
    return _CONTROL.sub(lambda found: "\\" + found.group(), text)


def unescape(text: str) -> str:
    """The text without one backslash before each control string that has any."""
    return _CONTROL.sub(lambda found: found.group()[1:] if found.group(1) else found.group(), text)


def _header(role: str | None) -> str:
    shown = ROLES.get(role) or ("null" if role is None else json.dumps(role, ensure_ascii=False))
    return f"{START} {shown}: "


def parse(formatted: str) -> Iterator[tuple[str | None, str, int, int]]:
    """(role, text, start, end) of each turn; start and end are where its text stands, escaped, in code points.

    One pass and no guess: a header, then text up to the first control string without backslash, which must be an end mark
    on a line of its own.
    """
    at = 0
    while at < len(formatted):
        header = _HEADER.match(formatted, at)
        if header is None:
            raise GrammarError(f"no header at {at}")
        shown = header.group(1)
        role = json.loads(shown) if shown.startswith('"') or shown == "null" else _NAMES[shown]
        mark = next((m for m in _CONTROL.finditer(formatted, header.end()) if not m.group(1)), None)
        if mark is None or mark.group(2) != END or formatted[mark.start() - 1] != "\n" or mark.start() == header.end() or (
            formatted[mark.end():mark.end() + 1] != "\n"
        ):
            raise GrammarError(f"no end of the turn at {at}")
        end = mark.start() - 1
        yield role, unescape(formatted[header.end():end]), header.end(), end
        at = mark.end() + 1


def render(role: str | None, text: str) -> tuple[str, int, int]:
    """(turn, start, end of its text): the text as it is if that reads back alike, else escaped, and read back again."""
    header = _header(role)
    for body in (text, escape(text)):
        turn = f"{header}{body}\n{END}\n"
        try:
            if [found[:2] for found in parse(turn)] == [(role, text)]:
                return turn, len(header), len(header) + len(body)
        except GrammarError:
            continue
    raise GrammarError("a turn does not read back")


def _parts(rows: Iterable[tuple], size: int, learnt: str) -> Iterator[dict]:
    """Rows (conv_id, role, text), turns of a conversation together and in order, to parts."""
    key, part, texts, chars, turns, spans = None, 0, [], 0, 0, []

    def closed() -> dict:
        return {"conv_id": key, "part": part, "formatted": "".join(texts), "n_turns": turns, "spans": spans}

    for conv_id, role, text in rows:
        if texts and (conv_id != key or chars >= size):
            yield closed()
            part = part + 1 if conv_id == key else 0
            texts, chars, turns, spans = [], 0, 0, []
        key = conv_id
        turn, start, end = render(role, text or "")
        if role == learnt:
            spans.append({"start": chars + start, "end": chars + end})
        texts.append(turn)
        chars += len(turn)
        turns += 1
    if texts:
        yield closed()


def _streamed(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in names))


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = PART_CHARS) -> Iterator[pa.RecordBatch]:
    """Record batches of rows with at most about ``size`` characters of text each."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row.get("formatted", "")) + 64
        if chars >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def format_conversations(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    learnt: str = "assistant", part_chars: int = PART_CHARS,
) -> DataFrame:
    """Rows (conv_id, part, formatted, n_turns, spans): the text of each conversation and its loss mask.

    Turns stand in the order of ``turn`` (null first), ties in that of role and text; repeated rows are turns of their
    own. A null text is empty, a null role is a role of its own, and rows without id make one conversation. ``spans`` are
    the code points of the texts to learn, those of the role ``learnt``, counted inside the part. Every turn is read back
    as it is written, and escaped if it would not be the same.

    A conversation is one sequence, so one task writes it, turn by turn: rows are dealt out by id and sorted by Spark,
    which spills, and the task holds one part at a time, however long the conversation. A part ends after a turn once it
    has ``part_chars`` characters. Other columns are left out.
    """
    key = df.schema[conv_id].dataType
    schema = StructType([
        StructField("conv_id", key), StructField("part", LongType()), StructField("formatted", StringType()),
        StructField("n_turns", LongType()), StructField("spans", ArrayType(StructType([
            StructField("start", LongType()), StructField("end", LongType())]))),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        out = pa.schema([
            ("conv_id", first.schema.field("conv_id").type), ("part", pa.int64()), ("formatted", pa.string()),
            ("n_turns", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ])
        rows = _streamed((b for some in ([first], batches) for b in some), ("conv_id", "role", "text"))
        yield from _batches(_parts(rows, part_chars, learnt), out, part_chars)

    rows = df.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(work, schema)
