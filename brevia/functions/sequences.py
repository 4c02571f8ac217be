"""Column functions over arrays of ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from brevia.constants import PADDING_ID, UNKNOWN_ID


def pad_truncate(ids: Column, length: int | Column) -> Column:
    """Keep the first ``length`` ids and fill the tail with padding."""
    kept = F.slice(ids, F.lit(1), F.lit(length).cast("int"))
    missing = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    return F.concat(kept, F.array_repeat(F.lit(PADDING_ID), missing)).cast("array<int>")


def whole_length(ids: Column, parts: int) -> Column:
    """The length of a sequence rounded up to a multiple of ``parts``, at least one of each."""
    return (F.greatest(F.ceil(F.size(ids) / F.lit(parts)), F.lit(1)) * F.lit(parts)).cast("int")


def pad_whole(ids: Column, parts: int) -> Column:
    """All ids, padded so that they divide into equal parts."""
    return pad_truncate(ids, whole_length(ids, parts))


def padding_mask(ids: Column) -> Column:
    """1.0 where the id is padding, else 0.0."""
    return F.transform(ids, lambda x: F.when(x == PADDING_ID, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float"))


def valid_length(ids: Column) -> Column:
    """Number of ids that are not padding."""
    return F.size(F.array_remove(ids, PADDING_ID))


def unknown_count(ids: Column) -> Column:
    """Number of unknown words in a sequence."""
    return F.size(ids) - F.size(F.array_remove(ids, UNKNOWN_ID))


def shift_input(ids: Column) -> Column:
    """All ids but the last."""
    return F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))


def shift_label(ids: Column) -> Column:
    """All ids but the first."""
    return F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))


def chunk_step(length: int, chunks: int) -> int:
    """Size of one slice; the length must divide evenly."""
    if chunks < 1 or length % chunks:
        raise ValueError(f"length {length} is not divisible into {chunks} equal chunks")
    return length // chunks


def split_chunks(values: Column, length: int | None, chunks: int) -> Column:
    """Cut an array of ``length`` values (ids or mask) into equal neighbouring slices.

    Without a length each array is cut by its own, which must divide evenly too.
    """
    if length is not None:
        step = F.lit(chunk_step(length, chunks))
    else:
        uneven = F.raise_error(F.lit(f"a length is not divisible into {chunks} equal chunks")).cast("int")
        step = F.when(F.size(values) % chunks == 0, (F.size(values) / F.lit(chunks)).cast("int")).otherwise(uneven)
    return F.array(*[F.slice(values, F.lit(i) * step + 1, step) for i in range(chunks)])


def chunk_number(pos: Column, step: int | Column) -> Column:
    """Which slice a position falls into."""
    return F.floor(pos / F.lit(step)).cast("int")


def chunk_position(pos: Column, step: int | Column) -> Column:
    """The position inside its slice, from 0 in each one."""
    return (pos % F.lit(step)).cast("int")


def step_size(length: int, steps: int) -> int:
    """Curriculum increment, halves rounded to even."""
    return round(length / steps)


def step_size_column(length: Column, steps: Column) -> Column:
    """``step_size`` over columns."""
    return F.bround(length / steps, 0).cast("int")


def prefix_keep(ids: Column, step: Column, size: int | Column) -> Column:
    """Keep the first ``step * size`` ids, pad the rest."""
    kept = F.least(step * F.lit(size), F.size(ids)).cast("int")
    return F.concat(
        F.slice(ids, F.lit(1), kept), F.array_repeat(F.lit(PADDING_ID), (F.size(ids) - kept).cast("int"))
    ).cast("array<int>")


def first_position(ids: Column, wanted: Column | int) -> Column:
    """Position, from 0, of the first ``wanted`` id; NULL where there is none."""
    at = F.array_position(ids, wanted)
    return F.when(at > 0, (at - 1).cast("int"))


def cut_summary(ids: Column, stop: Column | int) -> Column:
    """Drop position 0 and end before the first stop; keep the whole tail where there is none."""
    end = F.coalesce(first_position(ids, stop), F.size(ids))
    return F.slice(ids, F.lit(2), F.greatest(end - 1, F.lit(0)).cast("int"))
