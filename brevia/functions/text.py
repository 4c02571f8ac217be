"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from brevia.constants import FILTER_CHARS, START_WORD, STOP_WORD

# Fixed value: what Python's str.split() takes as white space, as a Java pattern.
WHITE_SPACE = r"(?U)[\s\x1c-\x1f]+"


def filter_mode(filters: bool, no_filters: bool) -> str:
    """Exactly one of the two modes must be chosen."""
    if filters == no_filters:
        raise ValueError("choose exactly one of filters and no_filters")
    return "filters" if filters else "no_filters"


def _filter_chars(mode: str) -> str:
    if mode not in FILTER_CHARS:
        raise ValueError(f"mode must be one of {sorted(FILTER_CHARS)}, not {mode!r}")
    return FILTER_CHARS[mode]


def wrap_target(text: Column) -> Column:
    """Put the start and stop words around a summary."""
    return F.concat(F.lit(START_WORD + " "), text, F.lit(" " + STOP_WORD))


def strip_chars(text: Column, mode: str = "filters") -> Column:
    """Turn each filter character into a space."""
    chars = _filter_chars(mode)
    return F.translate(text, chars, " " * len(chars))


def tokenise(text: Column, mode: str = "filters") -> Column:
    """Lower-case, strip, split on single spaces, drop empty items. Other white space stays inside a token."""
    return F.array_remove(F.split(strip_chars(F.lower(text), mode), " ", -1), "")


def char_length(text: Column) -> Column:
    """Length in characters, not tokens."""
    return F.length(text)


def white_space_words(text: Column) -> Column:
    """Words as Python's argument-less split gives them."""
    return F.array_remove(F.split(text, WHITE_SPACE, -1), "")


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring items, joined by a space."""
    if n < 1:
        raise ValueError("n must be at least 1")
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - F.lit(n - 1), F.lit(0)))
    return F.transform(
        starts, lambda first, at: F.concat_ws(" ", first, *[F.get(words, at + F.lit(i)) for i in range(1, n)])
    )
