"""Line-first cleaning: failing lines go, then documents that lost too much text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from brevia.llm.common import fresh, others

SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", "»", "›", "•", "·")
# Lines that are nothing but one of these, whatever their case.
NAVIGATION = (
    "home", "menu", "login", "log in", "sign in", "sign up", "register", "search", "contact", "contact us", "about us",
    "next", "previous", "back to top", "read more", "share", "sitemap",
)
# Lines that contain one of these, whatever their case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "this work is licensed", "released under the", "privacy policy",
    "terms of use", "terms of service", "we use cookies", "cookie policy", "enable javascript", "lorem ipsum",
)
RULES = ("punctuation", "navigation", "boilerplate", "repetition")
WINDOW = 8
_WHITE = b" \t\n\x0b\x0c\r"
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_NAVIGATION = frozenset(NAVIGATION)
_SEPARATORS = frozenset(s.encode() for s in SEPARATORS)


@dataclass(frozen=True)
class Rules:
    """Limits of the rules.

    A line fails on punctuation if it has three symbols or more and over ``symbols`` a word, or over ``shouts`` runs of
    two exclamation marks a word, or three words or more all in capitals. It fails as navigation if at least ``separators``
    of its words are separators. It fails on repetition with four words or more, over ``stutter`` of them like the one
    before. A document fails if its failing lines hold over ``loss`` of its characters.
    """

    symbols: float = 0.5
    shouts: float = 1 / 3
    separators: float = 0.25
    stutter: float = 0.5
    loss: float = 0.5


def failure(line: str, rules: Rules) -> str | None:
    """The rule that a line with a word fails, a name of ``RULES``; None if it passes."""
    raw = line.encode()
    words = raw.split()
    separators = sum(word in _SEPARATORS for word in words)
    if separators and separators >= rules.separators * len(words):
        return "navigation"
    symbols = len(raw) - len(raw.translate(None, SYMBOLS.encode()))
    if symbols >= 3 and symbols > rules.symbols * len(words) or line.count("!!") > rules.shouts * len(words):
        return "punctuation"
    if len(words) >= 3 and line.upper() == line != line.lower():
        return "punctuation"
    if len(words) >= 4 and sum(map(eq, words, words[1:])) > rules.stutter * len(words):
        return "repetition"
    low = line.lower()
    if low.strip(" \t\r.:>»") in _NAVIGATION:
        return "navigation"
    return "boilerplate" if _BOILERPLATE.search(low) else None


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words (a power of two) that occur twice or more.

    Windows are numbered by doubling: two numbered halves make a pair, and equal pairs get one number. So they are
    compared exactly, in a few sorts of the text.
    """
    n = len(words)
    if n <= width or len(set(words)) == n:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    span = 1
    while span < width:
        pairs = ids[:-span] * (ids.max() + 1) + ids[span:]
        values, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(values) == len(pairs):
            return 0
        span *= 2
    starts = np.flatnonzero(counts[ids] > 1)
    edges = np.zeros(n + 1, np.int64)
    edges[starts] += 1
    edges[starts + width] -= 1
    return int(np.count_nonzero(np.cumsum(edges)))


def assess(text: str | None, rules: Rules = Rules()) -> dict:
    """Counts, cleaned text, characters and lines lost by rule, and the verdict of one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = text.split("\n")
    lost = dict.fromkeys(RULES, 0)
    kept, written, chars, gone = [], [], 0, 0
    for line in lines:
        if not line.strip(" \t\n\x0b\x0c\r"):
            kept.append(line)
            continue
        written.append(line)
        chars += len(line)
        rule = failure(line, rules)
        if rule is None:
            kept.append(line)
        else:
            lost[rule] += 1
            gone += len(line)
    repeated = repeated_words(words)
    base_failed = len(words) < 20 or 100 * repeated > 30 * len(words)
    return {
        "n_words": len(words),
        "word_chars": len(text) - (len(raw) - len(raw.translate(None, _WHITE))),
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS.encode())),
        "n_dup_lines": len(written) - len(set(written)),
        "n_repeat_words": repeated,
        "base_failed": base_failed,
        "kept": not base_failed and gone <= rules.loss * chars,
        "cleaned": "\n".join(kept),
        "chars_lost": gone,
        **lost,
    }


_FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "kept boolean, cleaned string, chars_lost bigint, punctuation bigint, navigation bigint, boilerplate bigint, repetition bigint"
)
NAMES = tuple(field.split()[0] for field in _FIELDS.split(", "))


def assessed(text: Column, rules: Rules = Rules()) -> Column:
    """A struct of what ``assess`` finds for each text."""

    @F.pandas_udf(_FIELDS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([assess(text, rules) for text in batch], columns=list(NAMES))

    return of(text)


def apply_rules(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """All rows with the columns of ``assess``; input columns of these names are replaced.

    ``cleaned`` is the text without its failing lines, blank lines kept; ``kept`` says whether the document stays: it has
    20 words or more, at most 30 % of them in repeated windows, and lost at most ``rules.loss`` of the characters of its
    lines. A null text counts as empty and fails. Rows are judged one by one: repeats get equal verdicts, nothing is
    shuffled, and a task holds one Arrow batch.
    """
    found = fresh(df, "found_")[0]
    passed = others(df, *NAMES)
    return df.withColumn(found, assessed(F.col(text), rules)).select(*passed, F.col(f"{found}.*"))
