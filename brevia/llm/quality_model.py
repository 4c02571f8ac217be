"""Quality of documents, learnt from labels over statistics of their texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from brevia.llm.boosted_trees import Forest, Settings, train
from brevia.llm.common import fresh, others

# The forest is fitted on at most this many labelled rows, those whose ids have the smallest hashes.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
SYMBOLS = b"#*$%&|<>"
FEATURES = (
    "log_chars", "log_words", "word_length", "longest_word", "symbols_a_word", "marks_a_word", "bars_a_word",
    "upper_share", "digit_share", "punctuation_share", "high_byte_share", "distinct_words", "top_word_share",
    "repeated_neighbours", "distinct_pairs", "lines", "words_a_line", "distinct_lines", "lines_ended", "stops_a_word",
    "longest_line_share",
)
_STOPS = tuple(map(ord, ".!?"))
_MARKS = frozenset(b"!\"'(),-./:;?@[\\]^_`{}~")


def statistics(text: str | None) -> list[float]:
    """The features of a whole text; of a null text those of an empty one, all finite."""
    raw = (text or "").encode()
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    n, size, rows = max(len(words), 1), max(len(raw), 1), max(len(lines), 1)
    counts = Counter(words)
    pairs = max(len(words) - 1, 1)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), len(raw) / n, max(map(len, words), default=0),
        sum(seen[c] for c in SYMBOLS) / n, seen[ord("!")] / n, seen[ord("|")] / n,
        seen[65:91].sum() / size, seen[48:58].sum() / size, sum(seen[c] for c in _MARKS) / size, seen[128:].sum() / size,
        len(counts) / n, max(counts.values(), default=0) / n, sum(map(eq, words, words[1:])) / pairs,
        len(set(zip(words, words[1:]))) / pairs, np.log1p(len(lines)), len(words) / rows, len(set(lines)) / rows,
        sum(line.rstrip()[-1] in _STOPS for line in lines) / rows, sum(seen[c] for c in _STOPS) / n,
        max(map(len, lines), default=0) / size,
    ]


def features(text: Column) -> Column:
    """array<double> of the statistics of each text."""

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.array(statistics(text), np.float64) for text in batch], dtype=object)

    return of(text)


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
    sample: int = SAMPLE_ROWS, settings: Settings = Settings(),
) -> Forest:
    """A forest over the statistics of labelled documents.

    ``labels`` has (doc_id, label of 0 or 1); rows with a null in either are left out, and of several labels of one id
    the mean decides, 1 if it is a half or more. The ``sample`` labelled ids with the smallest hashes among those that
    have a document are taken, and of their documents, if ids repeat, as many again by the hash of the text. The ids are
    chosen before any text is read, and sent to the texts: a sample of that size is all that is broadcast or collected.
    Texts without words are documents like any other.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).dropna().groupBy("doc_id").agg(
        (F.avg("label") >= 0.5).cast("int").alias("label")
    )
    there = known.join(docs.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi")
    ids = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids), "doc_id")
    chosen = rows.select(
        F.xxhash64("doc_id", "text").alias("hash"), "label", features(F.col("text")).alias("features")
    ).orderBy("hash", "label", "features").limit(sample).collect()
    matrix = np.array([row["features"] for row in chosen], np.float64).reshape(len(chosen), len(FEATURES))
    return train(matrix, np.array([row["label"] for row in chosen]), settings)


def score(df: DataFrame, forest: Forest, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with score (0 to 1, higher: label 1 likelier) and predicted (1 from ``threshold``).

    Input columns of these names are replaced. The text is the only input; null counts as empty. Rows are scored one by
    one in Arrow batches, without a shuffle; equal texts get equal scores.
    """

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = np.array([statistics(text) for text in batch], np.float64).reshape(len(batch), len(FEATURES))
            yield pd.Series(np.concatenate([forest.scores(part) for part in np.array_split(rows, len(rows) // 1024 + 1)]))

    value = fresh(df, "value_")[0]
    passed = others(df, "score", "predicted")
    return df.withColumn(value, of(F.col(text))).select(
        *passed, F.col(value).alias("score"), (F.col(value) >= threshold).cast("int").alias("predicted")
    )
