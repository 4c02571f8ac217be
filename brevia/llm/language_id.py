"""Language of a text: the language whose dictionary compresses the text best."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from brevia.llm.common import fresh, others

UNKNOWN = "und"
# The fitted sample: at most this many different texts of a language, one piece of each, up to the dictionary's size.
SAMPLE_TEXTS = 512
PIECE_CHARS = 1024
DICTIONARY_BYTES = 96 * 1024
# Each block of a text is compressed by itself, so that the dictionary counts for the whole of a long text.
BLOCK_BYTES = 4096
LEVEL = 6
# Short texts are compressed harder: there a few bytes decide.
SHORT_BYTES = 512
SHORT_LEVEL = 19
# A prediction is rejected if the second best language costs less than this share more than the best.
MARGIN = 0.02
# A model is sent to every task; more languages than this are an error, not cut.
MOST_LANGUAGES = 1000
_HAS_LETTER = r"\p{L}"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class LanguageModel:
    """Languages, the most frequent in the sample first, and the raw content of each one's dictionary."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]


def normalised(text: str) -> bytes:
    """The words of a text in lower case; marks and digits say nothing of a language."""
    return _NOT_LETTERS.sub(" ", text.lower()).encode("utf-8", "replace")


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Dictionaries from a bounded sample of the rows with a language and a letter in their text.

    For each language the ``SAMPLE_TEXTS`` different texts with the smallest hashes are taken, of each one piece of up to
    ``PIECE_CHARS`` at a place given by the hash, and as many pieces as fill ``DICTIONARY_BYTES``. Copies of a text count
    once, so a group of copies cannot fill a dictionary. The sample depends on the rows alone, not on their order or
    partitions. Only the hashes are shuffled, best of each task first; the pieces that reach the driver are bounded by
    the numbers above. Without usable rows the model has no language.
    """
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(_HAS_LETTER)
    ).withColumn("hash", F.xxhash64("text"))
    best = Window.partitionBy("lang").orderBy("hash")
    chosen = rows.select("lang", "hash").distinct().withColumn("place", F.row_number().over(best)).filter(
        F.col("place") <= SAMPLE_TEXTS
    ).select("lang", "hash")
    keys = [(r["lang"], r["hash"]) for r in chosen.toLocalIterator()]
    found = {k[0] for k in keys}
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"{len(found)} languages; the model is made for {MOST_LANGUAGES} at most")
    if not keys:
        return LanguageModel((), ())
    known = df.sparkSession.createDataFrame(keys, "lang string, hash bigint")
    start = F.pmod(F.col("hash"), F.greatest(F.length("text") - PIECE_CHARS, F.lit(0)) + 1).cast("int") + 1
    pieces = rows.join(F.broadcast(known), ["lang", "hash"]).select(
        "lang", "hash", F.substr("text", start, F.lit(PIECE_CHARS)).alias("piece")
    ).groupBy("lang", "hash").agg(F.min("piece").alias("piece")).collect()
    counts = dict(rows.groupBy("lang").count().collect())
    contents = {}
    for row in sorted(pieces, key=lambda r: (r["lang"], r["hash"])):
        content = contents.get(row["lang"], b"")
        if len(content) < DICTIONARY_BYTES:
            contents[row["lang"]] = content + normalised(row["piece"]) + b" "
    languages = sorted(contents, key=lambda name: (-counts[name], name))
    return LanguageModel(tuple(languages), tuple(contents[name][:DICTIONARY_BYTES] for name in languages))


def _compressors(model: LanguageModel, level: int) -> list[zstandard.ZstdCompressor]:
    found = []
    for content in model.dictionaries:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=level)
        found.append(zstandard.ZstdCompressor(
            level=level, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False
        ))
    return found


class Compressors:
    """The compressors of each language of a model."""

    def __init__(self, model: LanguageModel):
        self.languages = model.languages
        self.usual, self.short = _compressors(model, LEVEL), _compressors(model, SHORT_LEVEL)

    def sizes(self, text: str) -> list[int]:
        """Bytes of the whole text under each dictionary."""
        data = normalised(text)
        if len(data) <= SHORT_BYTES:
            return [len(c.compress(data)) for c in self.short]
        blocks = [data[i:i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(c.compress(block)) for block in blocks) for c in self.usual]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin). The score weighs a language half for each byte that it needs more than the best."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        best = min(sizes)
        score = 1 / sum(2.0 ** -min(size - best, 1000) for size in sizes)
        ordered = sorted(sizes)
        margin = (ordered[1] - best) / ordered[1] if len(ordered) > 1 else 1.0
        return self.languages[sizes.index(best)], score, margin


def predicted(text: Column, model: LanguageModel) -> Column:
    """A struct (lang, score, margin) for each text. The text is the only input."""

    @F.pandas_udf("lang string, score double, margin double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = Compressors(model)
        for batch in batches:
            yield pd.DataFrame([compressors.predict(t) for t in batch], columns=["lang", "score", "margin"])

    return of(text)


def identify(df: DataFrame, model: LanguageModel, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows with lang_pred, score (0 to 1) and accepted; input columns of these names are replaced.

    A text that is null or has no letter, and any text under a model without languages, is ``und`` with score 0 and not
    accepted. Of languages with equal sizes the most frequent wins, with margin 0. A prediction is accepted if its margin
    over the second best language reaches ``margin``; with one language it always is.
    """
    passed = others(df, "lang_pred", "score", "accepted")
    found = fresh(df, "found_")[0]
    out = df.withColumn(found, predicted(F.col(text), model))
    return out.select(
        *passed, F.col(f"{found}.lang").alias("lang_pred"), F.col(f"{found}.score").alias("score"),
        ((F.col(f"{found}.lang") != UNKNOWN) & (F.col(f"{found}.margin") >= margin)).alias("accepted"),
    )
