"""Word counts and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brevia.constants import FIRST_WORD_ID, UNKNOWN_WORD
from brevia.operators.numbering import rank_rows
from brevia.session import stage

# First-seen order packs document and position into one BIGINT, which keeps the aggregation a hash aggregation.
_POSITION_BITS = 24
# The same for numbered ids: an array has no more positions than these.
_WIDE_POSITION_BITS = 31

# Words that may meet in one task for ranking.
ONE_TASK_WORDS = 4_000_000
_BUCKETS_PER_DOUBLING = 8


def _packed(doc: Column, pos: Column, position_bits: int) -> Column:
    fits = (doc >= 0) & (doc < F.lit(1 << (63 - position_bits))) & (pos < F.lit(1 << position_bits))
    packed = F.shiftleft(doc.cast("bigint"), position_bits).bitwiseOR(pos.cast("bigint"))
    too_large = F.raise_error(F.lit("document id or position too large to pack, pass wide=True")).cast("bigint")
    return F.when(fits, packed).otherwise(too_large)


def is_wide(tokens: DataFrame, key: str = "doc_id") -> bool:
    """Whether ids are no whole numbers."""
    return tokens.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long")


def number_ids(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``df`` with its ids replaced by their places, from 0, among all different ids in order; rows of one id share a place."""
    ids = rank_rows(df.select(F.col(key).alias("_id")).distinct(), [F.col("_id")], "_place", start=0)
    placed = df.join(ids, F.col(key).eqNullSafe(F.col("_id")))
    return placed.withColumn(key, F.col("_place")).drop("_id", "_place")


def word_stats(
    tokens: DataFrame, key: str = "doc_id", words: str = "tokens", wide: bool | None = None, numbered: bool = False
) -> DataFrame:
    """Per word: occurrences ``n``, documents ``df`` and its ``first`` appearance by (document, position).

    Each document is one row, so its distinct words are listed behind its words and both are counted in one
    aggregation by word. Only per-task word counts are shuffled. ``wide`` puts the places of the ids in for them, which keeps
    the aggregation a hash aggregation: always for keys that are not whole numbers, and to be asked for where ids are
    negative or need more than 39 bits. ``numbered`` tells that the caller has done so with ``number_ids``.
    """
    wide = is_wide(tokens, key) if wide is None else wide
    if wide and not numbered:
        tokens = number_ids(tokens.select(key, words), key)
    listed = tokens.select(
        F.col(key).alias("_doc"),
        F.size(words).alias("_size"),
        F.posexplode(F.concat(F.col(words), F.array_distinct(words))).alias("_pos", "token"),
    )
    is_word = F.col("_pos") < F.col("_size")
    place = _packed(F.col("_doc"), F.col("_pos"), _WIDE_POSITION_BITS if wide or numbered else _POSITION_BITS)
    return listed.groupBy("token").agg(
        F.count_if(is_word).alias("n"),
        F.count_if(~is_word).alias("df"),
        F.min(F.when(is_word, place)).alias("first"),
    )


def distinct_words(tokens: DataFrame, key: str = "doc_id", words: str = "tokens") -> DataFrame:
    """The words of each document, each once."""
    return tokens.select(F.col(key), F.explode(F.array_distinct(words)).alias("token"))


def _reducers(df: DataFrame) -> int:
    """Most partitions an aggregation may have."""
    conf = df.sparkSession.conf
    partitions = conf.get("spark.sql.shuffle.partitions")
    return max(int(partitions), int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", partitions)))


def _frequent(words: DataFrame, wanted: int) -> DataFrame:
    """The words frequent enough to be among the ``wanted`` first, and few more.

    Counts are put into fine logarithmic buckets, of which at most a few hundred exist, and the lowest bucket needed is
    read off their sizes.
    """
    bucket = F.floor(F.log2("n") * F.lit(_BUCKETS_PER_DOUBLING)).cast("int")
    sizes = words.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("words")).collect()
    lowest, found = 0, 0
    for size in sorted(sizes, key=lambda row: -row["bucket"]):
        lowest, found = size["bucket"], found + size["words"]
        if found >= wanted:
            break
    return words.filter(bucket >= lowest)


def rank_vocab(stats: DataFrame, cap: int = -1) -> DataFrame:
    """Ids from 2 by falling count, ties by first appearance; with a cap only ids below it.

    Id 1 is reserved for the unknown word: that word itself is never ranked. A small cap is a top-k, in which each
    partition sends at most ``cap`` words to one task. Where those would be too many, words too rare for the cap are
    left out first and the rest, or without a cap all words, are numbered in parallel.
    """
    if cap != -1 and cap < FIRST_WORD_ID:
        raise ValueError("the cap must be -1 or at least 2")
    real = stats.filter(F.col("token") != UNKNOWN_WORD)
    order = [F.col("n").desc(), F.col("first")]
    if cap != -1 and cap * _reducers(stats) <= ONE_TASK_WORDS:
        top = real.orderBy(*order).limit(cap - FIRST_WORD_ID)
        ranked = top.withColumn("token_id", F.row_number().over(Window.orderBy(*order)) + F.lit(FIRST_WORD_ID - 1))
    elif cap != -1:
        frequent = _frequent(stage(real, "words"), cap - FIRST_WORD_ID)
        ranked = rank_rows(frequent, order, "token_id", start=FIRST_WORD_ID).filter(F.col("token_id") < cap)
    else:
        ranked = rank_rows(real, order, "token_id", start=FIRST_WORD_ID)
    return ranked.select("token", F.col("token_id").cast("int").alias("token_id"), "n", "df")


def fit_vocab(
    tokens: DataFrame, cap: int = -1, key: str = "doc_id", words: str = "tokens", wide: bool | None = None
) -> DataFrame:
    """Count, rank and stage a vocabulary: fitted once, read by every later encode."""
    return stage(rank_vocab(word_stats(tokens, key, words, wide), cap), "vocab")


def vocab_size(vocab: DataFrame, cap: int = -1) -> DataFrame:
    """The cap where there is one, even if fewer words exist; else all words, the unknown word and padding."""
    if cap != -1:
        return vocab.sparkSession.range(1).select(F.lit(cap).cast("bigint").alias("vocab_size"))
    return vocab.agg((F.count(F.lit(1)) + F.lit(FIRST_WORD_ID)).alias("vocab_size"))
