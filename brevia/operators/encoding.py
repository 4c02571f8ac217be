"""Words to ids and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brevia.constants import FIRST_WORD_ID, UNKNOWN_ID, UNKNOWN_WORD
from brevia.functions.sequences import unknown_count
from brevia.operators.joins import BROADCAST_BYTES, fits_broadcast, skew_join
from brevia.session import stage

# Words that may be broadcast: at most this many, and none longer than this in a part of a larger vocabulary.
BROADCAST_WORDS = 500_000
BROADCAST_WORD_BYTES = 4096
# A vocabulary of ids below this and of so many bytes is put beside every sequence as one array, to decode in place.
ARRAY_WORDS = 4096
ARRAY_BYTES = 64 * 1024


def _head(vocab: DataFrame, most_words: int | None = None) -> DataFrame:
    """The most frequent words, bounded in number and bytes whatever the vocabulary holds."""
    most_words = BROADCAST_WORDS if most_words is None else most_words
    short = vocab.filter(
        (F.col("token_id") < most_words) & (F.octet_length("token") <= BROADCAST_WORD_BYTES)
    )
    running = F.sum(F.octet_length("token")).over(Window.orderBy("token_id"))
    return short.withColumn("_bytes", running).filter(F.col("_bytes") <= BROADCAST_BYTES).drop("_bytes")


def _small(vocab: DataFrame, most_words: int | None = None) -> bool:
    """Whether a vocabulary may be broadcast as a whole."""
    limit = BROADCAST_WORDS if most_words is None else most_words
    return fits_broadcast(vocab, ("token",), limit, BROADCAST_BYTES)


def _numbered(rows: DataFrame, small: bool) -> DataFrame:
    """The rows with a number of their own in ``_row``. A large vocabulary reads them more than once: they are staged, so that
    a row has one number however its tasks are laid out when they run again."""
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    return numbered if small else stage(numbered, "numbered", "zstd")


def lookup(
    items: DataFrame, vocab: DataFrame, on: str, most_words: int | None = None, small: bool | None = None
) -> DataFrame:
    """Left join of ``items`` with the vocabulary on ``token`` or ``token_id``.

    A vocabulary that is checked to be small, at most ``most_words`` (or the default), is broadcast. A larger one is taken in two parts: its most frequent words,
    bounded in size, are broadcast, and only the items not found there are shuffled to meet the rest. Those are rare
    words, and where a frequent one is new to the vocabulary its items are split. Items without a key meet nothing and
    are not shuffled.
    """
    if _small(vocab, most_words) if small is None else small:
        return items.join(F.broadcast(vocab), on, "left")
    head = stage(_head(vocab, most_words), "head")
    tail = vocab.join(F.broadcast(head.select("token_id")), "token_id", "left_anti").select(*vocab.columns)
    # One pass over the items: the few that the head does not hold are staged and go on.
    met = items.join(F.broadcast(head.withColumn("_met", F.lit(True))), on, "left")
    rest = stage(met.filter(F.col("_met").isNull() & F.col(on).isNotNull()).select(*items.columns), "rare", "zstd")
    others = skew_join(rest, tail, [on], [name for name in items.columns if name != on], False, "left")
    return met.filter(F.col("_met").isNotNull() | F.col(on).isNull()).drop("_met").unionByName(others)


def _ids_below(vocab: DataFrame, cap: int) -> DataFrame:
    words = vocab.select("token", "token_id")
    return words if cap == -1 else words.filter(F.col("token_id") < cap)


def _packed(pos: Column, token_id: Column) -> Column:
    return F.shiftleft(pos.cast("bigint"), 32).bitwiseOR(token_id.cast("bigint"))


def _unpacked_id(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def encode_long(
    tokens: DataFrame, vocab: DataFrame, length: int | None = None, cap: int = -1,
    key: str = "doc_id", words: str = "tokens", carry: tuple[str, ...] = (), most_words: int | None = None,
) -> DataFrame:
    """One row per kept word: key, row, position from 0, id. Words outside the vocabulary or the cap get the unknown id.

    Every word gives exactly one id, so cutting the words to ``length`` before the lookup is exact and keeps the cut
    tail out of it. A document without words gives one row without position and id. ``_row`` tells rows of one key apart.
    """
    kept = F.slice(words, 1, length) if length is not None else F.col(words)
    known = _ids_below(vocab, cap)
    small = _small(known, most_words)
    numbered = _numbered(tokens.select(F.col(key), *carry, kept.alias("_words")), small)
    placed = numbered.select(key, *carry, "_row", F.posexplode_outer("_words").alias("pos", "token"))
    found = lookup(placed, known, "token", most_words, small)
    token_id = F.when(F.col("pos").isNotNull(), F.coalesce("token_id", F.lit(UNKNOWN_ID))).cast("int")
    return found.select(key, *carry, "_row", "pos", token_id.alias("token_id"))


def encode(
    tokens: DataFrame, vocab: DataFrame, length: int | None = None, cap: int = -1,
    key: str = "doc_id", words: str = "tokens", ids: str = "ids", carry: tuple[str, ...] = (),
    most_words: int | None = None,
) -> DataFrame:
    """The id sequence of each row; an empty document gives an empty sequence, and rows of one key stay apart. Columns
    named in ``carry`` come along.

    Position and id travel as one BIGINT. The map side already joins up a document's ids, so a document is shuffled as
    one row of at most ``length`` numbers, and not at all when the input is partitioned by the key.
    """
    long = encode_long(tokens, vocab, length, cap, key, words, carry, most_words)
    packed = F.sort_array(F.collect_list(_packed(F.col("pos"), F.col("token_id"))))
    return long.groupBy(key, *carry, "_row").agg(F.transform(packed, _unpacked_id).alias(ids)).drop("_row")


def encode_lengthwise(
    tokens: DataFrame, vocab: DataFrame, length: int | None = None, cap: int = -1,
    key: str = "doc_id", words: str = "tokens",
) -> DataFrame:
    """Kept words and unknown words per row, without building the sequences."""
    long = encode_long(tokens, vocab, length, cap, key, words)
    return long.groupBy(key, "_row").agg(
        F.count("token_id").alias("kept"), F.count_if(F.col("token_id") == UNKNOWN_ID).alias("unknown")
    ).drop("_row")


def _word_array(vocab: DataFrame) -> DataFrame | None:
    """One row with the words of a short vocabulary at the places of their ids; None where it is not short."""
    known = vocab.filter(F.col("token_id") >= FIRST_WORD_ID)
    size = known.agg(F.max("token_id").alias("top"), F.sum(F.octet_length("token")).alias("bytes")).first()
    if (size["top"] or 0) >= ARRAY_WORDS or (size["bytes"] or 0) > ARRAY_BYTES:
        return None
    places = known.sparkSession.range((size["top"] or 0) + 1).join(F.broadcast(known), F.col("id") == F.col("token_id"), "left")
    entries = F.sort_array(F.collect_list(F.struct("id", "token")))
    return places.agg(F.transform(entries, lambda x: x["token"]).alias("_words"))


def decode(
    sequences: DataFrame, vocab: DataFrame, cap: int = -1, key: str = "doc_id", ids: str = "ids", text: str = "text"
) -> DataFrame:
    """The text of each id sequence, words joined by a space. Padding and ids outside the vocabulary or cap give the
    unknown word. With a short vocabulary nothing is shuffled: the words are looked up by place."""
    known = _ids_below(vocab, cap)
    words = _word_array(known)
    if words is not None:
        beside = sequences.select(F.col(key), F.col(ids).alias("_ids")).crossJoin(F.broadcast(words))
        found = F.transform("_ids", lambda i: F.coalesce(F.get("_words", i), F.lit(UNKNOWN_WORD)))
        return beside.select(key, F.coalesce(F.array_join(found, " "), F.lit("")).alias(text))
    small = _small(known)
    numbered = _numbered(sequences.select(F.col(key), F.col(ids).alias("_ids")), small)
    placed = numbered.select(key, "_row", F.posexplode_outer("_ids").alias("pos", "token_id"))
    # Reserved ids are never in the vocabulary; without a key they are not looked up.
    placed = placed.withColumn("token_id", F.when(F.col("token_id") >= FIRST_WORD_ID, F.col("token_id")))
    found = lookup(placed, known, "token_id", small=small)
    token = F.coalesce("token", F.lit(UNKNOWN_WORD))
    entries = F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", token.alias("token"))))
    ordered = F.transform(F.sort_array(entries), lambda x: x["token"])
    return found.groupBy(key, "_row").agg(F.array_join(ordered, " ").alias(text)).drop("_row")


def pair_sides(inputs: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Inputs and targets of the same document side by side."""
    return inputs.join(targets, key)


def unknown_totals(sequences: DataFrame, sides: list[str]) -> DataFrame:
    """Unknown words over the whole set for each side's padded sequences."""
    return sequences.agg(*[
        F.sum(unknown_count(F.col(side)).cast("bigint")).alias(f"unknown_{side}") for side in sides
    ])
