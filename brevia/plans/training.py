"""From text pairs to encoded, batched training rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brevia.constants import (
    BATCH_SIZE, CURRICULUM_EPOCHS, CURRICULUM_STEPS, DOCUMENT_LENGTH, ENCODERS, START_WORD, STOP_WORD, SUMMARY_LENGTH,
    VOCABULARY_CAP,
)
from brevia.functions.sequences import pad_truncate, padding_mask, split_chunks, step_size, unknown_count
from brevia.functions.text import tokenise, wrap_target
from brevia.operators.batching import assign_batches, assign_passes, prefix_curriculum
from brevia.operators.encoding import encode
from brevia.operators.vocabulary import is_wide, number_ids, rank_vocab, word_stats
from brevia.session import stage
from brevia.sources.batches import FILE_BATCHES, write_batches
from brevia.sources.corpus import apply_null_policy
from brevia.sources.vocabulary import read_vocab, write_vocab

DOCUMENT_SIDE, SUMMARY_SIDE = "document", "summary"
_MARK = " "  # no word holds a space


@dataclass(frozen=True)
class Settings:
    """Sizes and modes of one training set."""

    mode: str = "filters"
    document_length: int = DOCUMENT_LENGTH
    summary_length: int = SUMMARY_LENGTH
    document_cap: int = VOCABULARY_CAP
    summary_cap: int = VOCABULARY_CAP
    batch_size: int = BATCH_SIZE
    epochs: int = 1
    seed: int = 0
    wide: bool | None = None


def _side_words(pairs: DataFrame, mode: str, wrap: bool = True) -> DataFrame:
    """``doc_id, side, tokens``: two rows for each pair, from one pass over it."""
    summary = wrap_target(F.col("abstracts")) if wrap else F.col("abstracts")
    sides = F.explode(F.array(
        F.struct(F.lit(DOCUMENT_SIDE).alias("side"), tokenise(F.col("articles"), mode).alias("tokens")),
        F.struct(F.lit(SUMMARY_SIDE).alias("side"), tokenise(summary, mode).alias("tokens")),
    ))
    return pairs.select("doc_id", sides.alias("s")).select("doc_id", "s.side", "s.tokens")


def _marked(side: Column, token: Column) -> Column:
    """A word with its side, so that both vocabularies can be counted and looked up together."""
    return F.concat(side, F.lit(_MARK), token)


def fit_vocabularies(pairs: DataFrame, path: str, settings: Settings = Settings()) -> None:
    """Fit and save the vocabularies of both sides, counted in one pass. The marker words must survive the summary cap.

    Ids that do not pack are numbered first, while the texts are still whole.
    """
    wide = is_wide(pairs) if settings.wide is None else settings.wide
    pairs = number_ids(pairs.select("doc_id", "articles", "abstracts")) if wide else pairs
    words = _side_words(pairs, settings.mode).select(
        "doc_id", F.transform("tokens", lambda t: _marked(F.col("side"), t)).alias("tokens")
    )
    stats = stage(word_stats(words, wide=wide, numbered=wide), "words")
    caps = {DOCUMENT_SIDE: settings.document_cap, SUMMARY_SIDE: settings.summary_cap}
    for side, cap in caps.items():
        own = stats.filter(F.col("token").startswith(side + _MARK)).withColumn(
            "token", F.substring("token", len(side + _MARK) + 1, 1 << 30)
        )
        write_vocab(rank_vocab(own, cap), path, side, cap)
    saved = read_vocab(pairs.sparkSession, path, SUMMARY_SIDE, settings.summary_cap)
    markers = saved.filter(F.col("token").isin(START_WORD, STOP_WORD)).count()
    if markers < 2:
        raise ValueError(f"a cap of {settings.summary_cap} leaves out {START_WORD} or {STOP_WORD}")


def load_vocabularies(
    spark: SparkSession, path: str, settings: Settings = Settings()
) -> dict[str, DataFrame]:
    """The saved vocabularies of both sides."""
    return {
        DOCUMENT_SIDE: read_vocab(spark, path, DOCUMENT_SIDE, settings.document_cap),
        SUMMARY_SIDE: read_vocab(spark, path, SUMMARY_SIDE, settings.summary_cap),
    }


def encode_pairs(
    pairs: DataFrame, vocabularies: dict[str, DataFrame], settings: Settings = Settings(), wrap: bool = True
) -> DataFrame:
    """``doc_id, input, target``: padded ids of both sides. Evaluation targets stay bare (``wrap=False``).

    Both sides of a row are looked up together, from one pass over the pairs, so they never have to be joined and rows of
    one id stay apart.
    """
    lengths = {DOCUMENT_SIDE: settings.document_length, SUMMARY_SIDE: settings.summary_length}
    caps = {DOCUMENT_SIDE: settings.document_cap, SUMMARY_SIDE: settings.summary_cap}
    vocab = None
    for side, words in vocabularies.items():
        own = words if caps[side] == -1 else words.filter(F.col("token_id") < caps[side])
        own = own.select(_marked(F.lit(side), F.col("token")).alias("token"), "token_id")
        vocab = own if vocab is None else vocab.unionByName(own)
    def marked_words(side: str, text: Column) -> Column:
        kept = F.slice(tokenise(text, settings.mode), 1, lengths[side])
        return F.transform(kept, lambda token: _marked(F.lit(side), token))

    summary = wrap_target(F.col("abstracts")) if wrap else F.col("abstracts")
    sides = [marked_words(DOCUMENT_SIDE, F.col("articles")), marked_words(SUMMARY_SIDE, summary)]
    words = pairs.select("doc_id", F.size(sides[0]).alias("_first"), F.concat(*sides).alias("tokens"))
    ids = encode(words, vocab, carry=("_first",))
    return ids.select(
        "doc_id",
        pad_truncate(F.slice("ids", F.lit(1), F.col("_first")), lengths[DOCUMENT_SIDE]).alias("input"),
        pad_truncate(
            F.slice("ids", F.col("_first") + 1, F.size("ids") - F.col("_first")), lengths[SUMMARY_SIDE]
        ).alias("target"),
    )


def prepare(
    pairs: DataFrame, vocab_path: str, settings: Settings = Settings(), fit: bool = True, null_mode: str = "strict",
    wrap: bool = True,
) -> DataFrame:
    """``row, doc_id, input, target``, staged: the encoded pairs, which every epoch reads again.

    Vocabularies are fitted and saved first, or with ``fit=False`` those saved earlier are used. ``row`` is unique, also
    where ids repeat; rows are numbered as they are staged.
    """
    pairs = apply_null_policy(pairs, null_mode)
    if fit:
        fit_vocabularies(pairs, vocab_path, settings)
    vocabularies = load_vocabularies(pairs.sparkSession, vocab_path, settings)
    encoded = encode_pairs(pairs, vocabularies, settings, wrap)
    return stage(encoded.select(F.monotonically_increasing_id().alias("row"), "*"), "encoded")


def _row_keys(encoded: DataFrame) -> DataFrame:
    """``row, doc_id, _key``: what a row is shuffled by, its id, or where ids repeat also its number."""
    repeated = encoded.groupBy(F.col("doc_id").alias("_id")).count().filter("count > 1").select("_id", F.lit(True).alias("_many"))
    rows = encoded.select("row", "doc_id").join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = F.when(F.col("_many"), F.concat_ws("#", name, F.col("row").cast("string"))).otherwise(name)
    return rows.select("row", "doc_id", key.alias("_key"))


def batches_of(encoded: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``epoch, batch, place, row, doc_id`` for every epoch, without the arrays: join one epoch's with ``encoded``."""
    order = assign_batches(
        _row_keys(encoded), settings.batch_size, settings.epochs, settings.seed, key="_key", carry=("row", "doc_id")
    )
    return order.drop("_key")


def training_set(pairs: DataFrame, vocab_path: str, settings: Settings = Settings(), fit: bool = True) -> DataFrame:
    """``epoch, batch, place, doc_id, input, target``: ``batches_of`` joined with ``prepare`` for all epochs."""
    encoded = prepare(pairs, vocab_path, settings, fit)
    batches = batches_of(encoded, settings).drop("doc_id")
    return batches.join(encoded, "row").select("epoch", "batch", "place", "doc_id", "input", "target")


def lay_out(encoded: DataFrame, path: str, settings: Settings = Settings(), file_batches: int = FILE_BATCHES) -> None:
    """The training set of ``prepare``'s rows as files by batch, for ``read_batches``.

    ``encoded`` is shuffled once, by row, however many epochs there are; each epoch then once to its files.
    """
    rows = batches_of(encoded, settings).drop("doc_id").join(encoded, "row")
    batches = -(-encoded.count() // settings.batch_size)
    write_batches(rows.select("epoch", "batch", "place", "doc_id", "input", "target"), path, file_batches, batches)


def sliced(rows: DataFrame, settings: Settings = Settings(), encoders: int = ENCODERS) -> DataFrame:
    """Training rows for several encoders: ``inputs`` and ``masks``, an equal slice of the input and its mask for each."""
    length = settings.document_length
    return rows.withColumns({
        "inputs": split_chunks(F.col("input"), length, encoders),
        "masks": split_chunks(padding_mask(F.col("input")), length, encoders),
    }).drop("input")


def curriculum_set(
    encoded: DataFrame, settings: Settings = Settings(), epochs: int = CURRICULUM_EPOCHS, steps: int = CURRICULUM_STEPS,
    both: bool = False,
) -> DataFrame:
    """``epoch, step, batch, place, doc_id, input, target``: every step of every epoch is a pass in an order of its own,
    with the prefix of the target, and with ``both`` of the input, that the step has reached."""
    order = assign_passes(
        _row_keys(encoded), settings.batch_size, epochs, steps, settings.seed, key="_key", carry=("row",)
    )
    rows = order.drop("_key").join(encoded, "row")
    cut = prefix_curriculum(
        rows, step_size(settings.summary_length, steps),
        input_size=step_size(settings.document_length, steps) if both else None,
    )
    return cut.select("epoch", "step", "batch", "place", "doc_id", "input", "target")


def evaluation_set(pairs: DataFrame, vocab_path: str, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, input, target, unknown_input, unknown_target`` for saved vocabularies: a missing text is the word of a
    missing value, targets are bare, and the unknown words of each row are counted."""
    encoded = prepare(pairs, vocab_path, settings, fit=False, null_mode="literal", wrap=False)
    return encoded.select(
        "doc_id", "input", "target", unknown_count(F.col("input")).alias("unknown_input"),
        unknown_count(F.col("target")).alias("unknown_target"),
    )
