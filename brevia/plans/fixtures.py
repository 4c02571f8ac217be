"""Operator inputs derived from the supplied tables, over all rows and whole texts.

The documents stand in for the corpus, with their first line as the summary. Relative bigram frequencies, unknown words
among them, stand in for a model's next-word probabilities. Texts are cut only where an operator's feature is a fixed
length, and then at the default one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brevia.constants import BATCH_SIZE, CURRICULUM_STEPS, DOCUMENT_LENGTH, ENCODERS, STOP_WORD, SUMMARY_LENGTH, UNKNOWN_ID, VOCABULARY_CAP
from brevia.functions.sequences import pad_truncate, pad_whole
from brevia.functions.text import tokenise, wrap_target
from brevia.operators.batching import assign_batches, next_token_rows
from brevia.operators.beam import KeyedScorer, beam_decode, rank_candidates
from brevia.operators.encoding import encode
from brevia.operators.joins import fits_broadcast, skew_join
from brevia.operators.vocabulary import fit_vocab
from brevia.session import spread, stage

CAP = 500
CHUNKS = ENCODERS
EPOCHS = 2
STEPS = 3
SEED = 7
BEAM_WIDTH = 3
NGRAM_SIZE = 2
BEAM_LENGTH = 8
SCORED_LENGTH = 5
LOSS_FLOOR = 1e-9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """``doc_id, articles, abstracts, lang``; ``wide`` spreads a scan of few splits for work on every word."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    documents = spread(documents, "doc_id") if wide else documents
    return documents.select(
        "doc_id", F.col("text").alias("articles"), F.substring_index("text", "\n", 1).alias("abstracts"), "lang"
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir, wide=True)


def tokens(corpus_df: DataFrame, text: Column, *others: str, mode: str = "filters") -> DataFrame:
    return corpus_df.select("doc_id", *others, tokenise(text, mode).alias("tokens"))


def document_tokens(spark: SparkSession, sf_dir: str, mode: str = "filters") -> DataFrame:
    return tokens(corpus(spark, sf_dir), F.col("articles"), mode=mode)


def summary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(corpus(spark, sf_dir), wrap_target(F.col("abstracts")))


def padded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, ids``: documents under their own capped vocabulary, cut and padded."""
    words = document_tokens(spark, sf_dir)
    ids = encode(words, fit_vocab(words, CAP), DOCUMENT_LENGTH, CAP)
    return ids.select("doc_id", pad_truncate(F.col("ids"), DOCUMENT_LENGTH).alias("ids"))


def padded_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = summary_tokens(spark, sf_dir)
    ids = encode(words, fit_vocab(words, CAP), SUMMARY_LENGTH, CAP)
    return ids.select("doc_id", pad_truncate(F.col("ids"), SUMMARY_LENGTH).alias("ids"))


def whole_documents(spark: SparkSession, sf_dir: str, parts: int = CHUNKS) -> DataFrame:
    """``doc_id, ids``: whole documents, each padded to a multiple of ``parts``."""
    words = document_tokens(spark, sf_dir)
    return encode(words, fit_vocab(words, CAP), cap=CAP).withColumn("ids", pad_whole(F.col("ids"), parts))


def whole_summaries(spark: SparkSession, sf_dir: str, parts: int = 1) -> DataFrame:
    words = summary_tokens(spark, sf_dir)
    return encode(words, fit_vocab(words, CAP), cap=CAP).withColumn("ids", pad_whole(F.col("ids"), parts))


def lines_text() -> Column:
    """A document as a sequence in which every line ends in the stop word."""
    return wrap_target(F.replace(F.col("articles"), F.lit("\n"), F.lit(f" {STOP_WORD} ")))


def lines_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(corpus(spark, sf_dir), lines_text(), "lang")


def word_id(vocab: DataFrame, word: str) -> int:
    return vocab.filter(F.col("token") == word).first()["token_id"]


def bigram_counts(words: DataFrame, vocab: DataFrame, cap: int = CAP) -> DataFrame:
    """``key, prev, token_id, n``: neighbouring words per language, also unknown ones. Pairs come from inside each row."""
    ids = encode(words, vocab, cap=cap, carry=("lang",)).select(F.col("lang").alias("key"), "ids")
    rows = next_token_rows(ids, ["key"]).select("key", "prev", F.col("real").alias("token_id"))
    return rows.groupBy("key", "prev", "token_id").agg(F.count(F.lit(1)).alias("n"))


def as_scores(counts: DataFrame) -> DataFrame:
    """``key, prev, token_id, prob`` from counts."""
    totals = counts.groupBy("key", "prev").agg(F.sum("n").alias("total"))
    return counts.join(totals, ["key", "prev"]).select(
        "key", "prev", "token_id", (F.col("n") / F.col("total")).alias("prob")
    )


def scorer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and staged next-word probabilities."""
    words = lines_tokens(spark, sf_dir)
    vocab = fit_vocab(words, CAP)
    return vocab, stage(as_scores(bigram_counts(words, vocab)), "scores")


def backed_scorer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vocabulary at the default cap, staged next-word probabilities, and the words' own frequencies to back them off."""
    words = lines_tokens(spark, sf_dir)
    vocab = stage(fit_vocab(words, VOCABULARY_CAP), "vocabulary")
    tail = vocab.crossJoin(F.broadcast(vocab.agg(F.sum("n").alias("total")))).select("token_id", (F.col("n") / F.col("total")).alias("prob"))
    return vocab, stage(as_scores(bigram_counts(words, vocab, VOCABULARY_CAP)), "scores"), tail


def trigram_scorer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, KeyedScorer]:
    """Vocabulary and a scorer of the last two words of a hypothesis; at its start, of the last word."""
    words = lines_tokens(spark, sf_dir)
    vocab = fit_vocab(words, CAP)
    ids = encode(words, vocab, cap=CAP, carry=("lang",))
    padded = ids.select(F.col("lang").alias("key"), F.concat(F.array(F.lit(0)), "ids").alias("before"), "ids")
    places = F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda i: F.struct(
        F.get("before", i - 1).alias("first"), F.get("ids", i - 1).alias("prev"), F.get("ids", i).alias("token_id")))
    rows = padded.filter(F.size("ids") > 1).select("key", F.explode(places).alias("p")).select("key", "p.*")
    # The bigrams stand in for hypotheses of one word: their first word is 0. One pass over the texts gives both.
    firsts = F.explode(F.when(F.col("first") == 0, F.array(F.lit(0))).otherwise(F.array("first", F.lit(0)))).alias("first")
    rows = rows.select("key", firsts, "prev", "token_id")
    found = rows.groupBy("key", "first", "prev", "token_id").agg(F.count(F.lit(1)).alias("n"))
    totals = found.groupBy("key", "first", "prev").agg(F.sum("n").alias("total"))
    scores = stage(found.join(totals, ["key", "first", "prev"]).select(
        "key", "first", "prev", "token_id", (F.col("n") / F.col("total")).alias("prob")), "trigrams")

    def score(hyps: DataFrame) -> DataFrame:
        at = hyps.select(
            "doc_id", "slot", "key", F.element_at("tokens", -1).alias("prev"),
            F.coalesce(F.try_element_at("tokens", F.lit(-2)), F.lit(0)).alias("first"))
        return at.join(scores, ["key", "first", "prev"]).select("doc_id", "slot", "token_id", "prob")

    return vocab, KeyedScorer(score)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lines_tokens(spark, sf_dir)
    return bigram_counts(words, fit_vocab(words, CAP))


def seeds(spark: SparkSession, sf_dir: str, vocab: DataFrame, cap: int = CAP) -> DataFrame:
    """``doc_id, key, prev``: each document with words in its summary starts from the last of them."""
    words = tokens(corpus(spark, sf_dir), F.col("abstracts"), "lang")
    ids = encode(words, vocab, cap=cap, carry=("lang",))
    last = ids.select("doc_id", F.col("lang").alias("key"), F.get("ids", F.size("ids") - 1).alias("prev"))
    return last.filter(F.col("prev").isNotNull())


def decoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and final beams of every document that can be decoded."""
    vocab, scores = scorer(spark, sf_dir)
    state = beam_decode(seeds(spark, sf_dir, vocab), scores, BEAM_LENGTH, BEAM_WIDTH, NGRAM_SIZE)
    return vocab, state


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``epoch, step, batch, doc_id, pos, real, pred, loss`` for all summary tokens under a prefix curriculum.

    Each summary is padded to a multiple of the steps, and every step adds an equal part of it.
    ``pred`` is the likeliest follower of the input word, ``loss`` the negative log probability of the label.
    """
    vocab, scores = scorer(spark, sf_dir)
    documents = corpus(spark, sf_dir)
    words = tokens(documents, wrap_target(F.col("abstracts")), "lang")
    ids = encode(words, vocab, cap=CAP, carry=("lang",)).select(
        "doc_id", F.col("lang").alias("key"), pad_whole(F.col("ids"), STEPS).alias("ids")
    )
    sized = ids.withColumn("size", (F.size("ids") / F.lit(STEPS)).cast("int"))
    rows = next_token_rows(sized, ["doc_id", "key", "size"])
    small = fits_broadcast(scores, ("key",))
    best = rank_candidates(scores).filter(F.col("rank") == 1).select("key", "prev", F.col("token_id").alias("best"))
    label = scores.select("key", "prev", F.col("token_id").alias("real"), "prob")
    scored = skew_join(rows, label, ["key", "prev", "real"], ["doc_id", "pos"], small, "left")
    scored = skew_join(scored, best, ["key", "prev"], ["doc_id", "pos"], small, "left")
    loss = -F.ln(F.greatest(F.coalesce("prob", F.lit(0.0)), F.lit(LOSS_FLOOR)))
    batches = assign_batches(documents, BATCH_SIZE, EPOCHS, SEED).select("doc_id", "epoch", "batch")
    base = scored.withColumn("loss", loss).join(batches, "doc_id")
    expanded = base.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(STEPS))))
    kept = F.col("step") * F.col("size")
    return expanded.select(
        "epoch", "step", "batch", "doc_id", "pos",
        F.when(F.col("pos") + 1 < kept, F.col("real")).otherwise(F.lit(0)).alias("real"),
        F.when((F.col("pos") >= kept) | (F.col("prev") == 0), F.lit(0))
        .otherwise(F.coalesce("best", F.lit(UNKNOWN_ID))).alias("pred"),
        "loss",
    )


def done_rows(spark: SparkSession, sf_dir: str, offset: int = 0) -> DataFrame:
    """``num, tag`` as if a run had stopped: a labelled document has its gold text, one labelled good both texts."""
    tags = F.when(F.col("quality") == 1, F.array(F.lit("encoder"), F.lit("decoder"))).otherwise(
        F.array(F.lit("encoder"))
    )
    labels = table(spark, sf_dir, "labels")
    return labels.select((F.col("doc_id") + offset).alias("num"), F.explode(tags).alias("tag"))
