"""From documents and a table of next-word probabilities to written summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from brevia.constants import BEAM_WIDTH, NGRAM_SIZE, STOP_WORD, SUMMARY_LENGTH
from brevia.functions.sequences import cut_summary
from brevia.operators.beam import Scorer, beam_decode, beam_failures, pick_best
from brevia.operators.encoding import decode
from brevia.operators.joins import fits_broadcast
from brevia.operators.repeats import repeated_ngrams
from brevia.session import stage
from brevia.sources.results import failure_rows, pending, split_failures, write_failures, write_pairs


@dataclass(frozen=True)
class Decoding:
    """Beam settings. ``ngram_size`` -1 or 1 blocks nothing."""

    length: int = SUMMARY_LENGTH
    k: int = BEAM_WIDTH
    ngram_size: int = NGRAM_SIZE
    choice: str = "length_norm"
    cap: int = -1


def generate_summaries(
    documents: DataFrame, seeds: DataFrame, scores: DataFrame | Scorer, vocab: DataFrame, settings: Decoding = Decoding()
) -> DataFrame:
    """``documents`` with the ``generated`` text, or the ``error`` that kept a document from having one.

    ``scores`` is a table of candidates or a scorer, as in ``beam_decode``.
    """
    stop = vocab.filter(F.col("token") == STOP_WORD).first()
    if stop is None:
        raise ValueError(f"the vocabulary does not hold {STOP_WORD}")
    state = beam_decode(seeds, scores, settings.length, settings.k, settings.ngram_size)
    best = pick_best(state, stop["token_id"], settings.choice)
    ids = best.select("doc_id", cut_summary(F.col("tokens"), stop["token_id"]).alias("ids"))
    texts = decode(ids, vocab, settings.cap, text="generated")
    return beam_failures(documents, texts, "generated", seeds)


def _with_articles(bad: DataFrame, documents: DataFrame) -> DataFrame:
    """The failed documents' texts. Few documents fail as a rule: their keys are then broadcast to the articles."""
    articles = documents.select("doc_id", "articles")
    if fits_broadcast(bad, ("gold", "error")):
        return articles.join(F.broadcast(bad), "doc_id")
    return articles.join(bad, "doc_id")


def summarise_pending(
    documents: DataFrame, seeds: DataFrame, scores: DataFrame | Scorer, vocab: DataFrame, path: str, failures: str,
    done: DataFrame | None = None, settings: Decoding = Decoding(),
) -> DataFrame:
    """Summarise the documents (``doc_id, num, articles, gold``) that ``done`` does not hold yet.

    Both texts go to ``path`` and failed documents to ``failures``; articles are read again for the latter only. Returns
    the repeated n-grams of each summary.
    """
    todo = documents if done is None else pending(documents, done)
    wanted = seeds.join(todo.select("doc_id"), "doc_id", "left_semi")
    kept = todo.select("doc_id", "num", "gold")
    results = stage(generate_summaries(kept, wanted, scores, vocab, settings), "summaries")
    good, bad = split_failures(results)
    write_pairs(good, path)
    write_failures(failure_rows(_with_articles(bad.drop("generated"), documents)), failures)
    if settings.ngram_size < 1:
        return good.select("num", F.array().cast("array<string>").alias("repeated"))
    return repeated_ngrams(good.select("num", "generated"), settings.ngram_size, "generated").select("num", "repeated")
