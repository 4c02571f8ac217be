"""A training corpus from ``documents``: stages of the subpackage ``llm``, each working on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brevia.llm import byte_bpe, language_id, line_dedup, mixing, simhash
from brevia.llm.common import others, ship_package, table
from brevia.llm.queries import bpe_settings
from brevia.session import stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear from their text; the model is learnt from those that name theirs."""
    ship_package(spark)
    accepted = language_id.identify(docs, language_id.fit(docs)).filter("accepted")
    return accepted.select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many documents of their source share."""
    return line_dedup.drop_boilerplate(docs).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates."""
    ship_package(spark)
    return simhash.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources reach their targets."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of the documents with the ids of each text and the bytes that the ids stand for."""
    ship_package(spark)
    path, pattern = bpe_settings()
    found = byte_bpe.encode_and_decode(docs, path, pattern, raw="decoded")
    return found.withColumn("n_tokens", F.size("ids").cast("bigint")).select(
        *others(docs, "ids", "decoded", "n_tokens"), "ids", "n_tokens", "decoded")


STAGES = [
    ("language ID", known_language),
    ("line dedup", without_boilerplate),
    ("SimHash near-dedup", without_copies),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", tokens),
]

# Language ID, SimHash and byte-level BPE cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the result of every stage before it is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
