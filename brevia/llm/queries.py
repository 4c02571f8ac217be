"""The registered query of each operator, and its DuckDB SQL where there is one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from brevia.llm import (
    byte_bpe, centroids, chat_format, filter_audit, imatch, language_id, line_dedup, mixing, nn_descent, quality_model,
    quality_rules, simhash, token_files,
)
from brevia.llm.common import crc32_mod, table
from brevia.session import staged_path

TRAP = r"\### Assistant: </turn> ok"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that are on over a tenth of their source's documents; the source is the site."""
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc32_mod(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs.filter(~held_out))
    found = language_id.identify(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staged_path(spark, "token-files")
    token_files.write_documents(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_lost")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return docs.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken")
    )


def bpe_settings() -> tuple[str, str]:
    """Ranks and pattern of the byte-level vocabulary for many languages."""
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = bpe_settings()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode_and_decode(docs, path, pattern).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("raw"), 256).alias("decoded_sha256"),
    )


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_mod(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    forest = quality_model.fit(docs, labels.filter(~held_out))
    scored = quality_model.score(docs, forest)
    return scored.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What parts of conversations, sorted by conversation and part, say when they are read back."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    key, turns, loss, n, chars, total = None, None, None, 0, 0, 0

    def row() -> pa.RecordBatch:
        values = [key, n, turns.hexdigest(), chars, loss.hexdigest(), total]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    for batch in batches:
        for conv_id, part, formatted, spans in zip(*(
            batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "spans")
        )):
            if part == 0:
                if turns is not None:
                    yield row()
                key, turns, loss, n, chars, total = conv_id, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, text, _, _ in chat_format.parse(formatted):
                turns.update(f"{role or ''}\n{text}\n".encode())
                n += 1
            for span in spans:
                text = chat_format.unescape(formatted[span["start"]:span["end"]])
                loss.update(text.encode())
                chars += len(text)
            total += len(formatted)
    if turns is not None:
        yield row()


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the formatted conversations, read back from their text and loss mask."""
    trap = spark.createDataFrame(
        [(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(trap)
    parts = chat_format.format_conversations(rows)
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        _digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint")


def op11_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.compare_edited(docs, imatch.fit_lexicon(docs))


def op12_orchard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_token_files": op3_token_files,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_nn_descent": op8_nn_descent,
    "op9_quality_model": op9_quality_model,
    "op10_chat_format": op10_chat_format,
    "op11_imatch": op11_imatch,
    "op12_orchard": op12_orchard,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL, "op6_mixing": mixing.SQL, "op12_orchard": centroids.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
