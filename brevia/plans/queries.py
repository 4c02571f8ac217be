"""One query per operator over the supplied tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brevia.constants import STOP_WORD, UNKNOWN_WORD
from brevia.functions import scoring, sequences as seq, text
from brevia.operators import batching, beam, encoding, metrics, repeats, vocabulary
from brevia.operators.joins import fits_broadcast
from brevia.plans import fixtures as fx, summaries, training
from brevia.session import stage, staged_path
from brevia.sources import batches, corpus as source, results, vocabulary as stored
from brevia.streaming.incremental import encode_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NUMBER_OFFSET = 999_000  # result numbers then have six and seven digits
CSV_FILE_ROWS = 5_000  # documents in a CSV file, about


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), " ")


# Scans and sinks


@query
def corpus_scan(spark, sf_dir):
    return source.read_corpus(spark, f"{sf_dir}/documents.parquet", columns=("doc_id", "text", "lang"))


@query
def corpus_project(spark, sf_dir):
    documents = fx.pairs(spark, sf_dir).withColumnRenamed("doc_id", "id_articles")
    return source.project_corpus(documents)


def _with_missing(spark, sf_dir):
    """Articles of a single line have no summary beyond themselves: it counts as missing."""
    documents = fx.pairs(spark, sf_dir).select("doc_id", "articles", "abstracts")
    return documents.withColumn("abstracts", F.nullif(F.col("abstracts"), F.col("articles")))


@query
def corpus_csv(spark, sf_dir):
    """Documents written as CSV with the columns in another order, and read again by their names."""
    path = staged_path(spark, "csv")
    rows = fx.pairs(spark, sf_dir).select(F.col("doc_id").alias("id_articles"), "lang", "abstracts", "articles")
    rows.write.option("header", "true").option("escape", '"').csv(path)
    return source.project_corpus(source.read_corpus(spark, path, "csv", emptyValue="", nullValue="\\N"), key_type="string")


@query
def corpus_rejected(spark, sf_dir):
    """Documents as lines of JSON and as CSV, some broken, some without a summary: rows, and what is left out and why."""
    documents = fx.pairs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "articles", "abstracts")
    kind = F.col("doc_id").cast("bigint") % 7
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in ("articles", "abstracts")]
    lines = {
        "json": F.when(kind == 3, F.concat(F.lit('{"doc_id": "'), F.col("doc_id"), F.lit('", "articles": "cut')))
        .when(kind == 5, F.col("doc_id"))
        .otherwise(F.to_json(F.struct("doc_id", "articles", F.when(kind != 4, F.col("abstracts")).alias("abstracts")))),
        "csv": F.when(kind == 3, F.col("doc_id")).when(kind == 5, F.concat("doc_id", F.lit(",one,two,three")))
        .otherwise(F.concat_ws(",", "doc_id", quoted[0], F.when(kind != 4, quoted[1]).otherwise("\\N"))),
    }
    out = None
    for fmt, line in lines.items():
        path, options = staged_path(spark, fmt), {}
        rows = documents.select((F.col("doc_id").cast("bigint") % 4).alias("part"), F.lit(1).alias("place"), line.alias("line"))
        if fmt == "csv":
            # One task reads a whole file, as its texts hold line breaks: there are more files where there are more rows.
            options = {"emptyValue": "", "nullValue": "\\N"}
            files = 4 * -(-documents.count() // (4 * CSV_FILE_ROWS))
            part = F.pmod(F.xxhash64("doc_id"), F.lit(files)).alias("part")
            rows = documents.select(part, F.lit(1).alias("place"), line.alias("line"))
            heads = spark.range(files).select("id", F.lit(0), F.lit("doc_id,articles,abstracts"))
            laid = heads.union(rows).toDF("part", "place", "line").repartition(files, "part")
            rows = laid.sortWithinPartitions("part", "place")
        rows.select("part", "line").write.partitionBy("part").text(path)
        names = ("doc_id", "articles", "abstracts")
        good, bad = source.read_checked(spark, path, fmt, names, names[1:], **options)
        for found in (good, bad.select(*names, "raw", "error")):
            found = found.withColumn("format", F.lit(fmt))
            out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out


@query
def numbered_corpus(spark, sf_dir):
    """Rows of the file numbered from the name of their file on."""
    found = source.read_corpus(spark, f"{sf_dir}/documents.parquet", columns=("doc_id",), path_column="path")
    keyed = found.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit("documents.parquet").alias("path"))
    return source.number_rows(keyed, "doc_id", "path", start=NUMBER_OFFSET).select("doc_id", "num")


def _shards(spark, sf_dir, fmt):
    """The ids of the documents in files of this format, each named by a number: its rows in an order of their own."""
    path, shards = staged_path(spark, "shards"), 8
    rows = fx.pairs(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("doc_id"), (F.col("doc_id") % shards).alias("shard"))
    laid = rows.repartition("shard").sortWithinPartitions("shard", F.md5("doc_id"))
    laid.write.partitionBy("shard").option("header", "true").format(fmt).save(f"{path}/written")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop(f"{path}/named"))
    for shard in range(shards):
        found = files.globStatus(hadoop(f"{path}/written/shard={shard}/part-*"))
        for at, status in enumerate(found):
            files.rename(status.getPath(), hadoop(f"{path}/named/eval{at}_{NUMBER_OFFSET + 100_000 * shard}_x.{fmt}"))
    return f"{path}/named"


@query
def numbered_shards(spark, sf_dir):
    """Rows of several files, numbered by their place from the number in the file's name on."""
    return source.read_numbered(spark, _shards(spark, sf_dir, "parquet"), "parquet", ("doc_id",))


@query
def numbered_shards_csv(spark, sf_dir):
    return source.read_numbered(spark, _shards(spark, sf_dir, "csv"), "csv", ("doc_id",))


@query
def null_literal(spark, sf_dir):
    return source.apply_null_policy(_with_missing(spark, sf_dir), "literal")


@query
def null_drop(spark, sf_dir):
    return source.apply_null_policy(_with_missing(spark, sf_dir), "drop")


@query
def null_strict(spark, sf_dir):
    documents = fx.pairs(spark, sf_dir).select("doc_id", "articles", "abstracts")
    return source.apply_null_policy(documents, "strict")


@query
def shard_number(spark, sf_dir):
    documents = fx.pairs(spark, sf_dir).select("doc_id", "lang")
    path = F.concat(F.lit("eval/"), F.col("lang"), F.lit("_"), F.length("lang") * 1000, F.lit("_end.xlsx"))
    return source.number_rows(documents.select("doc_id", path.alias("path")), "doc_id", "path")


@query
def vocab_round_trip(spark, sf_dir):
    words = fx.document_tokens(spark, sf_dir)
    path = staged_path(spark, "vocabularies")
    stored.write_vocab(vocabulary.rank_vocab(vocabulary.word_stats(words), fx.CAP), path, "document", fx.CAP)
    stored.write_vocab(
        vocabulary.rank_vocab(vocabulary.word_stats(fx.summary_tokens(spark, sf_dir)), fx.CAP), path, "summary", fx.CAP
    )
    sides = [
        stored.read_vocab(spark, path, side, fx.CAP).select(F.lit(side).alias("side"), "token", "token_id", "n", "df")
        for side in ("document", "summary")
    ]
    return sides[0].unionByName(sides[1])


# Text


@query
def wrap_target(spark, sf_dir):
    return fx.pairs(spark, sf_dir).select("doc_id", text.wrap_target(F.col("abstracts")).alias("target"))


def _tokenise(spark, sf_dir, mode):
    words = fx.document_tokens(spark, sf_dir, mode)
    return words.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("words"))


@query
def tokenise_filters(spark, sf_dir):
    return _tokenise(spark, sf_dir, text.filter_mode(filters=True, no_filters=False))


@query
def tokenise_no_filters(spark, sf_dir):
    return _tokenise(spark, sf_dir, text.filter_mode(filters=False, no_filters=True))


@query
def strip_chars(spark, sf_dir):
    return fx.corpus(spark, sf_dir).select("doc_id", text.strip_chars(F.col("articles")).alias("stripped"))


@query
def char_length(spark, sf_dir):
    return fx.pairs(spark, sf_dir).select(
        "doc_id", text.char_length(F.col("articles")).alias("article_chars"),
        text.char_length(F.col("abstracts")).alias("abstract_chars"),
    )


@query
def length_stats(spark, sf_dir):
    sides = {"articles": text.char_length(F.col("articles")), "abstracts": text.char_length(F.col("abstracts"))}
    stats = source.length_stats(fx.pairs(spark, sf_dir), sides)
    return stats.withColumn("mean_length", F.round("mean_length", 6))


@query
def corpus_size(spark, sf_dir):
    return source.corpus_size(fx.pairs(spark, sf_dir))


@query
def repeated_ngrams(spark, sf_dir):
    found = repeats.repeated_ngrams(fx.corpus(spark, sf_dir).select("doc_id", "articles"), 2, "articles")
    return found.select("doc_id", F.size("repeated").alias("n_repeated"), F.array_join("repeated", "|").alias("repeated"))


@query
def repeated_trigrams(spark, sf_dir):
    found = repeats.repeated_ngrams(fx.corpus(spark, sf_dir).select("doc_id", "articles"), 3, "articles")
    return found.select("doc_id", F.size("repeated").alias("n_repeated"), F.array_join("repeated", "|").alias("repeated"))


# Vocabulary


@query
def word_stats(spark, sf_dir):
    return vocabulary.word_stats(fx.document_tokens(spark, sf_dir)).select(
        "token", "n", "df", F.shiftright("first", 24).alias("first_doc"),
        F.col("first").bitwiseAND(F.lit((1 << 24) - 1)).alias("first_pos"),
    )


@query
def distinct_words(spark, sf_dir):
    return vocabulary.distinct_words(fx.document_tokens(spark, sf_dir))


@query
def vocab_rank(spark, sf_dir):
    return vocabulary.rank_vocab(vocabulary.word_stats(fx.document_tokens(spark, sf_dir)), fx.CAP)


@query
def vocab_rank_uncapped(spark, sf_dir):
    return vocabulary.rank_vocab(vocabulary.word_stats(fx.document_tokens(spark, sf_dir)))


@query
def vocab_size(spark, sf_dir):
    stats = vocabulary.word_stats(fx.document_tokens(spark, sf_dir)).filter(F.col("token") != UNKNOWN_WORD)
    capped = vocabulary.vocab_size(stats, fx.CAP).withColumn("kind", F.lit("capped"))
    return capped.unionByName(vocabulary.vocab_size(stats).withColumn("kind", F.lit("uncapped")))


# Encoding


@query
def encode_documents(spark, sf_dir):
    return fx.padded_documents(spark, sf_dir).select("doc_id", joined("ids").alias("ids"))


@query
def encode_summaries(spark, sf_dir):
    return fx.padded_summaries(spark, sf_dir).select("doc_id", joined("ids").alias("ids"))


@query
def encode_uncapped(spark, sf_dir):
    words = fx.document_tokens(spark, sf_dir)
    return encoding.encode(words, vocabulary.fit_vocab(words)).select("doc_id", joined("ids").alias("ids"))


@query
def encode_uncapped_large(spark, sf_dir):
    """As if the vocabulary were too large to broadcast: the most frequent words first, then the others by key."""
    words = fx.document_tokens(spark, sf_dir)
    ids = encoding.encode(words, vocabulary.fit_vocab(words), most_words=1000)
    return ids.select("doc_id", joined("ids").alias("ids"))


@query
def decode_documents(spark, sf_dir):
    words = fx.document_tokens(spark, sf_dir)
    vocab = vocabulary.fit_vocab(words, fx.CAP)
    ids = encoding.encode(words, vocab, cap=fx.CAP).withColumn("ids", seq.pad_whole(F.col("ids"), fx.CHUNKS))
    return encoding.decode(ids, vocab, fx.CAP)


@query
def pair_sides(spark, sf_dir):
    turns = fx.table(spark, sf_dir, "conversations")
    users = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("articles"))
    replies = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("abstracts")
    )
    name = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id")
    return encoding.pair_sides(users.select(name, "articles"), replies.select(name, "abstracts"), "id")


@query
def unknown_stats(spark, sf_dir):
    """Kept words, unknown words and unknown share of every document under a capped vocabulary."""
    words = fx.document_tokens(spark, sf_dir)
    counts = encoding.encode_lengthwise(words, vocabulary.fit_vocab(words, fx.CAP), fx.DOCUMENT_LENGTH, fx.CAP)
    share = F.when(F.col("kept") > 0, F.round(F.col("unknown") / F.col("kept"), 6))
    return counts.withColumn("unknown_share", share)


@query
def unknown_totals(spark, sf_dir):
    sides = encoding.pair_sides(
        fx.padded_documents(spark, sf_dir).withColumnRenamed("ids", "inputs"),
        fx.padded_summaries(spark, sf_dir).withColumnRenamed("ids", "targets"),
    )
    return encoding.unknown_totals(sides, ["inputs", "targets"])


# Sequences


@query
def pad_truncate(spark, sf_dir):
    words = fx.document_tokens(spark, sf_dir)
    ids = words.select("doc_id", F.transform("tokens", lambda t: F.length(t)).alias("ids"))
    return ids.select("doc_id", F.array_join(seq.pad_truncate(F.col("ids"), 300).cast("array<string>"), " ").alias("ids"))


@query
def padding_mask(spark, sf_dir):
    ids = fx.whole_documents(spark, sf_dir)
    mask = F.transform(seq.padding_mask(F.col("ids")), lambda x: x.cast("int"))
    return ids.select(
        "doc_id", F.array_join(mask.cast("array<string>"), "").alias("mask"),
        seq.valid_length(F.col("ids")).alias("valid"),
    )


@query
def next_token_pairs(spark, sf_dir):
    pairs = batching.next_token_pairs(fx.whole_summaries(spark, sf_dir))
    return pairs.select("doc_id", joined("input_ids").alias("input_ids"), joined("label_ids").alias("label_ids"))


@query
def next_token_rows(spark, sf_dir):
    return batching.next_token_rows(fx.whole_summaries(spark, sf_dir), ["doc_id"])


def _chunked(df, column):
    chunks = seq.split_chunks(F.col(column), None, fx.CHUNKS)
    return df.select("doc_id", F.posexplode(chunks).alias("chunk", "ids"))


@query
def split_chunks(spark, sf_dir):
    chunks = _chunked(fx.whole_documents(spark, sf_dir), "ids")
    return chunks.select("doc_id", "chunk", joined("ids").alias("ids"))


@query
def chunk_mask(spark, sf_dir):
    masked = fx.whole_documents(spark, sf_dir).withColumn("mask", seq.padding_mask(F.col("ids")))
    mask = F.transform("ids", lambda x: x.cast("int")).cast("array<string>")
    return _chunked(masked, "mask").select("doc_id", "chunk", F.array_join(mask, "").alias("mask"))


@query
def chunk_position(spark, sf_dir):
    step = (F.size("ids") / F.lit(fx.CHUNKS)).cast("int")
    rows = fx.whole_documents(spark, sf_dir).select("doc_id", step.alias("step"), F.posexplode("ids").alias("pos", "token_id"))
    return rows.select(
        "doc_id", "pos", "token_id", seq.chunk_number(F.col("pos"), F.col("step")).alias("chunk"),
        seq.chunk_position(F.col("pos"), F.col("step")).alias("chunk_pos"),
    )


@query
def concat_chunks(spark, sf_dir):
    chunks = _chunked(fx.whole_documents(spark, sf_dir), "ids")
    return batching.concat_chunks(chunks).select("doc_id", joined("ids").alias("ids"))


@query
def curriculum_step_size(spark, sf_dir):
    lengths = fx.pairs(spark, sf_dir).select("doc_id", text.char_length(F.col("articles")).alias("length"))
    return lengths.select(
        "doc_id", "length", seq.step_size_column(F.col("length"), F.lit(fx.CURRICULUM_STEPS)).alias("size")
    )


def _curriculum(spark, sf_dir, both):
    pairs = encoding.pair_sides(
        fx.whole_documents(spark, sf_dir).withColumnRenamed("ids", "input"),
        fx.whole_summaries(spark, sf_dir).withColumnRenamed("ids", "target"),
    )
    steps = F.lit(fx.CURRICULUM_STEPS)
    sized = pairs.withColumns({
        "input_size": seq.step_size_column(F.size("input"), steps), "target_size": seq.step_size_column(F.size("target"), steps),
    })
    cut = batching.prefix_curriculum(
        batching.expand_steps(sized, fx.CURRICULUM_STEPS), F.col("target_size"),
        input_size=F.col("input_size") if both else None,
    )
    return cut.select("doc_id", "epoch", "step", joined("input").alias("input"), joined("target").alias("target"))


@query
def prefix_curriculum(spark, sf_dir):
    return _curriculum(spark, sf_dir, both=False)


@query
def prefix_curriculum_both(spark, sf_dir):
    return _curriculum(spark, sf_dir, both=True)


def _settings(**changes):
    return training.Settings(**{
        "document_length": fx.DOCUMENT_LENGTH, "summary_length": fx.SUMMARY_LENGTH, "document_cap": fx.CAP,
        "summary_cap": fx.CAP, "batch_size": fx.BATCH_SIZE, "epochs": fx.EPOCHS, "seed": fx.SEED, **changes,
    })


@query
def training_set(spark, sf_dir):
    """Encoded pairs of every epoch in shuffled batches, vocabularies fitted and saved on the way."""
    rows = training.training_set(fx.corpus(spark, sf_dir), staged_path(spark, "vocabularies"), _settings())
    return rows.select(
        "epoch", "batch", "place", "doc_id", joined("input").alias("input"), joined("target").alias("target")
    )


@query
def batches_laid_out(spark, sf_dir):
    """The training set laid out by batch, and each epoch read back from its files in two ranges of batches."""
    settings, path = _settings(), staged_path(spark, "batches")
    encoded = training.prepare(fx.corpus(spark, sf_dir), staged_path(spark, "vocabularies"), settings)
    training.lay_out(encoded, path, settings, file_batches=2)
    halves = {row["epoch"]: row["batches"] // 2 for row in batches.batch_counts(spark, path).collect()}
    ranges = [(e, *r) for e, half in sorted(halves.items()) for r in ((0, half - 1), (half, None))]
    rows = functools.reduce(DataFrame.unionByName, (batches.read_batches(spark, path, *r) for r in ranges))
    return rows.select(
        "epoch", "batch", "place", "doc_id", joined("input").alias("input"), joined("target").alias("target")
    )


@query
def training_set_sliced(spark, sf_dir):
    """One epoch's rows for several encoders, a row for each encoder's slice."""
    settings = _settings(epochs=1)
    rows = training.training_set(fx.corpus(spark, sf_dir), staged_path(spark, "vocabularies"), settings)
    slices = F.posexplode(F.arrays_zip("inputs", "masks")).alias("encoder", "s")
    mask = F.array_join(F.transform("s.masks", lambda x: x.cast("int")).cast("array<string>"), "")
    return training.sliced(rows, settings, fx.CHUNKS).select("epoch", "batch", "place", "doc_id", slices).select(
        "epoch", "batch", "place", "doc_id", "encoder", joined("s.inputs").alias("input"), mask.alias("mask")
    )


@query
def training_set_string_ids(spark, sf_dir):
    """Ids of any form, each twice: rows of one id stay rows of their own."""
    pairs = fx.corpus(spark, sf_dir).withColumn("doc_id", F.concat(F.lit("PMC"), F.col("doc_id").cast("string")))
    rows = training.prepare(pairs.unionAll(pairs), staged_path(spark, "vocabularies"), _settings())
    return rows.select("doc_id", joined("input").alias("input"), joined("target").alias("target"))


@query
def curriculum_set(spark, sf_dir):
    """Every step of every epoch in an order of its own, with the prefix of the target that it has reached."""
    settings = _settings()
    encoded = training.prepare(fx.corpus(spark, sf_dir), staged_path(spark, "vocabularies"), settings)
    rows = training.curriculum_set(encoded, settings, fx.EPOCHS, fx.STEPS)
    return rows.select("epoch", "step", "batch", "place", "doc_id", joined("target").alias("target"))


def _evaluation(spark, sf_dir):
    path = staged_path(spark, "vocabularies")
    training.fit_vocabularies(fx.corpus(spark, sf_dir), path, _settings())
    return training.evaluation_set(_with_missing(spark, sf_dir), path, _settings())


@query
def evaluation_set(spark, sf_dir):
    return _evaluation(spark, sf_dir).select(
        "doc_id", joined("input").alias("input"), joined("target").alias("target"), "unknown_input", "unknown_target"
    )


@query
def evaluation_unknowns(spark, sf_dir):
    return encoding.unknown_totals(_evaluation(spark, sf_dir), ["input", "target"])


@query
def batch_assign(spark, sf_dir):
    return batching.assign_batches(fx.pairs(spark, sf_dir), fx.BATCH_SIZE, fx.EPOCHS, fx.SEED)


# Evaluation


def _logits(spark, sf_dir):
    return fx.counts(spark, sf_dir).select("key", "prev", "token_id", "n", F.ln("n").alias("logit"))


@query
def softmax(spark, sf_dir):
    probs = metrics.softmax(_logits(spark, sf_dir), ["key", "prev"])
    return probs.select("key", "prev", "token_id", F.round("prob", 9).alias("prob"))


@query
def token_loss(spark, sf_dir):
    """Each context is a position; its label is the follower that comes last in the vocabulary."""
    logits = _logits(spark, sf_dir)
    last = logits.groupBy("key", "prev").agg(F.max("token_id").alias("last"))
    labelled = logits.join(last, ["key", "prev"]).withColumn("is_real", F.col("token_id") == F.col("last"))
    loss = metrics.token_loss(labelled, ["key", "prev"])
    return loss.select("key", "prev", F.round("loss", 6).alias("loss"))


@query
def batch_loss(spark, sf_dir):
    losses = metrics.batch_loss(fx.predictions(spark, sf_dir))
    return losses.withColumn("loss", F.round("loss", 6))


@query
def token_accuracy(spark, sf_dir):
    return metrics.token_accuracy(fx.predictions(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query
def token_accuracy_masked(spark, sf_dir):
    accuracy = metrics.token_accuracy(fx.predictions(spark, sf_dir), ("epoch", "step"), mask=True)
    return accuracy.withColumn("accuracy", F.round("accuracy", 6))


@query
def running_accuracy(spark, sf_dir):
    return metrics.running_accuracy(fx.predictions(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query
def epoch_loss(spark, sf_dir):
    return metrics.epoch_loss(metrics.batch_loss(fx.predictions(spark, sf_dir))).withColumn("loss", F.round("loss", 6))


@query
def running_loss(spark, sf_dir):
    running = metrics.running_loss(metrics.batch_loss(fx.predictions(spark, sf_dir)))
    return running.select("epoch", "step", "batch", F.round("running_loss", 5).alias("running_loss"))


@query
def curriculum_loss(spark, sf_dir):
    losses = metrics.batch_loss(fx.predictions(spark, sf_dir))
    return metrics.curriculum_loss(losses).withColumn("loss", F.round("loss", 4))


@query
def curriculum_loss_mean(spark, sf_dir):
    losses = metrics.batch_loss(fx.predictions(spark, sf_dir))
    return metrics.curriculum_loss(losses, "mean").withColumn("loss", F.round("loss", 6))


@query
def metrics_sink(spark, sf_dir):
    preds = stage(fx.predictions(spark, sf_dir), "predictions")
    path = staged_path(spark, "report")
    metrics_report = metrics.curriculum_report(metrics.batch_loss(preds), preds)
    results.write_metrics(metrics_report, path)
    return results.read_metrics(spark, path, ("epoch", "step")).select(
        "epoch", "step", F.round("loss", 6).alias("loss"), "batches", F.round("accuracy", 4).alias("accuracy")
    )


@query
def metrics_rewritten(spark, sf_dir):
    """An epoch that ran twice and one whose run stopped before its commit: each epoch and step has one row."""
    preds = stage(fx.predictions(spark, sf_dir), "predictions")
    path = staged_path(spark, "report")
    report = stage(metrics.curriculum_report(metrics.batch_loss(preds), preds), "report")
    first = report.withColumns({"loss": F.lit(-1.0), "batches": F.lit(0).cast("bigint")})
    results.write_metrics(first, path)
    first.write.parquet(f"{path}/{results.RUN}=stopped")
    results.write_metrics(report, path)
    return results.read_metrics(spark, path, ("epoch", "step")).select(
        "epoch", "step", F.round("loss", 6).alias("loss"), "batches", F.round("accuracy", 4).alias("accuracy")
    )


def _report(spark, sf_dir, report):
    preds = stage(fx.predictions(spark, sf_dir), "predictions")
    return report(metrics.batch_loss(preds), preds)


@query
def epoch_report(spark, sf_dir):
    return _report(spark, sf_dir, metrics.epoch_report).select(
        "epoch", F.round("loss", 6).alias("loss"), "batches", F.round("accuracy", 4).alias("accuracy")
    )


@query
def curriculum_epoch_report(spark, sf_dir):
    return _report(spark, sf_dir, metrics.curriculum_epoch_report).select(
        "epoch", F.round("loss", 4).alias("loss"), "batches", F.round("accuracy", 4).alias("accuracy")
    )


# Decoding


def _beams(state, digits=6):
    hyps = beam.hypotheses(state)
    return hyps.select("doc_id", "slot", joined("tokens").alias("tokens"), F.round("score", digits).alias("score"))


def _decoder(spark, sf_dir, length):
    vocab, scores = fx.scorer(spark, sf_dir)
    return beam.beam_decode(fx.seeds(spark, sf_dir, vocab), scores, length, fx.BEAM_WIDTH, fx.NGRAM_SIZE)


@query
def beam_seed(spark, sf_dir):
    return _beams(_decoder(spark, sf_dir, 2))


@query
def beam_step(spark, sf_dir):
    return _beams(_decoder(spark, sf_dir, 3))


@query
def beam_decode(spark, sf_dir):
    return _beams(_decoder(spark, sf_dir, fx.BEAM_LENGTH))


@query
def beam_decode_default(spark, sf_dir):
    """Every document decoded at the default length, width and vocabulary, its scores backed off."""
    vocab, scores, tail = fx.backed_scorer(spark, sf_dir)
    state = beam.beam_decode(fx.seeds(spark, sf_dir, vocab, fx.VOCABULARY_CAP), scores, tail=tail)
    return _beams(state, 5)


@query
def beam_decode_large(spark, sf_dir):
    """Candidates joined by key, as if they were too many to broadcast."""
    vocab, scores = fx.scorer(spark, sf_dir)
    return _beams(beam.beam_decode(
        fx.seeds(spark, sf_dir, vocab), scores, 4, fx.BEAM_WIDTH, fx.NGRAM_SIZE, broadcast_rows=0))


@query
def beam_decode_scored(spark, sf_dir):
    """Decoding with a scorer of whole hypotheses; documents that fail are named with their cause."""
    vocab, scorer = fx.trigram_scorer(spark, sf_dir)
    seeds = fx.seeds(spark, sf_dir, vocab)
    state = beam.beam_decode(seeds, scorer, fx.SCORED_LENGTH, fx.BEAM_WIDTH, fx.NGRAM_SIZE)
    found = _beams(state)
    failed = beam.beam_failures(fx.pairs(spark, sf_dir).select("doc_id"), state.select("doc_id", F.lit("").alias("x")), "x", seeds)
    return found.withColumn("error", F.lit(None).cast("string")).unionByName(
        failed.filter(F.col("error").isNotNull()).select("doc_id", "error"), allowMissingColumns=True)


def _position(spark, sf_dir, position):
    """Beams before ``position`` and the candidate pages."""
    vocab, scores = fx.scorer(spark, sf_dir)
    state = beam.beam_decode(fx.seeds(spark, sf_dir, vocab), scores, position, fx.BEAM_WIDTH, fx.NGRAM_SIZE)
    return state, stage(beam.page_candidates(scores, fx.BEAM_WIDTH), "candidates")


@query
def ngram_memory(spark, sf_dir):
    state, _ = _position(spark, sf_dir, 4)
    rows = beam.open_slots(state, 4, fx.NGRAM_SIZE)
    seen = F.array_sort(beam.gram_texts("seen", fx.NGRAM_SIZE))
    return rows.select("doc_id", "slot", F.array_join(seen, "|").alias("seen"))


@query
def topk_per_hypothesis(spark, sf_dir):
    state, pages = _position(spark, sf_dir, 4)
    small = fits_broadcast(pages, ("key",))
    extended = beam.extend(state, pages, 4, fx.BEAM_WIDTH, fx.NGRAM_SIZE, small, "slot")
    best = beam.topk_per_hypothesis(extended, fx.BEAM_WIDTH)
    return best.withColumn("log_prob", F.round("log_prob", 6))


@query
def first_stop(spark, sf_dir):
    vocab, state = fx.decoded(spark, sf_dir)
    stops = beam.first_stop(beam.hypotheses(state), fx.word_id(vocab, STOP_WORD))
    return stops.select("doc_id", "slot", "stop_at")


@query
def finished_count(spark, sf_dir):
    vocab, state = fx.decoded(spark, sf_dir)
    return beam.finished_count(beam.hypotheses(state), fx.word_id(vocab, STOP_WORD))


@query
def length_penalty(spark, sf_dir):
    vocab, state = fx.decoded(spark, sf_dir)
    stops = beam.first_stop(beam.hypotheses(state), fx.word_id(vocab, STOP_WORD))
    norm = scoring.length_norm(F.col("score"), F.col("stop_at"))
    return stops.filter(F.col("stop_at").isNotNull()).select("doc_id", "slot", F.round(norm, 6).alias("normalised"))


def _picked(spark, sf_dir, mode):
    vocab, state = fx.decoded(spark, sf_dir)
    best = beam.pick_best(state, fx.word_id(vocab, STOP_WORD), mode)
    return vocab, best


@query
def pick_best_length_norm(spark, sf_dir):
    _, best = _picked(spark, sf_dir, "length_norm")
    return best.select("doc_id", "slot", joined("tokens").alias("tokens"), "finished")


@query
def pick_best_raw(spark, sf_dir):
    _, best = _picked(spark, sf_dir, "raw")
    return best.select("doc_id", "slot", joined("tokens").alias("tokens"), "finished")


@query
def cut_summary(spark, sf_dir):
    vocab, state = fx.decoded(spark, sf_dir)
    stop = fx.word_id(vocab, STOP_WORD)
    hyps = beam.hypotheses(state)
    cut = hyps.withColumn("summary", seq.cut_summary(F.col("tokens"), stop))
    return cut.select("doc_id", "slot", joined("summary").alias("summary"))


def _documents(spark, sf_dir):
    return fx.pairs(spark, sf_dir).select(
        "doc_id", (F.col("doc_id") + NUMBER_OFFSET).alias("num"), "articles", F.col("abstracts").alias("gold")
    )


def _decoding():
    return summaries.Decoding(fx.BEAM_LENGTH, fx.BEAM_WIDTH, fx.NGRAM_SIZE, cap=fx.CAP)


def _summaries(spark, sf_dir):
    """Number, article, gold summary, generated summary and error of every document."""
    vocab, scores = fx.scorer(spark, sf_dir)
    return summaries.generate_summaries(
        _documents(spark, sf_dir), fx.seeds(spark, sf_dir, vocab), scores, vocab, _decoding()
    )


@query
def summarise(spark, sf_dir):
    """Every document's decoded summary, or the error that kept it from having one."""
    return _summaries(spark, sf_dir).select("num", "generated", "error")


@query
def write_pairs(spark, sf_dir):
    good, _ = results.split_failures(_summaries(spark, sf_dir))
    path = staged_path(spark, "pairs")
    results.write_pairs(good, path)
    return results.read_pairs(spark, path).select("num", "tag", "name", "text")


@query
def committed_runs(spark, sf_dir):
    """Texts of two committed runs, the second one for good documents only, and of one that stopped; then compacted."""
    path = staged_path(spark, "pairs")
    documents = fx.pairs(spark, sf_dir).select(
        (F.col("doc_id") + NUMBER_OFFSET).alias("num"), F.col("abstracts").alias("gold"), F.col("lang").alias("generated"))
    good = fx.done_rows(spark, sf_dir, NUMBER_OFFSET).filter(F.col("tag") == results.GENERATED_TAG)
    results.write_pairs(documents, path)
    again = documents.join(good, "num", "left_semi")
    results.write_pairs(again.withColumn("generated", F.concat(F.lit("again "), "generated")), path)
    stopped = results.pair_rows(documents.withColumn("generated", F.lit("stopped")))
    stopped.write.partitionBy("tag").parquet(f"{path}/{results.RUN}=stopped")
    results.compact_pairs(spark, path)
    return results.read_pairs(spark, path)


@query
def summarise_resumed(spark, sf_dir):
    """A second run over the folder of one that stopped: documents without both texts there are decoded, and what they
    had is replaced."""
    vocab, scores = fx.scorer(spark, sf_dir)
    path, failures = staged_path(spark, "pairs"), staged_path(spark, "failures")
    earlier = fx.done_rows(spark, sf_dir, NUMBER_OFFSET).select(
        "num", "tag", F.concat(F.lit("earlier "), "tag").alias("text"), F.lit("").alias("name")
    )
    results.write_texts(earlier, path)
    repeated = summaries.summarise_pending(
        _documents(spark, sf_dir), fx.seeds(spark, sf_dir, vocab), scores, vocab, path, failures,
        results.read_pairs(spark, path), _decoding(),
    ).select("num", F.array_join("repeated", "|").alias("repeated"))
    written = results.read_pairs(spark, path).select("num", "tag", "text")
    failed = results.read_failures(spark, failures, written).select(
        "num", F.lit("failure").alias("tag"), F.col("error").alias("text")
    )
    return written.unionByName(failed).join(repeated, "num", "left")


@query
def route_failures(spark, sf_dir):
    """Documents that a scorer of two words leaves without enough candidates."""
    vocab, scorer = fx.trigram_scorer(spark, sf_dir)
    settings = summaries.Decoding(fx.SCORED_LENGTH, fx.BEAM_WIDTH, fx.NGRAM_SIZE, cap=fx.CAP)
    found = summaries.generate_summaries(
        _documents(spark, sf_dir), fx.seeds(spark, sf_dir, vocab), scorer, vocab, settings
    )
    _, bad = results.split_failures(found)
    return results.failure_rows(bad)


@query
def resume_skip(spark, sf_dir):
    documents = fx.pairs(spark, sf_dir).select(F.col("doc_id").alias("num"), "abstracts")
    return results.pending(documents, fx.done_rows(spark, sf_dir))


def _stream(spark, sf_dir, vocab, sink, failures, wanted=None):
    schema = "doc_id BIGINT, text STRING, lang STRING"
    # The table may be one file or a folder of them.
    files = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents*.parquet")
    files = files if wanted is None else files.filter(wanted)
    arriving = files.select("doc_id", F.col("text").alias("articles"))
    progress = staged_path(spark, "progress")
    encode_stream(arriving, vocab, sink, failures, progress, fx.DOCUMENT_LENGTH, fx.CAP).awaitTermination()


@query
def incremental_encode(spark, sf_dir):
    """The documents arriving as a stream of files, encoded with a saved vocabulary."""
    vocab = vocabulary.fit_vocab(fx.document_tokens(spark, sf_dir), fx.CAP)
    sink, failures = (staged_path(spark, name) for name in ("sink", "failures"))
    _stream(spark, sf_dir, vocab, sink, failures)
    return spark.read.parquet(sink).select("doc_id", joined("ids").alias("ids"))


@query
def incremental_encode_restarted(spark, sf_dir):
    """Two streams with checkpoints of their own write to one sink: of the second only what the first has not brought."""
    vocab = vocabulary.fit_vocab(fx.document_tokens(spark, sf_dir), fx.CAP)
    sink, failures = (staged_path(spark, name) for name in ("sink", "failures"))
    _stream(spark, sf_dir, vocab, sink, failures, F.col("lang") == "en")
    _stream(spark, sf_dir, vocab, sink, failures)
    return spark.read.parquet(sink).select("doc_id", joined("ids").alias("ids"))


@query
def incremental_encode_repeats(spark, sf_dir):
    """Three documents share an id each, in one micro-batch or in two: every text is in the sink or named with a cause."""
    vocab = vocabulary.fit_vocab(fx.document_tokens(spark, sf_dir), fx.CAP)
    source, sink, failures, progress = (staged_path(spark, name) for name in ("arriving", "sink", "failures", "progress"))
    documents = fx.pairs(spark, sf_dir)
    schema = "doc_id BIGINT, articles STRING"
    for half in (0, 1):
        arriving = documents.filter(F.col("doc_id") % 2 == half)
        arriving.select(F.expr("doc_id div 3").alias("doc_id"), "articles").write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        encode_stream(stream, vocab, sink, failures, progress, fx.DOCUMENT_LENGTH, fx.CAP).awaitTermination()
    failed = spark.read.schema(schema + ", error STRING").parquet(failures).select("doc_id", "articles", "error")
    return spark.read.parquet(sink).select("doc_id", joined("ids").alias("ids")).unionByName(failed, allowMissingColumns=True)
