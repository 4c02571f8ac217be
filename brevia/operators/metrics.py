"""Loss and accuracy over tables of token predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brevia.constants import PADDING_ID
from brevia.operators.numbering import running_total


def _sum(values: str) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def softmax(df: DataFrame, keys: list[str], score: str = "logit", out: str = "prob") -> DataFrame:
    """Scores to probabilities among the candidates of each key, at most one per word of the vocabulary.

    A key's candidates meet in one row, so they are shuffled once and never sorted.
    """
    rows = df.groupBy(*keys).agg(F.collect_list(F.struct(*(c for c in df.columns if c not in keys))).alias("_rows"))
    shifted = F.transform("_rows", lambda r: F.exp(r[score] - F.col("_top")))
    rows = rows.withColumn("_top", F.array_max(F.transform("_rows", lambda r: r[score]))).withColumn("_raised", shifted)
    rows = rows.withColumn("_total", _sum("_raised")).select(
        *keys, "_total", F.inline(F.arrays_zip("_rows", "_raised")).alias("_row", "_part"))
    others = (F.col(f"_row.{c}").alias(c) for c in df.columns if c not in keys)
    return rows.select(*keys, *others, (F.col("_part") / F.col("_total")).alias(out)).select(*df.columns, out)


def token_loss(df: DataFrame, keys: list[str], score: str = "logit", is_real: str = "is_real") -> DataFrame:
    """Cross entropy of each position from raw scores: logsumexp less the label's score.

    A position's scores, at most one per word of the vocabulary, meet in one row and are not sorted.
    """
    rows = df.groupBy(*keys).agg(
        F.collect_list(score).alias("_scores"), F.max(score).alias("_top"),
        F.max(F.when(F.col(is_real), F.col(score))).alias("_real"),
    )
    raised = rows.withColumn("_raised", F.transform("_scores", lambda x: F.exp(x - F.col("_top"))))
    return raised.select(*keys, (F.ln(_sum("_raised")) + F.col("_top") - F.col("_real")).alias("loss"))


def batch_loss(preds: DataFrame, keys: tuple[str, ...] = ("epoch", "step", "batch")) -> DataFrame:
    """Mean loss of each batch over its positions whose label is not padding."""
    counted = F.col("real") != PADDING_ID
    return preds.groupBy(*keys).agg(
        (F.sum(F.when(counted, F.col("loss"))) / F.count_if(counted)).alias("loss")
    )


def _correct(mask: bool) -> tuple[Column, Column]:
    counted = (F.col("real") != PADDING_ID) if mask else F.lit(True)
    return F.count_if(counted & (F.col("pred") == F.col("real"))), F.count_if(counted)


def token_accuracy(
    preds: DataFrame, scope: tuple[str, ...] = ("epoch",), mask: bool = False
) -> DataFrame:
    """Share of positions whose best word is the label. Padding counts unless ``mask`` is set."""
    correct, positions = _correct(mask)
    return preds.groupBy(*scope).agg((correct / positions).alias("accuracy"))


def running_accuracy(preds: DataFrame, mask: bool = False) -> DataFrame:
    """Accuracy at the end of each epoch and step when it is never reset. The window sees one row per step."""
    correct, positions = _correct(mask)
    steps = preds.groupBy("epoch", "step").agg(correct.alias("_correct"), positions.alias("_positions"))
    so_far = Window.orderBy("epoch", "step").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("_correct").over(so_far) / F.sum("_positions").over(so_far)
    return steps.select("epoch", "step", share.alias("accuracy"))


def epoch_loss(losses: DataFrame, scope: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """Mean of the batch means, each batch counting the same, and the number of batches."""
    return losses.groupBy(*scope).agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("batches"))


def running_loss(losses: DataFrame) -> DataFrame:
    """Total loss of a step after each of its batches."""
    return running_total(losses, ["epoch", "step"], "batch", "loss", "running_loss")


def curriculum_loss(losses: DataFrame, mode: str = "as_printed") -> DataFrame:
    """Epoch loss of curriculum training.

    ``as_printed`` adds the running step total after every batch, so batch ``b`` of ``N`` counts ``N - b`` times (from 0).
    That weight turns the running totals into a plain aggregation. ``mean`` is the mean of the batch means.
    """
    if mode not in ("as_printed", "mean"):
        raise ValueError("mode must be as_printed or mean")
    if mode == "mean":
        return epoch_loss(losses)
    steps = losses.groupBy("epoch", "step").agg(
        F.count(F.lit(1)).alias("_batches"),
        F.sum("loss").alias("_sum"),
        F.sum(F.col("loss") * F.col("batch")).alias("_weighted"),
    )
    printed = F.sum(F.col("_batches") * F.col("_sum") - F.col("_weighted"))
    return steps.groupBy("epoch").agg(
        (printed / F.sum("_batches")).alias("loss"), F.sum("_batches").alias("batches")
    )


def epoch_report(losses: DataFrame, preds: DataFrame) -> DataFrame:
    """One report row per epoch: loss, batches and accuracy in percent."""
    accuracy = token_accuracy(preds).select("epoch", (F.col("accuracy") * 100).alias("accuracy"))
    return epoch_loss(losses).join(accuracy, "epoch")


def curriculum_epoch_report(losses: DataFrame, preds: DataFrame, mode: str = "as_printed") -> DataFrame:
    """One report row per epoch of curriculum training: loss, batches and the never-reset accuracy in percent."""
    accuracy = running_accuracy(preds).groupBy("epoch").agg((F.max_by("accuracy", "step") * 100).alias("accuracy"))
    return curriculum_loss(losses, mode).join(accuracy, "epoch")


def curriculum_report(losses: DataFrame, preds: DataFrame) -> DataFrame:
    """One report row per epoch and step: loss, batches and the never-reset accuracy in percent."""
    accuracy = running_accuracy(preds).select("epoch", "step", (F.col("accuracy") * 100).alias("accuracy"))
    return epoch_loss(losses, ("epoch", "step")).join(accuracy, ["epoch", "step"])
