"""Column functions over probabilities and scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from brevia.constants import LENGTH_ALPHA

SCORE_DIGITS = 9


def log_prob(prob: Column) -> Column:
    """Natural logarithm; NULL for zero, which callers route to the failure table."""
    return F.when(prob > 0, F.ln(prob))


def length_norm(score: Column, length: Column, alpha: float = LENGTH_ALPHA) -> Column:
    """Score divided by ``length ** alpha``."""
    return score / F.pow(length.cast("double"), F.lit(alpha))


def rank_score(score: Column) -> Column:
    """Rounded score to rank on: sums of logarithms may differ in the last bit between orders of addition."""
    return F.round(score, SCORE_DIGITS)
