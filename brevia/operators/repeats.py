"""Repeated n-grams of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brevia.functions.text import ngrams, white_space_words


def repeated_ngrams(df: DataFrame, n: int, text: str = "text", out: str = "repeated") -> DataFrame:
    """The n-grams a text holds more than once, in order of first appearance.

    Each text is handled inside its row: its n-grams are sorted with their places, so equal ones are neighbours and the
    first of each run is its first appearance. Nothing is shuffled and the cost is that of one sort per text.
    """
    words = df.withColumn("_words", white_space_words(F.col(text)))
    placed = F.transform(ngrams(F.col("_words"), n), lambda gram, at: F.struct(gram.alias("gram"), at.alias("at")))
    runs = words.withColumn("_runs", F.sort_array(placed))

    def starts_run(item, at):
        before, after = F.get("_runs", at - 1)["gram"], F.get("_runs", at + 1)["gram"]
        return ((at == 0) | (before != item["gram"])) & (after == item["gram"])

    firsts = runs.withColumn("_firsts", F.filter("_runs", starts_run))
    by_place = F.sort_array(F.transform("_firsts", lambda x: F.struct(x["at"].alias("at"), x["gram"].alias("gram"))))
    return firsts.withColumn(out, F.transform(by_place, lambda x: x["gram"])).drop("_words", "_runs", "_firsts")
