import random

import numpy as np
import pytest
from brevia.llm import boosted_trees, quality_model
from brevia.llm.boosted_trees import Settings
from pyspark.sql import functions as F


def walk(forest, row):
    """One row down each tree, node by node."""
    total = forest.base
    for root in forest.roots:
        at = root
        while forest.left[at] != at:
            at = forest.right[at] if row[forest.feature[at]] > forest.threshold[at] else forest.left[at]
        total += forest.value[at]
    return 1 / (1 + np.exp(-total))


def test_trees_learn_and_flat_arrays_score_like_a_walk():
    pick = np.random.default_rng(0)
    rows = pick.standard_normal((2000, 5))
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 3] < -0.5)).astype(int)
    forest = boosted_trees.train(rows[:1500], labels[:1500], Settings(trees=40, least_rows=5))
    scores = forest.scores(rows[1500:])
    assert ((scores > 0.5) == labels[1500:]).mean() > 0.95
    assert scores[:50] == pytest.approx([walk(forest, row) for row in rows[1500:1550]])


@pytest.mark.parametrize("labels", [[], [1, 1, 1], [0]])
def test_one_label_or_none(labels):
    forest = boosted_trees.train(np.zeros((len(labels), 3)), np.array(labels), Settings())
    scores = forest.scores(np.array([[1.0, np.nan, np.inf]]))
    assert len(forest.roots) == 0 and 0 < scores[0] < 1 and len(forest.scores(np.zeros((0, 3)))) == 0


@pytest.mark.parametrize("text", [None, "", " \n", "x", "é" * 10, "a b\n\nc.", "w " * 200_000])
def test_statistics_are_finite(text):
    found = quality_model.statistics(text)
    assert len(found) == len(quality_model.FEATURES) and np.isfinite(found).all()


def documents(spark):
    pick = random.Random(2)
    rows = []
    for i in range(600):
        words = [f"w{pick.randrange(900)}" for _ in range(pick.randrange(5, 80))]
        good = i % 4 > 0
        rows.append((i, (" ".join(words) + ".") if good else "### ".join(words), int(good)))
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, quality INT")
    return df.drop("quality"), df.drop("text")


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = documents(spark)
    odd = spark.createDataFrame([(None, 1), (3, None), (5, 1), (5, 1), (99_999, 0)], labels.schema)
    forest = quality_model.fit(docs, labels.filter("doc_id < 400").union(odd))
    again = quality_model.fit(docs.repartition(5), labels.filter("doc_id < 400").union(odd))
    assert (forest.value == again.value).all() and (forest.threshold == again.threshold).all()
    extra = spark.createDataFrame([(None, None), (1000, ""), (1000, "")], docs.schema)
    scored = quality_model.score(docs.union(extra).withColumns({"SCORE": F.lit(1), "value_": F.lit(2)}), forest)
    assert [c for c in scored.columns if c.lower() == "score"] == ["score"] and "value_" in scored.columns
    rows = scored.collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r.predicted == truth[r.doc_id] for r in rows if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert np.mean(held) > 0.97 and all(0 <= r.score <= 1 for r in rows) and len(rows) == 603
    assert quality_model.score(docs.limit(0), forest).count() == 0
    assert len(quality_model.fit(docs, labels.limit(0)).roots) == 0


def test_the_sample_is_bounded(spark):
    docs, labels = documents(spark)
    forest = quality_model.fit(docs, labels, sample=50)
    assert len(forest.roots) > 0
