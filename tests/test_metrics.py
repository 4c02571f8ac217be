import math

import pytest
from brevia.operators import metrics
from pyspark.sql import functions as F

PREDS = [
    # epoch, step, batch, real, pred, loss
    (1, 1, 0, 5, 5, 1.0), (1, 1, 0, 0, 0, 9.0), (1, 1, 0, 6, 4, 3.0), (1, 1, 1, 5, 5, 4.0), (1, 2, 0, 7, 7, 6.0),
    (1, 2, 1, 7, 0, 2.0), (1, 2, 2, 0, 0, 8.0), (1, 2, 2, 3, 3, 1.0), (2, 1, 0, 3, 1, 5.0),
]


@pytest.fixture(scope="module")
def preds(spark):
    return spark.createDataFrame(PREDS, "epoch INT, step INT, batch BIGINT, real INT, pred INT, loss DOUBLE")


@pytest.fixture(scope="module")
def losses(preds):
    return metrics.batch_loss(preds)


def test_batch_loss_leaves_padding_out(losses):
    found = {(r.epoch, r.step, r.batch): r.loss for r in losses.collect()}
    assert found == {(1, 1, 0): 2.0, (1, 1, 1): 4.0, (1, 2, 0): 6.0, (1, 2, 1): 2.0, (1, 2, 2): 1.0, (2, 1, 0): 5.0}


def test_accuracy(preds):
    plain = dict(metrics.token_accuracy(preds).collect())
    assert plain == {1: pytest.approx(6 / 8), 2: 0.0}
    masked = dict(metrics.token_accuracy(preds, mask=True).collect())
    assert masked[1] == pytest.approx(4 / 6)
    running = {(r.epoch, r.step): r.accuracy for r in metrics.running_accuracy(preds).collect()}
    assert running == {(1, 1): 0.75, (1, 2): 0.75, (2, 1): pytest.approx(6 / 9)}


def test_epoch_loss_is_a_mean_of_means(losses):
    assert {r.epoch: (r.loss, r.batches) for r in metrics.epoch_loss(losses).collect()} == {1: (3.0, 5), 2: (5.0, 1)}


def test_curriculum_loss_as_printed(losses):
    # Running totals: step 1 gives 2, 6; step 2 gives 6, 8, 9.
    running = sorted(r.running_loss for r in metrics.running_loss(losses).collect() if r.epoch == 1)
    assert running == [2.0, 6.0, 6.0, 8.0, 9.0]
    printed = {r.epoch: r.loss for r in metrics.curriculum_loss(losses).collect()}
    assert printed == {1: pytest.approx(31 / 5), 2: 5.0}
    assert {r.epoch: r.loss for r in metrics.curriculum_loss(losses, "mean").collect()} == {1: 3.0, 2: 5.0}
    with pytest.raises(ValueError):
        metrics.curriculum_loss(losses, "other")


def test_softmax_and_cross_entropy_with_large_scores(spark):
    scores = [1000.0, 1001.0, 999.0]
    rows = [(1, t, s, t == 1) for t, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "pos INT, token_id INT, logit DOUBLE, is_real BOOLEAN")
    total = sum(math.exp(s - 1001) for s in scores)
    probs = {r.token_id: r.prob for r in metrics.softmax(df, ["pos"]).collect()}
    assert probs == {t: pytest.approx(math.exp(s - 1001) / total) for t, s in enumerate(scores)}
    assert metrics.token_loss(df, ["pos"]).first().loss == pytest.approx(math.log(total))


def test_reports(preds, losses):
    report = {r.epoch: (r.loss, r.batches, r.accuracy) for r in metrics.epoch_report(losses, preds).collect()}
    assert report == {1: (3.0, 5, pytest.approx(75.0)), 2: (5.0, 1, 0.0)}
    steps = metrics.curriculum_report(losses, preds).filter((F.col("epoch") == 1) & (F.col("step") == 2)).first()
    assert (steps.loss, steps.batches, steps.accuracy) == (3.0, 3, 75.0)
