import pytest
from brevia.functions import sequences as seq
from brevia.operators import batching
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def ids(spark):
    rows = [(n, list(range(2, 2 + n))) for n in (0, 1, 3, 4, 5)]
    return spark.createDataFrame(rows, "doc_id BIGINT, ids ARRAY<INT>")


def column(df, expression):
    return {r.doc_id: r.v for r in df.select("doc_id", expression.alias("v")).collect()}


def test_pad_truncate(ids):
    found = column(ids, seq.pad_truncate(F.col("ids"), 4))
    assert found == {n: (list(range(2, 2 + n)) + [0] * 4)[:4] for n in (0, 1, 3, 4, 5)}


def test_mask_and_counts(ids):
    padded = ids.withColumn("ids", seq.pad_truncate(F.col("ids"), 4))
    assert column(padded, seq.padding_mask(F.col("ids")))[3] == [0.0, 0.0, 0.0, 1.0]
    assert column(padded, seq.valid_length(F.col("ids"))) == {0: 0, 1: 1, 3: 3, 4: 4, 5: 4}


def test_shift(ids):
    inputs, labels = column(ids, seq.shift_input(F.col("ids"))), column(ids, seq.shift_label(F.col("ids")))
    for n in (0, 1, 3, 4, 5):
        whole = list(range(2, 2 + n))
        assert inputs[n] == whole[:-1] and labels[n] == whole[1:]
    rows = batching.next_token_rows(ids, ["doc_id"]).collect()
    assert len(rows) == 0 + 0 + 2 + 3 + 4 and all(r.real == r.prev + 1 == r.pos + 3 for r in rows)


def test_chunks(spark):
    whole = list(range(12))
    df = spark.createDataFrame([(1, whole)], "doc_id BIGINT, ids ARRAY<INT>")
    chunks = column(df, seq.split_chunks(F.col("ids"), 12, 4))[1]
    assert chunks == [whole[i:i + 3] for i in (0, 3, 6, 9)]
    rows = spark.createDataFrame([(1, c, chunks[c]) for c in (2, 0, 3, 1)], "doc_id BIGINT, chunk INT, ids ARRAY<INT>")
    assert batching.concat_chunks(rows).first().ids == whole
    with pytest.raises(ValueError):
        seq.split_chunks(F.col("ids"), 12, 5)


def test_step_size_rounds_half_to_even(spark):
    assert [seq.step_size(n, 8) for n in (100, 108, 216, 2000)] == [12, 14, 27, 250]
    assert seq.step_size(216, 5) == 43
    df = spark.createDataFrame([(n,) for n in (100, 108, 216, 2000)], "n INT")
    assert [r[0] for r in df.select(seq.step_size_column(F.col("n"), F.lit(8))).collect()] == [12, 14, 27, 250]


@pytest.mark.parametrize("steps", [8, 5])
def test_prefix_keep(spark, steps):
    size = seq.step_size(216, steps)
    df = spark.createDataFrame([(1, list(range(1, 217)))], "doc_id BIGINT, target ARRAY<INT>")
    rows = batching.prefix_curriculum(batching.expand_steps(df, steps, 2), size).collect()
    assert len(rows) == 2 * steps
    for row in rows:
        keep = row.step * size
        assert row.target == [i if i <= keep else 0 for i in range(1, 217)]


@pytest.mark.parametrize("tokens, cut", [
    ([9, 3, 4, 7, 5, 7], [3, 4]), ([9, 7, 3], []), ([9, 3, 4], [3, 4]), ([9], []), ([9, 3, 7], [3]),
])
def test_cut_summary(spark, tokens, cut):
    df = spark.createDataFrame([(1, tokens)], "doc_id BIGINT, ids ARRAY<INT>")
    assert column(df, seq.cut_summary(F.col("ids"), 7))[1] == cut


def test_batches(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    rows = batching.assign_batches(df, 32, epochs=2, seed=1).collect()
    orders = {}
    for epoch in (1, 2):
        places = {(r.batch, r.place): r.doc_id for r in rows if r.epoch == epoch}
        assert set(places) == {(i // 32, i % 32) for i in range(1000)}
        orders[epoch] = [places[k] for k in sorted(places)]
        assert sorted(orders[epoch]) == list(range(1000)) != orders[epoch]
    assert orders[1] != orders[2]
    again = batching.assign_batches(df.repartition(3), 32, epochs=2, seed=1).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_batches_do_not_gather_an_epoch(spark):
    df = spark.range(10).withColumnRenamed("id", "doc_id")
    plan = batching.assign_batches(df, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number() windowspecdefinition(epoch" in plan
    assert "SinglePartition" not in plan
