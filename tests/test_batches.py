"""Batches laid out in files and read back by range."""

import pytest
from brevia.sources import batches
from pyspark.sql import functions as F


def _rows(spark, epochs=2, count=50, size=4):
    rows = [(e, i // size, i % size, i * 10 + e, [i, e]) for e in range(1, epochs + 1) for i in range(count)]
    return spark.createDataFrame(rows, "epoch INT, batch BIGINT, place INT, doc_id BIGINT, input ARRAY<INT>")


def _ordered(df):
    return sorted(map(tuple, df.select("epoch", "batch", "place", "doc_id", "input").collect()))


def test_ranges_of_batches_are_whole_and_open_their_files_only(spark, tmp_path):
    path, rows = str(tmp_path / "laid"), _rows(spark)
    batches.write_batches(rows.repartition(7), path, file_batches=3)
    assert sorted(map(tuple, batches.batch_counts(spark, path).collect())) == [(1, 13, 3), (2, 13, 3)]
    for first, last in ((0, None), (0, 0), (4, 7), (12, 12), (11, 99)):
        found = batches.read_batches(spark, path, 2, first, last)
        wanted = rows.filter((F.col("epoch") == 2) & F.col("batch").between(first, 99 if last is None else last))
        assert _ordered(found) == _ordered(wanted)
    touched = batches.read_batches(spark, path, 2, 4, 7)
    files = {r[0] for r in touched.select(F.input_file_name()).collect()}
    assert len(files) == 2 and all("epoch=2/part=" in f for f in files)
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "Exchange" not in plan
    assert batches.read_batches(spark, path, 2, 13).count() == 0 and batches.read_batches(spark, path, 9).count() == 0


def test_rows_of_a_file_lie_in_order(spark, tmp_path):
    batches.write_batches(_rows(spark).repartition(7), str(tmp_path / "laid"), file_batches=3)
    files = sorted((tmp_path / "laid").glob("epoch=*/part=*/*.parquet"))
    assert len(files) == 10
    for file in files:
        at = [(r.batch, r.place) for r in spark.read.parquet(str(file)).coalesce(1).collect()]
        assert at == sorted(at) and len({b // 3 for b, _ in at}) == 1


def test_a_layout_that_stopped_is_not_read(spark, tmp_path):
    path = str(tmp_path / "laid")
    _rows(spark).withColumn("part", F.lit(0)).write.partitionBy("epoch", "part").parquet(path)
    with pytest.raises(Exception, match="_layout"):
        batches.read_batches(spark, path, 1)
    with pytest.raises(ValueError, match="at least 1"):
        batches.write_batches(_rows(spark), str(tmp_path / "other"), 0)


def test_an_epoch_has_a_bounded_number_of_files(spark, tmp_path, monkeypatch):
    """Where files would be too many each holds a multiple of the batches asked for; ranges are read as before."""
    monkeypatch.setattr(batches, "MOST_FILES", 4)
    path, rows = str(tmp_path / "laid"), _rows(spark)
    for place, given in ((path, None), (path + "-given", 13)):
        batches.write_batches(rows.repartition(7), place, 2, given)
        assert sorted(map(tuple, batches.batch_counts(spark, place).collect())) == [(1, 13, 4), (2, 13, 4)]
    assert len(list((tmp_path / "laid").glob("epoch=1/part=*/*.parquet"))) == 4
    for first, last in ((0, None), (3, 3), (5, 9), (12, 99)):
        wanted = rows.filter((F.col("epoch") == 1) & F.col("batch").between(first, 99 if last is None else last))
        assert _ordered(batches.read_batches(spark, path, 1, first, last)) == _ordered(wanted)
