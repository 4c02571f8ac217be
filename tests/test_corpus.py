"""Reading files with broken records, and numbers by place."""

import pytest
from brevia.sources import corpus
from pyspark.sql import functions as F

NAMES = ("id", "art", "abs")


def written(folder, **files):
    folder.mkdir()
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)
    return str(folder)


def checked(spark, path, fmt, columns=NAMES, required=("art",), **options):
    good, bad = corpus.read_checked(spark, path, fmt, columns, required, **options)
    return sorted(map(tuple, good.collect()), key=str), sorted(
        (r.error, r.raw, r[columns[0]], r.file.rsplit("/", 1)[1]) for r in bad.collect())


def test_csv_rows_with_other_fields_are_named(spark, tmp_path):
    path = written(
        tmp_path / "c", a__csv='id,art,abs\n1,"x\ny ""q""","z"\n2\n3,a,b,c,d\n4,,"k"\n', b__csv="id,art,abs\n6,u,v\n7,u,\n")
    good, bad = checked(spark, path, "csv")
    assert good == [("1", 'x\ny "q"', "z"), ("6", "u", "v"), ("7", "u", None)]
    assert bad == sorted([
        ("malformed record", "2", None, "a.csv"), ("malformed record", "3,a,b,c,d", None, "a.csv"),
        ("missing text in column art", None, "4", "a.csv")], key=str)
    some, bad = checked(spark, path, "csv", ("abs", "id"), ())
    assert len(some) == 4 and len(bad) == 2


def test_lines_that_are_no_object_are_named(spark, tmp_path):
    lines = ['{"id":"1","art":"x","abs":{"k":[1, 2]}}', '{"id": "2", "art": "cut', "3", "null", '"s"', "", '{"abs":"t"}']
    good, bad = checked(spark, written(tmp_path / "j", a__json="\n".join(lines)), "json")
    assert good == [("1", "x", '{"k":[1, 2]}')]
    assert [b[:2] for b in bad if b[1]] == sorted(("malformed record", line) for line in (lines[1], "3", "null", '"s"'))
    assert len(bad) == 5


def test_names_that_clash_and_empty_files(spark, tmp_path):
    path = written(tmp_path / "n", a__json='{"_raw":"r","art":"a"}\n{')
    good, bad = checked(spark, path, "json", ("_raw", "art"))
    assert good == [("r", "a")] and [b[:2] for b in bad] == [("malformed record", "{")]
    assert checked(spark, written(tmp_path / "e", a__json=""), "json") == ([], [])


def test_parquet_lacks_texts_only(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, "a", None), (2, None, "b")], "id INT, art STRING, abs STRING").write.parquet(path)
    good, bad = checked(spark, path, "parquet")
    assert good == [("1", "a", None)] and [(b[0], b[2]) for b in bad] == [("missing text in column art", "2")]


def test_a_column_that_is_not_there_is_an_error(spark, tmp_path):
    path = written(tmp_path / "m", a__csv="id,art\n1,x\n")
    with pytest.raises(Exception, match="abs"):
        corpus.read_checked(spark, path, "csv", NAMES)


def test_places_in_parquet_files_need_no_shuffle(spark, tmp_path):
    path = str(tmp_path / "f" / "eval_500_x.parquet")
    spark.range(0, 5000, 1, 3).withColumn("art", F.lit("t")).write.parquet(path)
    found = corpus.read_numbered(spark, path, "parquet", ("id",), start=10)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.num for r in found.collect())[:4] == [10, 10, 10, 11]


def test_places_in_split_text_files(spark, tmp_path):
    path = written(tmp_path / "t", ev_70_x__json="".join(f'{{"id":"{i}"}}\n' for i in range(3000)), ev_9_y__json='{"id":"z"}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        found = {r.id: r.num for r in corpus.read_numbered(spark, path, "json", ("id",)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {**{str(i): 70 + i for i in range(3000)}, "z": 9}


def test_csv_files_of_rejected_rows_are_more_where_rows_are(spark, monkeypatch):
    import glob

    from brevia import session
    from brevia.plans import queries

    folder = session.shared_folder(spark).removeprefix("file:")
    found = {}
    for most in (5_000, 10):
        before = set(glob.glob(f"{folder}/brevia/*/csv-*"))
        monkeypatch.setattr(queries, "CSV_FILE_ROWS", most)
        found[most] = sorted(map(str, queries.corpus_rejected(spark, "/root/testdata/sf0.001").collect()))
        (written,) = set(glob.glob(f"{folder}/brevia/*/csv-*")) - before
        assert len(glob.glob(f"{written}/part=*/*.txt")) == (4 if most == 5_000 else 20)
    assert found[10] == found[5_000] and len(found[10]) == 400
