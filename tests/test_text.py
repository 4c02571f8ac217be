import models
import pytest
from brevia.functions import text
from brevia.operators.repeats import repeated_ngrams
from brevia.sources import corpus as source
from pyspark.sql import functions as F

TEXTS = [
    "", "   ", "!?.,", "One, two--three", "a\tb\nc", "CR\rinside", "nb sp", "x\x1cy  z", "ΑΣ İstanbul",
    "<go> it's <stop>", "a b a b a b", "\x85lead trail ", "a", "ﬃ ß ẞ", "[a]{b}\\c^d_e`f|g~h", "a  a  a",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id BIGINT, text STRING")


@pytest.mark.parametrize("mode, chars", [("filters", models.FILTERS), ("no_filters", set("\t\n"))])
def test_tokenise_like_python(texts, mode, chars):
    found = dict(texts.select("doc_id", text.tokenise(F.col("text"), mode)).collect())
    assert found == {i: models.words(t, chars) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_repeated_ngrams_like_python(texts, n):
    rows = repeated_ngrams(texts, n).collect()
    assert {r.doc_id: r.repeated for r in rows} == {i: models.repeated(t, n) for i, t in enumerate(TEXTS)}


def test_filter_mode_needs_exactly_one():
    assert text.filter_mode(True, False) == "filters"
    assert text.filter_mode(False, True) == "no_filters"
    for both in (True, False):
        with pytest.raises(ValueError):
            text.filter_mode(both, both)
    with pytest.raises(ValueError):
        text.tokenise(F.lit("a"), "other")


def test_wrap_and_length(texts):
    rows = texts.select("doc_id", text.wrap_target(F.col("text")).alias("w"), text.char_length(F.col("text")).alias("n"))
    for row in rows.collect():
        assert row.w == f"<go> {TEXTS[row.doc_id]} <stop>" and row.n == len(TEXTS[row.doc_id])


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(1, "a", "b"), (2, None, "b"), (3, "a", None)]
    return spark.createDataFrame(rows, "doc_id BIGINT, articles STRING, abstracts STRING")


def test_null_policies(gaps):
    literal = source.apply_null_policy(gaps, "literal").orderBy("doc_id").collect()
    assert [tuple(r) for r in literal] == [(1, "a", "b"), (2, "nan", "b"), (3, "a", "nan")]
    assert [r.doc_id for r in source.apply_null_policy(gaps, "drop").collect()] == [1]
    with pytest.raises(Exception, match="missing text in column"):
        source.apply_null_policy(gaps, "strict").collect()
    with pytest.raises(ValueError):
        source.apply_null_policy(gaps, "other")


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_read_corpus_as_strings(spark, tmp_path, fmt):
    rows = spark.createDataFrame([(7, "x y", "12")], "id_articles BIGINT, articles STRING, abstracts STRING")
    path = str(tmp_path / fmt)
    rows.write.format(fmt).option("header", "true").save(path)
    options = {"header": "true"} if fmt == "csv" else {}
    found = source.read_corpus(spark, path, fmt, **options)
    assert set(dict(found.dtypes).values()) == {"string"}
    assert [tuple(r) for r in found.collect()] == [("7", "x y", "12")]
    assert source.project_corpus(found).first().doc_id == 7


@pytest.mark.parametrize("small", [True, False])
def test_number_rows_from_file_names(spark, monkeypatch, small):
    monkeypatch.setattr(source, "fits_broadcast", lambda *_: small)
    rows = [(i, f"/d/x.y/test_{start}_{start + 9}.v2.xlsx") for start in (2499, 10) for i in range(start, start + 5)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, path STRING").repartition(3)
    assert all(r.num == r.doc_id for r in source.number_rows(df, "doc_id", "path").collect())
    fixed = source.number_rows(df, "doc_id", "path", start=0).collect()
    assert sorted(r.num for r in fixed) == sorted([*range(5), *range(5)])


def test_length_stats(spark):
    df = spark.createDataFrame([("a" * n,) for n in (1, 2, 2, 9)], "t STRING")
    row = source.length_stats(df, {"t": text.char_length(F.col("t"))}).first()
    assert (row.documents, row.shortest, row.longest, row.mean_length, row.median_length) == (4, 1, 9, 3.5, 2.0)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('id_articles,abstracts,articles\nPMC1,short,"long ""quoted""\ntext"\n')
    found = source.read_corpus(spark, str(path), "csv", path_column="file")
    row = found.first()
    assert (row.id_articles, row.articles, row.abstracts) == ("PMC1", 'long "quoted"\ntext', "short")
    assert row.file.endswith("c.csv") and found.count() == 1
    assert source.project_corpus(found, key_type="string").first().doc_id == "PMC1"
    with pytest.raises(Exception, match="missing"):
        source.read_corpus(spark, str(path), "csv", columns=("id_articles", "missing")).collect()
