import random

from brevia.llm import language_id
from pyspark.sql import functions as F

SYLLABLES = {"xx": ["bal", "dor", "fin", "gam"], "yy": ["qui", "rez", "tus", "vox"]}


def text(lang, words, seed):
    pick = random.Random(seed)
    return " ".join("".join(pick.choices(SYLLABLES[lang], k=2)) for _ in range(words))


def corpus(spark):
    rows = [(i, text(lang, 80, f"{lang}{i}"), lang) for i in range(40) for lang in SYLLABLES]
    rows += [(100, "copy of one text " * 5, "xx")] * 60
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")


CASES = [
    (1, text("xx", 30, 1), "xx"), (2, text("yy", 30, 2), "yy"), (3, text("yy", 200_000, 3), "yy"),
    (4, None, "und"), (5, "", "und"), (6, "12 34 !? \n", "und"), (None, text("xx", 9, 4), "xx"),
    (7, text("xx", 30, 1), "xx"), (7, text("xx", 30, 1), "xx"),
]


def test_predictions_and_edge_cases(spark):
    model = language_id.fit(corpus(spark))
    assert set(model.languages) == {"xx", "yy"} and model.languages[0] == "xx"
    assert all(0 < len(d) <= language_id.DICTIONARY_BYTES for d in model.dictionaries)
    df = spark.createDataFrame([(i, t) for i, t, _ in CASES], "doc_id BIGINT, text STRING")
    df = df.withColumns({c: F.lit("mine") for c in ("Score", "found_", "lang")})
    found = language_id.identify(df, model)
    assert found.columns == ["doc_id", "text", "found_", "lang", "lang_pred", "score", "accepted"]
    rows = found.collect()
    assert [r.lang_pred for r in rows] == [c[2] for c in CASES]
    assert all(0 <= r.score <= 1 for r in rows)
    assert [r.accepted for r in rows] == [c[2] != "und" for c in CASES]


def test_narrow_margins_are_rejected(spark):
    model = language_id.fit(corpus(spark))
    mixed = " ".join(text(lang, 200, i) for i in range(6) for lang in SYLLABLES)
    df = spark.createDataFrame([(mixed,)], "text STRING")
    assert not language_id.identify(df, model, margin=0.2).first().accepted


def test_fit_does_not_depend_on_order_and_ignores_unusable_rows(spark):
    rows = corpus(spark)
    extra = spark.createDataFrame([(1, None, "xx"), (2, "12", "zz"), (3, "abc", None)], rows.schema)
    assert language_id.fit(rows) == language_id.fit(rows.union(extra).repartition(5, F.rand(3)))


def test_without_languages(spark):
    empty = corpus(spark).limit(0)
    model = language_id.fit(empty)
    assert model.languages == () and language_id.identify(empty, model).count() == 0
    row = language_id.identify(corpus(spark).limit(1), model).first()
    assert (row.lang_pred, row.score, row.accepted) == ("und", 0.0, False)
