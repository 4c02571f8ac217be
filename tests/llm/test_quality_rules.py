import brute
import pytest
from brevia.llm import quality_rules
from pyspark.sql import functions as F

PROSE = " ".join(f"word{i} is here" for i in range(20))


@pytest.mark.parametrize("line, rule", [
    ("One plain sentence, with 3 words & a sign.", None),
    ("of*** the### and$$$", "punctuation"), ("THIS!! IS!! LOUD!!", "punctuation"), ("ALL IN CAPITALS", "punctuation"),
    ("home | news | about", "navigation"), ("Back to top", "navigation"), ("Sign In:", "navigation"),
    ("(c) 2020 All Rights Reserved.", "boilerplate"), ("go go go go go", "repetition"), ("so so it goes", None), ("OK THEN", None),
])
def test_lines(line, rule):
    assert quality_rules.failure(line, quality_rules.Rules()) == rule


@pytest.mark.parametrize("text", [
    "a b c d e f g h a b c d e f g h", "x " * 9, "x " * 8, "a b c d e f g h i j k l m", "",
    "p q r s t u v w x p q r s t u v w y q r s t u v w y", " ".join("abcab" * 30), "é è " * 12,
])
def test_repeated_words_as_brute_force(text):
    assert quality_rules.repeated_words(text.encode().split()) == brute.repeated_words(text)


def test_documents_and_edge_cases(spark):
    rows = [
        (1, PROSE), (2, PROSE + "\n" + "a | b\n" * 5), (3, "w1 | w2 | w3\n" * 60 + "one line"), (4, "too short"), (5, None), (6, ""),
        (7, "go on now then up to it all " * 20), (8, PROSE + "\n\n" + "All rights reserved.\nAll rights reserved."),
        (9, "\n".join(PROSE for _ in range(2000))), (None, PROSE), (1, PROSE),
    ]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumns({"KEPT": F.lit(1), "found_": F.lit(2)})
    found = quality_rules.apply_rules(df)
    assert "KEPT" not in found.columns and "found_" in found.columns
    got = [(r.doc_id, r.base_failed, r.kept) for r in found.collect()]
    assert got == [
        (1, False, True), (2, False, True), (3, True, False), (4, True, False), (5, True, False), (6, True, False),
        (7, True, False), (8, False, True), (9, True, False), (None, False, True), (1, False, True)]
    eighth = [r for r in found.collect() if r.doc_id == 8][0]
    assert eighth.cleaned == PROSE + "\n" and eighth.boilerplate == 2 and eighth.n_dup_lines == 1
    junk = PROSE + "\n" + "\n".join(f"a{i}*** b{i}### c{i}$$$ d{i}%%%" for i in range(40))
    assert not quality_rules.assess(junk)["base_failed"] and not quality_rules.assess(junk)["kept"]
    assert quality_rules.apply_rules(df.limit(0)).count() == 0
