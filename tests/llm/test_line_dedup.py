import pytest
from brevia.llm import line_dedup
from pyspark.sql import functions as F

SCHEMA = "doc_id BIGINT, source STRING, text STRING"


def brute(rows, ratio=0.1, least=3):
    def key(line):
        return line.strip(" \t\r")

    totals, found = {}, {}
    for _, host, text in rows:
        totals[host] = totals.get(host, 0) + 1
        for line in {key(x) for x in (text or "").split("\n")} - {""}:
            found[host, line] = found.get((host, line), 0) + 1
    out = []
    for doc, host, text in rows:
        if text is None:
            out.append((doc, host, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [
            x for x in lines
            if not key(x) or found[host, key(x)] < least or found[host, key(x)] <= ratio * totals[host]
        ]
        out.append((doc, host, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(spark, rows, **settings):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, line_dedup.drop_boilerplate(df, **settings).collect()), key=str)


ROWS = (
    [(i, "a", f"menu\nbody {i}\n \n  menu\t") for i in range(12)]
    + [(20 + i, "b", f"menu\nother {i % 2}") for i in range(4)]
    + [(30, "b", "menu")] * 2
    + [(40, "c", "menu\nown"), (41, "c", ""), (42, "c", None), (43, None, "x\ny"), (44, None, "x"), (45, None, "x"), (None, "a", "q")]
)


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_as_brute_force_with_small_and_large_lists(spark, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert run(spark, ROWS) == brute(ROWS)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ratio_and_least_pages(spark):
    assert run(spark, ROWS, ratio=0.6, least_pages=2) == brute(ROWS, 0.6, 2)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("mine") for c in ("site_", "CUT_", "rows_", "N_LINES", "host")})
    found = line_dedup.drop_boilerplate(df)
    assert found.columns == ["doc_id", "source", "text", "site_", "CUT_", "rows_", "host", "n_lines", "n_dropped"]
    assert {r["CUT_"] for r in found.collect()} == {"mine"}


def test_very_long_text(spark):
    rows = [(i, "a", "\n".join(["menu"] + [f"{i} {j}" for j in range(50_000)])) for i in range(3)]
    assert [r[3:] for r in run(spark, rows)] == [(50_001, 1)] * 3


def test_host_of(spark):
    urls = ["https://User@Blog.Example.com:80/x?y", "http://a.b", "mailto:x", None, ""]
    df = spark.createDataFrame([(u,) for u in urls], "url STRING")
    assert [r[0] for r in df.select(line_dedup.host_of(F.col("url"))).collect()] == ["blog.example.com", "a.b", None, None, None]


def test_no_python_on_the_main_path(spark):
    plan = line_dedup.drop_boilerplate(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
