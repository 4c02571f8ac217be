import random

import pytest
from brevia.llm import mixing
from pyspark.sql import functions as F

SCHEMA = "doc_id BIGINT, source STRING, text STRING"


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by handing out what is left again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left = dict.fromkeys(order, 0.0), share * sum(sizes.values())
    while left > 1e-9:
        free = [s for s in order if target[s] < most * sizes[s] - 1e-9]
        if not free:
            break
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - most * sizes[s]) for s in free)
        for s in free:
            target[s] = min(target[s], most * sizes[s])
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10, None: 10}, {"a": 1, "b": 1000, "c": 5, "d": 80, "é": 3, "z": 900}, {"a": 0, "b": 7}, {"a": 0}, {},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source STRING, source_size BIGINT")
    found = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert found == pytest.approx(water(sizes))


def documents(spark):
    pick = random.Random(0)
    rows = [(i, pick.choice("aaaabcd"), "w " * pick.randrange(1, 60)) for i in range(3000)]
    return spark.createDataFrame(rows + [(4000, None, "x y"), (4001, "a", None), (4002, "b", ""), (None, "c", "q")], SCHEMA)


def test_rates_copies_and_reruns(spark):
    df = documents(spark)
    rows = mixing.with_copies(df).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.with_copies(df.repartition(7)).collect()), key=str)
    taken = {}
    for r in rows:
        rate = r.target / r.source_size
        assert int(rate) <= r.copies <= int(rate) + (rate > int(rate)) and r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
    targets = {r.source: r.target for r in rows}
    assert all(taken[s] == pytest.approx(targets[s], rel=0.1) for s in "abcd")
    assert {r.doc_id: r["size"] for r in rows if r.doc_id in (4000, 4001, 4002)} == {4000: 2, 4001: 0, 4002: 0}


def test_mix_emits_the_copies_and_keeps_columns(spark):
    df = documents(spark).withColumns({"Size": F.lit("mine"), "copies": F.lit("mine too"), "h0_": F.lit(1)})
    planned = {(r.doc_id, r.source, r.text): r.copies for r in mixing.with_copies(documents(spark)).collect()}
    found = {}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    for r in mixed.collect():
        assert (r["Size"], r["copies"]) == ("mine", "mine too")
        found[r.doc_id, r.source, r.text] = found.get((r.doc_id, r.source, r.text), 0) + 1
    assert found == {k: n for k, n in planned.items() if n}


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(documents(spark).limit(0)).count() == 0
    blank = spark.createDataFrame([(1, "a", ""), (2, None, None)], SCHEMA)
    assert [(r.target, r.copies) for r in mixing.with_copies(blank).collect()] == [(0.0, 0)] * 2
