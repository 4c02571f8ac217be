import math
import random
import warnings

import brute
import numpy as np
import pytest
from brevia.llm import nn_descent
from brevia.llm.queries import QUERIES
from pyspark.sql import functions as F

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def vectors(seed=0, dim=24):
    pick = np.random.default_rng(seed)
    rows = [v for v in pick.standard_normal((150, dim))]
    for size, noise in ((60, 0.05), (25, 0.12), (2, 0.1), (3, 0.3)):
        centre = pick.standard_normal(dim)
        rows += [centre + noise * pick.standard_normal(dim) for _ in range(size)]
    rows += [rows[3]] * 9 + [2.0 * rows[3]]
    return [[float(np.float32(x)) for x in row] for row in rows]


@pytest.mark.parametrize("block", [1024, 7])
def test_as_brute_force(spark, block):
    rows = list(enumerate(vectors()))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    found = {r.vec_id: r for r in nn_descent.near_duplicates(df, block=block).collect()}
    expected = brute.embedding_links(rows)
    true, got = sum(n for n, _ in expected.values()), sum(r.n_links for r in found.values())
    assert got >= 0.97 * true and all(r.n_links <= expected[v][0] for v, r in found.items())
    assert {v: r.component_id for v, r in found.items()} == {v: c for v, (_, c) in expected.items()}
    assert all(r.kept == (v == r.component_id) for v, r in found.items())


def test_vectors_that_link_with_nothing(spark):
    base = [1.0, 2.0, 3.0]
    rows = [
        (1, base), (2, base), (2, base), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 3.0]), (6, [1.0, math.nan, 3.0]),
        (7, [1.0, math.inf, 3.0]), (8, [1.0, 2.0]), (9, []), (None, [2.0, 4.0, 6.0]), (10, [-1.0, 0.0, 0.0]),
        (11, [1e-40, 2e-40, 3e-40]),
    ]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).withColumns({"rep": F.lit(1), "h1": F.lit(2)})
    found = sorted(map(tuple, nn_descent.near_duplicates(df).collect()), key=str)
    one = 4
    expected = [(1, one, 1, True), (2, one, 1, False), (2, one, 1, False), (None, one, 1, False), (11, one, 1, False)]
    expected += [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert found == sorted(expected, key=str)


def test_empty_table_and_no_usable_vector(spark):
    assert nn_descent.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, None, 0), (1, [0.0], 0)], SCHEMA)
    assert sorted(map(tuple, nn_descent.near_duplicates(df).collect())) == [(1, 0, 1, True)] * 2


def grouped_and_pairs(seed=3, dim=24):
    """A dense group of a third of the vectors, and lone pairs."""
    pick = np.random.default_rng(seed)
    centre = pick.standard_normal(dim)
    rows = [centre + 0.03 * pick.standard_normal(dim) for _ in range(200)]
    for _ in range(200):
        one = pick.standard_normal(dim)
        rows += [one, one + 0.3 * pick.standard_normal(dim)]
    return list(enumerate([[float(np.float32(x)) for x in row] for row in rows]))


def shares(df, rows, **settings):
    """Found and true links of each vector that has some."""
    expected = brute.embedding_links(rows)
    found = {r.vec_id: r for r in nn_descent.near_duplicates(df, **settings).collect()}
    return {v: found[v].n_links / n for v, (n, _) in expected.items() if n}


def poor_graph(monkeypatch):
    for name, value in {"TABLES": 1, "CHUNK": 16, "ROUNDS": 0}.items():
        monkeypatch.setattr(nn_descent, name, value)


def test_lone_pairs_count_beside_a_dense_group(spark, monkeypatch):
    poor_graph(monkeypatch)
    rows = grouped_and_pairs()
    found = shares(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), rows)
    assert np.mean([share for v, share in found.items() if v >= 200]) >= 0.95


def test_tables_follow_from_the_rows():
    agree = 1 - math.acos(0.9) / math.pi
    for rows in (10**3, 10**6, 10**8):
        together = agree ** math.log2(rows / nn_descent.CHUNK)
        assert 1 - (1 - together) ** nn_descent._tables(rows, 0.9, 0.97) >= 0.97
    assert nn_descent._tables(0, 0.9, 0.97) == nn_descent._tables(100, 0.9, 0.97) == nn_descent.TABLES


def test_all_links_where_the_target_is_not_reached(spark):
    rows = grouped_and_pairs()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        out = nn_descent.near_duplicates(df, target=1.1, block=50)
    found = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    assert found == brute.embedding_links(rows)


def of_all_lengths(rows):
    """What brute force gives for the vectors of each length."""
    expected = {}
    for size in {len(v) for _, v in rows}:
        expected.update(brute.embedding_links([(i, v) for i, v in rows if len(v) == size]))
    return expected


def mixed_lengths(seed=5):
    """Vectors of 24 components, fewer of 8 and of 7, and single ones of others; each with copies and near copies."""
    pick = np.random.default_rng(seed)
    rows = []
    for dim, count in ((24, 120), (8, 40), (7, 30), (1, 4), (64, 1), (65, 2)):
        for _ in range(count):
            one = pick.standard_normal(dim)
            rows += [one, one + 0.2 * pick.standard_normal(dim), one]
    return list(enumerate([[float(np.float32(x)) for x in row] for row in rows]))


@pytest.mark.parametrize("rare", [1024, 50])
def test_vectors_of_every_length_link(spark, monkeypatch, rare):
    monkeypatch.setattr(nn_descent, "RARE", rare)
    rows = mixed_lengths()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    found = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_duplicates(df).collect()}
    assert found == of_all_lengths(rows)


def test_registered_query_with_planted_links(spark, tmp_path):
    rows = list(enumerate(vectors(7))) + [(1000 + i, v) for i, v in mixed_lengths()]
    spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {r.vec_id: r for r in QUERIES["op8_nn_descent"](spark, str(tmp_path)).collect()}
    expected = of_all_lengths(rows)
    assert max(n for n, _ in expected.values()) > 50
    assert {v: (r.n_links, r.component_id, r.kept) for v, r in found.items()} == {
        v: (n, c, v == c) for v, (n, c) in expected.items()}


def test_a_large_component_is_dealt_to_parts(spark):
    pick = np.random.default_rng(2)
    centre = pick.standard_normal(24)
    rows = [(i, [float(x) for x in centre + 0.05 * pick.standard_normal(24)]) for i in range(300)]
    found = spark.createDataFrame([(0, i) for i, _ in rows] + [(1, 900)], "root BIGINT, rep BIGINT")
    parted = {(r.root, r.parts) for r in nn_descent._parts(found, 32).collect()}
    assert parted == {(0, 10), (1, 1)}
