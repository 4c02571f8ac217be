import random

import brute
import numpy as np
import pytest
from brevia.llm import simhash
from brevia.llm.components import components, spanning
from pyspark.sql import functions as F


def near(a, b):
    return bin(a ^ b).count("1") <= 4


def prints(seed, groups=6, size=40):
    """Random fingerprints, chains of few flipped bits around some of them, and copies."""
    pick = random.Random(seed)
    found = [pick.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1, 1, 31]
    for _ in range(groups):
        at = pick.getrandbits(64)
        for _ in range(size):
            for _ in range(pick.randrange(1, 6)):
                at ^= 1 << pick.randrange(64)
            found.append(at)
    return found + found[:20]


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


@pytest.mark.parametrize("block, batch", [(4096, 1 << 18), (3, 50), (2, 1)])
def test_classes_as_brute_force(spark, monkeypatch, block, batch):
    monkeypatch.setattr(simhash, "_BATCH", batch)
    found = prints(block)
    rows = [(i, signed(p)) for i, p in enumerate(found)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, print BIGINT")
    links = simhash.cell_links(simhash.grid(df.select("print").distinct()), block=block)
    # Links are between different fingerprints, none is wrong, and they connect what all links connect.
    got = {tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in links.collect()}
    assert all(a != b and near(a, b) for a, b in got)
    expected = brute.classes(set(found), near)
    assert brute.classes(set(found), lambda a, b: tuple(sorted((a, b))) in got) == expected
    classes = {r["print"] % 2**64: r.component_id for r in simhash.print_classes(df).collect()}
    least = {}
    for i, p in enumerate(found):
        least.setdefault(expected[p], i)
    assert classes == {p: least[expected[p]] for p in found}


def test_embedding_is_a_lower_bound_and_cells_meet():
    pick = random.Random(5)
    for _ in range(2000):
        a = pick.getrandbits(64)
        b = a
        for _ in range(pick.randrange(0, 5)):
            b ^= 1 << pick.randrange(64)
        x, y = (int(c) for c in simhash._counts(np.array([a, b], np.uint64)))
        assert bin(x ^ y).count("1") <= bin(a ^ b).count("1")


def test_cells_of_near_prints_meet(spark):
    pick = random.Random(6)
    rows = []
    for i in range(300):
        a = b = pick.getrandbits(64)
        for bit in pick.sample(range(64), pick.randrange(0, 5)):
            b ^= 1 << bit
        rows += [(2 * i, signed(a)), (2 * i + 1, signed(b))]
    df = spark.createDataFrame(rows, "id BIGINT, print BIGINT")
    cells = df.join(simhash.grid(df.select("print").distinct()), "print").select((F.col("id") / 2).cast("int").alias("pair"), "id", "cell")
    met = cells.groupBy("pair", "cell").agg(F.countDistinct("id").alias("n")).filter("n = 2")
    assert met.select("pair").distinct().count() == 300
    assert (simhash.embedding(F.lit(1)) is not None) and cells.groupBy("id").count().agg(F.max("count")).first()[0] <= 66


TEXTS = ["", None, " \n", "one", "One", "a b c", "a b c d", "A B C D e", "é É x Y z", "w " * 9, " ".join(f"w{i}" for i in range(70_000))]


def test_fingerprints_as_brute_force(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text STRING")
    got = [r[0] % 2**64 for r in df.select(simhash.fingerprints(F.col("text"))).collect()]
    assert got == [brute.fingerprint(t) for t in TEXTS]


def test_documents_and_edge_cases(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(5, long), (3, long + " x"), (3, long + " x"), (9, None), (8, ""), (None, long), (7, "other words in a text"), (None, "alone at last")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumns({"print": F.lit(1), "number_": F.lit(2)})
    found = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(found, key=str) == sorted([(5, 3), (3, 3), (3, 3), (9, 8), (8, 8), (None, 3), (7, 7), (None, None)], key=str)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in kept.filter("doc_id is not null").collect()) == [(3, "word0"), (7, "other"), (8, "")]
    assert kept.filter("doc_id is null").count() == 1
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.deduplicate(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(df, bits=5)


def test_components(spark):
    pick = random.Random(3)
    edges = [(pick.randrange(200), pick.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)]
    edges += [(500, i) for i in range(501, 560)] + [(7, 7)]
    df = spark.createDataFrame(edges + [(None, 3), (3, None)], "a BIGINT, b BIGINT")
    both = set(edges) | {(b, a) for a, b in edges}
    expected = brute.classes(sorted({n for e in edges if e[0] != e[1] for n in e}), lambda a, b: (a, b) in both)
    assert {r.node: r.root for r in components(df).collect()} == expected
    assert components(df.limit(0)).count() == 0


def test_spanning_forest():
    link = np.random.default_rng(1).random((40, 30)) < 0.03
    rows, columns = spanning(link)
    assert link[rows, columns].all() and len(rows) < 70
    nodes = [("r", i) for i in range(40)] + [("c", i) for i in range(30)]

    def linked(pairs):
        return lambda a, b: a[0] != b[0] and ((a[1], b[1]) if a[0] == "r" else (b[1], a[1])) in pairs

    assert brute.classes(nodes, linked(set(zip(*np.nonzero(link))))) == brute.classes(nodes, linked(set(zip(rows, columns))))
