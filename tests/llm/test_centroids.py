"""Orchard's search and exact clusters against plain versions."""

import hashlib
import math

import numpy as np
import pytest
from brevia.llm import centroids
from brevia.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>"


def plain(rows, k=16, rounds=3, size=64):
    """vec_id -> (cluster, distance, cluster_inertia, inertia, centroid_sha256), by whole distances in Python's numbers."""
    kept = [
        (i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())[:k]
    means = [list(v) for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(means)) for _, v in kept]

    for _ in range(rounds):
        best = assign()
        for n in range(len(means)):
            own = [v for (_, v), b in zip(kept, best) if b[1] == n]
            if own:
                means[n] = [sum(x) // len(own) for x in zip(*own)]
    best, sums = assign(), {}
    for d, n in best:
        sums[n] = sums.get(n, 0) + d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in means]
    return {i: (n, d, sums[n], sum(sums.values()), digests[n]) for (i, _), (d, n) in zip(kept, best)}


def found(spark, rows):
    return {r.vec_id: tuple(r)[1:] for r in centroids.cluster(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_registered_query_equals_the_plain_version(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    assert {r.vec_id: tuple(r)[1:] for r in QUERIES["op12_orchard"](spark, SF_DIR).collect()} == plain(rows)


def test_clusters_ties_and_rows_left_out(spark):
    random = np.random.default_rng(3)
    rows = [(i, [float(x) for x in random.integers(-2, 3, 64) / 64]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [None] + [1.0] * 63), (2004, [math.nan] + [1.0] * 63),
             (2005, [math.inf] + [1.0] * 63), (2006, [0.0] * 64)]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = [(i, [float(i // 2)] * 64) for i in range(n)]
    assert found(spark, rows) == plain(rows)


def test_rows_without_id_and_clashing_names(spark):
    rows = [(None, [0.5] * 64, 1, "x"), (3, [0.5] * 64, 2, "y"), (3, [0.25] * 64, 3, "z")]
    got = centroids.cluster(spark.createDataFrame(rows, SCHEMA + ", cluster int, whole string")).collect()
    assert len(got) == 3 and got[0].inertia == sum(r.distance for r in got)


def test_components_too_large_stop_the_job(spark):
    with pytest.raises(Exception, match="too large"):
        found(spark, [(1, [1e30] + [0.0] * 63)])


def test_search_is_exact_and_skips_distances():
    random = np.random.default_rng(5)
    for spread in (3, 1000):
        middles = random.integers(-spread, spread, (16, 8))
        rows = middles[random.integers(0, 16, 4000)] + random.integers(-1, 2, (4000, 8))
        best, distance, computed = centroids.Orchard(middles).assign(rows)
        whole = ((rows[:, None, :] - middles[None]) ** 2).sum(axis=2)
        assert (best == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
        assert computed <= whole.size
    assert computed < whole.size * 0.8


def test_a_centroid_at_exactly_twice_the_distance_is_looked_at():
    # The row lies half way between 1 and 0, so the list of 1 must not stop at 0.
    best, distance, _ = centroids.Orchard(np.array([[100], [2], [0]])).assign(np.array([[1]]))
    assert (best[0], distance[0]) == (1, 1)
    best, distance, _ = centroids.Orchard(np.array([[50], [0], [2]])).assign(np.array([[1], [2]]))
    assert best.tolist() == [1, 2] and distance.tolist() == [1, 0]
