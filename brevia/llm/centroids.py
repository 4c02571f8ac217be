"""Exact k-means over whole-number vectors, each vector's nearest centroid found by Orchard's search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brevia.llm.common import ship_package
from brevia.session import stage

CENTROIDS = 16
ROUNDS = 3
COMPONENTS = 64
SCALE = 64
SEED = 1
# Whole components are below this in size: four squared distances of 64 of them then stay within a long.
MOST = 1 << 25


class Orchard:
    """Centroids and, for each of them, the others from the nearest to the farthest, with their squared distances."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, np.int64)
        k = len(self.centroids)
        apart = ((self.centroids[:, None, :] - self.centroids[None, :, :]) ** 2).sum(axis=2)
        self.near = np.array([[j for j in np.argsort(apart[i], kind="stable") if j != i] for i in range(k)], np.int64).reshape(k, k - 1)
        self.apart = np.take_along_axis(apart, self.near, axis=1)

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid of each row, ties to the smaller number, its squared distance, and the distances computed.

        Every row starts at centroid 0 and walks down the list of its best centroid so far; a nearer one's list is started
        from its head, and visited centroids are passed over. A centroid beyond twice the distance, strictly, ends the walk:
        neither it nor any behind it can be as near. All rows of a batch take a step at a time.
        """
        n, k = len(rows), len(self.centroids)
        best, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        distance = ((rows - self.centroids[0]) ** 2).sum(axis=1)
        visited = np.zeros((n, k), bool)
        visited[:, 0] = True
        live, computed = np.arange(n if k > 1 else 0), n
        while len(live):
            now = best[live]
            other = self.near[now, at[live]]
            going = self.apart[now, at[live]] <= 4 * distance[live]
            live, other = live[going], other[going]
            at[live] += 1
            fresh = ~visited[live, other]
            some, other = live[fresh], other[fresh]
            visited[some, other] = True
            computed += len(some)
            found = ((rows[some] - self.centroids[other]) ** 2).sum(axis=1)
            nearer = (found < distance[some]) | ((found == distance[some]) & (other < best[some]))
            moved = some[nearer]
            best[moved], distance[moved], at[moved] = other[nearer], found[nearer], 0
            live = live[at[live] < k - 1]
        return best, distance, computed


def whole_components(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a long, x as double; the job stops at one too large for exact distances."""
    found = F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    fits = F.forall(embedding, lambda x: F.abs(x.cast("double")) < F.lit(float(MOST // scale)))
    return F.when(fits, found).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("array<bigint>"))


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("whole").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


def _first(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of seed and id, a top-k; rows of one id by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "whole").limit(k).select("whole").collect()
    return np.array([row["whole"] for row in rows], np.int64)


def _sums(vectors: DataFrame, centroids: np.ndarray, size: int) -> dict[int, tuple[int, list[int]]]:
    """Rows and component sums of each cluster; a task sends one row for each cluster."""
    search = Orchard(centroids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(centroids), size), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            rows = _matrix(batch, size)
            best, _, _ = search.assign(rows)
            np.add.at(sums, best, rows)
            counts += np.bincount(best, minlength=len(centroids))
        used = counts.nonzero()[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))],
            ["cluster", "found", "sums"])

    parts = vectors.select("whole").mapInArrow(work, "cluster bigint, found bigint, sums array<bigint>")
    totals = parts.select("cluster", "found", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(
        F.sum("found").alias("found"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    found: dict[int, tuple[int, list[int]]] = {}
    for row in sorted(totals, key=lambda r: (r["cluster"], r["at"])):  # centroids x components rows
        found.setdefault(row["cluster"], (row["found"], []))[1].append(int(row["total"]))
    return found


def cluster(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
    size: int = COMPONENTS, scale: int = SCALE, seed: int = SEED,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that is kept.

    Kept are vectors of exactly ``size`` components, none null or not finite; each component becomes floor(scale * x), and
    everything after that is exact. The first centroids are the kept vectors with the smallest hashes of seed and id. Each
    round assigns all vectors and moves every centroid that has some to the floor of their mean; the rounds done, all are
    assigned once more. Fewer vectors than ``k`` make fewer centroids, equal ones among them: ties go to the smaller number.
    Rows without id take part but are never among the first centroids while others are there; repeated rows are vectors of
    their own. No kept vector gives no row. A component of 2**25 or more, scaled, stops the job with an error.

    A round reads the vectors where they lie: only ``k`` sums for each task are shuffled, so no cluster is a hot key, and
    ``k`` centroids pass the driver.
    """
    spark = df.sparkSession
    ship_package(spark)
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = df.filter((F.size(embedding) == size) & finite).select(
        F.col(vec_id).alias("vec_id"), whole_components(F.col(embedding), scale).alias("whole"))
    vectors = stage(kept, "whole-vectors")
    centroids = _first(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        for number, (found, sums) in _sums(vectors, centroids, size).items():
            centroids[number] = [total // found for total in sums]
    search = Orchard(centroids.reshape(-1, size)) if len(centroids) else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, distance, _ = search.assign(_matrix(batch, size))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    schema = vectors.select("vec_id").schema.add("cluster", "integer").add("distance", "long")
    assigned = stage(vectors.mapInArrow(work, schema), "assigned")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    names = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    # At most k rows each.
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"))
    total = sums.agg(F.sum("sum").cast("bigint").alias("inertia"))
    found = sums.join(F.broadcast(names), "cluster").join(F.broadcast(total)).select(
        "cluster", F.col("sum").cast("bigint").alias("cluster_inertia"), "inertia", "centroid_sha256")
    return assigned.join(F.broadcast(found), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The same clusters in SQL, each distance computed in full."""
    apart = "list_sum(list_transform(list_zip(v.whole, c.whole), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [f"""kept AS (
    SELECT row_number() OVER () AS place, vec_id,
        list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS whole
    FROM embeddings WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {COMPONENTS})""",
             f"""centroids_0 AS (
    SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), whole) - 1 AS cluster, whole FROM kept
    QUALIFY cluster < {CENTROIDS})"""]
    for i in range(ROUNDS + 1):
        parts.append(f"""assigned_{i} AS (
    SELECT v.place, any_value(v.vec_id) AS vec_id, any_value(v.whole) AS whole, min(({apart}, c.cluster)) AS best
    FROM kept v, centroids_{i} c GROUP BY v.place)""")
        if i < ROUNDS:
            parts.append(f"""means_{i} AS (
    SELECT cluster, list(mean ORDER BY pos) AS whole FROM (
        SELECT cluster, pos, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS mean FROM (
            SELECT best[2] AS cluster, unnest(whole) AS x, unnest(range({COMPONENTS})) AS pos FROM assigned_{i})
        GROUP BY cluster, pos) GROUP BY cluster)""")
            parts.append(f"""centroids_{i + 1} AS (
    SELECT c.cluster, coalesce(m.whole, c.whole) AS whole FROM centroids_{i} c LEFT JOIN means_{i} m USING (cluster))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, CAST(a.best[2] AS INTEGER) AS cluster, CAST(a.best[1] AS BIGINT) AS distance,
    CAST(sum(a.best[1]) OVER (PARTITION BY a.best[2]) AS BIGINT) AS cluster_inertia,
    CAST(sum(a.best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.whole, ',')) AS centroid_sha256
FROM assigned_{ROUNDS} a JOIN centroids_{ROUNDS} c ON c.cluster = a.best[2]"""


SQL = _sql()
