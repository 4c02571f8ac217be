"""Connected components of links, by rounds of small joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from brevia.session import restage


def _linked(edges: DataFrame) -> tuple[int, int]:
    """Number of links and a digest of them, alike for alike sets."""
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))
    ).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the smallest node that can be reached.

    Alternating stars: each node first hands its larger neighbours to its smallest neighbour, then its smaller ones, until
    every node hangs on its root alone. The number of rounds grows with the logarithm of the longest path. Links of equal
    nodes and repeats do nothing; links with a null are left out. A star's centre may have any number of neighbours: its
    smallest is found by a partial minimum, and the join back has one row a centre, which Spark broadcasts or splits the
    other side for. The links of a round are staged in place of those before, so a lost executor costs one round at most.
    """
    edges = links.select(
        F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")
    ).filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()
    edges = restage(edges, "links")
    state = _linked(edges)
    while state[0]:
        both = edges.select(F.col("high").alias("node"), F.col("low").alias("near")).union(
            edges.select(F.col("low").alias("node"), F.col("high").alias("near")))
        least = both.groupBy("node").agg(F.min("near").alias("least")).select(
            "node", F.least("node", "least").alias("least"))
        wide = both.filter("near > node").join(least, "node").select(
            F.col("near").alias("high"), F.col("least").alias("low")).distinct()
        lowest = wide.groupBy("high").agg(F.min("low").alias("least"))
        narrow = wide.join(lowest, "high").filter("low > least").select(F.col("low").alias("high"), F.col("least").alias("low"))
        edges = restage(narrow.union(lowest.select("high", F.col("least").alias("low"))).distinct(), "links", edges)
        before, state = state, _linked(edges)
        if state == before:
            break
    roots = edges.select(F.col("low").alias("node")).distinct()
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).union(
        roots.select("node", F.col("node").alias("root")))


def spanning(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a forest of links: it connects the two sides of a boolean matrix as all its links do."""
    rows, columns = [], []
    new_rows, new_columns = link.any(axis=1), link.any(axis=0)
    while new_rows.any():
        front = np.array([new_rows.argmax()])
        new_rows[front] = False
        while len(front):
            reached = np.flatnonzero(link[front].any(axis=0) & new_columns)
            rows.append(front[link[np.ix_(front, reached)].argmax(axis=0)])
            columns.append(reached)
            new_columns[reached] = False
            front = np.flatnonzero(link[:, reached].any(axis=1) & new_rows)
            rows.append(front)
            columns.append(reached[link[np.ix_(front, reached)].argmax(axis=1)] if len(reached) else front[:0])
            new_rows[front] = False
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(rows or empty), np.concatenate(columns or empty)
