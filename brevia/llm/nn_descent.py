"""Near-duplicate embeddings by NN-descent: a neighbour graph refined by joins of neighbours' neighbours."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from brevia.llm.components import components, spanning
from brevia.session import stage

THRESHOLD = 0.9
# Neighbours of a vector at the start; doubled for a vector while all of its neighbours are near enough to link.
NEIGHBOURS = 12
ROUNDS = 2
# The graph starts from tables of random hyperplanes: rows are sorted by their signs, neighbours of a chunk compared.
# At least this many tables, more for more rows; as many are laid out at a time.
TABLES = 8
CHUNK = 128
# The recall is measured for this many vectors of each kind against all; below the target the graph is refined again.
AUDITED = 512
# Vectors without a link are audited in proportion to those with few, up to this many times ``AUDITED``.
MOST_ALONE = 16
# Components of more vectors than this are large: their vectors are audited apart from the others.
LARGE = 32
TARGET = 0.97
# Lengths of at most this many distinct vectors, beside the most frequent one, need no graph.
RARE = 1024
# Members of a component are compared in blocks of this size.
BLOCK = 1024
# Lists are made from 8-bit vectors; what they bring this close to the threshold is compared in double precision.
SLACK = 0.01
SEED = 42


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _short(unit: np.ndarray) -> np.ndarray:
    return np.rint(unit / np.abs(unit).max(axis=1, keepdims=True) * 127).astype(np.int8)


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


def _shorts(column: pa.Array) -> np.ndarray:
    """Unit vectors in single precision from 8-bit ones."""
    rows = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), -1).astype(np.float32)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _runs(batches: Iterator[pa.RecordBatch], key: str, rows: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    """The sorted rows again, in batches that end where ``key`` changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield table.slice(0, cut)
        held = [table.slice(cut)]
    if held and sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


_PAIRS = "rep bigint, near bigint, cosine float"


def _best(reps: np.ndarray, vectors: np.ndarray, least: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """For each of a group: the up to ``most`` nearest others above its least cosine."""
    cosine = vectors @ vectors.T
    np.fill_diagonal(cosine, -2)
    most = min(most, len(reps) - 1)
    top = np.argpartition(-cosine, most - 1, axis=1)[:, :most]
    value = np.take_along_axis(cosine, top, axis=1)
    row, column = np.nonzero((value > least[:, None]) & (reps[top] != reps[:, None]))
    return reps[row], reps[top[row, column]], value[row, column]


def _pairs(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float32())
    columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds)], ["rep", "near", "cosine"])


def _tables(rows: int, threshold: float, target: float) -> int:
    """Tables that bring a lone pair at the threshold into one chunk with a chance of ``target``, ``TABLES`` at least."""
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    together = agree ** max(0.0, math.log2(max(rows, 1) / CHUNK))
    if together >= 1 or not 0 < target < 1:
        return TABLES
    return max(TABLES, math.ceil(math.log(1 - target) / math.log(1 - together)))


def _table_pairs(vectors: DataFrame, seeds: range, dim: int, most: int) -> DataFrame:
    """Pairs of vectors that are close in the order of one of several tables of hyperplanes."""

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {seed: np.random.default_rng([SEED, seed]).standard_normal((dim, 32)).astype(np.float32) for seed in seeds}
        for batch in batches:
            rows = _shorts(batch.column("short"))
            for seed, plane in planes.items():
                code = np.packbits(rows @ plane > 0, axis=1).copy().view(">u4").ravel().astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), seed), pa.int64()), pa.array(code), batch.column("rep"), batch.column("short")],
                    ["seed", "code", "rep", "short"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, "seed"):
            reps, rows = batch.column("rep").to_numpy(), _shorts(batch.column("short"))
            starts = _starts(batch.column("seed").to_numpy())
            found = []
            for start, end in zip(starts, np.r_[starts[1:], len(reps)]):
                for at in range(start, end, CHUNK):
                    # The last chunk reaches back, so that none is left with few rows.
                    part = slice(max(start, min(at, end - CHUNK)), min(at + CHUNK, end))
                    if part.stop - part.start > 1:
                        least = np.full(part.stop - part.start, -2.0)
                        found.append(_best(reps[part], rows[part], least, most))
            yield _pairs(found)

    laid = vectors.select("rep", "short").mapInArrow(signs, "seed bigint, code bigint, rep bigint, short binary")
    spread = F.xxhash64("rep")
    return laid.repartitionByRange("seed", "code", spread).sortWithinPartitions("seed", "code", spread).mapInArrow(
        compare, _PAIRS)


def _lists(pairs: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """The nearest neighbours of each vector, as many as its size, ``most`` at most, says; equal cosines by hash.

    The bound on the place lets Spark drop the others before the shuffle, so a vector near to many costs no more.
    """
    tie = F.xxhash64("rep", "near")
    nearest = Window.partitionBy("rep").orderBy(F.desc("cosine"), tie)
    ranked = pairs.groupBy("rep", "near").agg(F.max("cosine").alias("cosine")).withColumn(
        "place", F.row_number().over(nearest)).filter(F.col("place") <= most)
    kept = ranked.join(sizes, "rep", "left").withColumn("size", F.coalesce("size", F.lit(NEIGHBOURS)))
    return kept.filter(F.col("place") <= F.col("size")).select("rep", "near", "cosine", "size")


def _grown(lists: DataFrame, limit: float) -> DataFrame:
    """The list size of each vector for the next round: doubled where the list is full and all of it links."""
    return lists.groupBy("rep").agg(
        F.max("size").alias("size"), F.count(F.lit(1)).alias("found"), F.min("cosine").alias("least")
    ).select(
        "rep", F.when((F.col("found") >= F.col("size")) & (F.col("least") >= limit), F.col("size") * 2).otherwise(
            F.col("size")).cast("int").alias("size"),
        F.when(F.col("found") >= F.col("size"), F.col("least")).otherwise(F.lit(-2.0)).cast("float").alias("least"))


def _descend(vectors: DataFrame, lists: DataFrame, limit: float, most: int) -> DataFrame:
    """One round: the neighbours of each vector, both ways, are compared with each other, and lists keep the best."""
    sizes = stage(_grown(lists, limit), "sizes")
    forward = lists.select(F.col("rep").alias("hub"), F.col("near").alias("rep"))
    turn = Window.partitionBy("hub").orderBy(F.xxhash64("rep", "hub"), "rep")
    backward = lists.select(F.col("near").alias("hub"), "rep").withColumn("turn", F.row_number().over(turn)).filter(
        F.col("turn") <= NEIGHBOURS).drop("turn")
    own = sizes.select(F.col("rep").alias("hub"), "rep")
    groups = forward.union(backward).union(own).distinct()
    rows = groups.join(vectors.select("rep", "short"), "rep").join(
        sizes.select("rep", F.when(F.col("least") >= limit, F.lit(limit)).otherwise(F.col("least")).alias("least")), "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, "hub"):
            reps, least = batch.column("rep").to_numpy(), batch.column("least").to_numpy()
            units = _shorts(batch.column("short"))
            starts = _starts(batch.column("hub").to_numpy())
            yield _pairs([
                _best(reps[s:e], units[s:e], least[s:e], max(NEIGHBOURS // 2, (e - s) // 2))
                for s, e in zip(starts, np.r_[starts[1:], len(reps)]) if e - s > 1])

    found = rows.select("hub", "rep", "short", "least").repartition("hub").sortWithinPartitions("hub").mapInArrow(
        compare, _PAIRS)
    return stage(_lists(found.union(lists.select("rep", "near", "cosine")), sizes.select("rep", "size"), most), "lists")


def _parts(found: DataFrame, block: int) -> DataFrame:
    """``found`` with the number of parts that the members of its component are dealt to, about ``block`` in each."""
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block)
    large = stage(sizes.select("root", F.ceil(F.col("size") / F.lit(block)).cast("int").alias("parts")), "large")
    return found.join(large, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def _compare_members(members: DataFrame, dim: int, threshold: float, block: int) -> DataFrame:
    """(a, b, links, near): links of each member inside its component and the distinct vectors they lead to, summed by
    parts where b is null, and a forest of links.

    Members (``root, parts, rep, copies, embedding``) of a component are compared all with all: that is the list of a
    vector enlarged to all its neighbours' neighbours. Those of a component in several parts are dealt to them by a hash,
    so no task has a large component, and tasks compare two parts each. Counts are returned, and never more links than
    members.
    """
    out = ["a", "b", "links", "near", "root", "part", "data"]

    def result(
        a: np.ndarray, b: np.ndarray | None, links: np.ndarray | None = None, near: np.ndarray | None = None,
    ) -> pa.RecordBatch:
        n = len(a)
        none = pa.nulls(n, pa.int64())
        b, links, near = (none if v is None else pa.array(v, pa.int64()) for v in (b, links, near))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, links, near, none, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], out)

    def compare(x: tuple, y: tuple, same: bool) -> Iterator[pa.RecordBatch]:
        (reps, copies, rows), (others, more, columns) = x, y
        link = rows @ columns.T >= threshold
        if same:
            np.fill_diagonal(link, True)
        counts = link @ more
        yield result(reps, None, counts - copies if same else counts, link.sum(axis=1) - same)
        if not same:
            yield result(others, None, link.T @ copies, link.sum(axis=0))
        r, c = spanning(link)
        a, b = reps[r], others[c]
        yield result(a[a != b], b[a != b])

    def pack(root: int, at: int, x: tuple) -> pa.RecordBatch:
        none = pa.nulls(1, pa.int64())
        data = b"".join(np.ascontiguousarray(v).tobytes() for v in x)
        return pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.array([root], pa.int64()), pa.array([at], pa.int32()), pa.array([data], pa.binary())], out)

    def read(batch: pa.RecordBatch) -> tuple:
        return batch.column("rep").to_numpy(), batch.column("copies").to_numpy(), _unit(_matrix(batch.column("embedding"), dim))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, "place", block):
            roots, parts = batch.column("root").to_numpy(), batch.column("part").to_numpy()
            several = batch.column("parts").to_numpy() > 1
            starts = np.flatnonzero(np.r_[True, (roots[1:] != roots[:-1]) | (parts[1:] != parts[:-1])])
            for s, e in zip(starts, np.r_[starts[1:], len(roots)]):
                x = read(batch.slice(s, e - s))
                if several[s]:
                    yield pack(int(roots[s]), int(parts[s]), x)
                else:
                    yield from compare(x, x, True)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpack(data: bytes) -> tuple:
            n = len(data) // (16 + 8 * dim)
            reps, copies = (np.frombuffer(data, np.int64, n, i * 8 * n) for i in (0, 1))
            return reps, copies, np.frombuffer(data, np.float64, n * dim, 16 * n).reshape(n, dim)

        for batch in batches:
            for x, y, same in zip(*(batch.column(c) for c in ("x_data", "y_data", "same"))):
                yield from compare(unpack(x.as_py()), unpack(y.as_py()), same.as_py())

    schema = "a bigint, b bigint, links bigint, near bigint, root bigint, part int, data binary"
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    dealt = members.select("root", "parts", part.alias("part"), "rep", "copies", "embedding").withColumn(
        "place", F.xxhash64("root", "part"))
    found = stage(dealt.repartition("place").sortWithinPartitions("place", "root", "part").mapInArrow(work, schema), "members")
    large = found.filter(F.col("data").isNotNull()).select("root", "part", "data")
    # Pairs are made of numbers; each part is then sent to its pairs. Every part is first in half of them.
    x, y = (large.select("root", F.col("part").alias(n)) for n in ("x", "y"))
    pairs = x.join(y, "root").filter("x = y OR (x < y) = ((x + y) % 2 = 0)")
    for n in ("x", "y"):
        pairs = pairs.join(large.select("root", F.col("part").alias(n), F.col("data").alias(f"{n}_data")), ["root", n])
    pairs = pairs.select("x_data", "y_data", (F.col("x") == F.col("y")).alias("same"))
    counted = found.filter(F.col("a").isNotNull()).union(pairs.mapInArrow(across, schema))
    return stage(counted.select("a", "b", "links", "near"), "compared")


def _audit(vectors: DataFrame, counts: DataFrame, roots: DataFrame, dim: int, threshold: float, audited: int) -> float:
    """Recall of the graph by brute force for a bounded set of vectors, the lesser one of two.

    A vector's recall is the share of the distinct vectors it links with that the graph has; each linked vector counts
    alike, however many links it has. The recall is the mean in large components, and the mean elsewhere. Vectors that
    have few links and that have none so far are drawn apart and weighted by what they stand for, enough of the latter that
    a loss shows beside the former.
    """
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    large = roots.join(sizes.filter(F.col("size") > LARGE), "root").select("rep", F.lit(True).alias("large"))
    kinds = stage(vectors.select("rep").join(counts.filter("near > 0").select("rep", "near"), "rep", "left").join(
        large, "rep", "left").select("rep", F.coalesce("near", F.lit(0)).alias("near"), F.when(
            F.col("near").isNull(), "alone").when(F.col("large"), "large").otherwise("small").alias("kind")), "kinds")
    total = {row["kind"]: row["count"] for row in kinds.groupBy("kind").count().collect()}
    few, alone = total.get("small", 0), total.get("alone", 0)
    draws = {"large": audited, "small": audited, "alone": max(
        audited, min(MOST_ALONE * audited, -(-audited * alone // few) if few else MOST_ALONE * audited))}
    chosen = []
    for kind in total:
        drawn = kinds.filter(F.col("kind") == kind).orderBy(F.xxhash64("rep", F.lit(SEED)), "rep").limit(draws[kind])
        chosen += drawn.join(vectors.select("rep", "embedding"), "rep").select("rep", "near", "kind", "embedding").collect()
    if not chosen:
        return 1.0
    reps = np.array([row["rep"] for row in chosen])
    units = _unit(np.array([row["embedding"] for row in chosen], np.float64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true = np.zeros(len(reps), np.int64)
        for batch in batches:
            others, rows = batch.column("rep").to_numpy(), _unit(_matrix(batch.column("embedding"), dim)).T
            for at in range(0, len(reps), BLOCK):
                part = slice(at, at + BLOCK)
                true[part] += ((units[part] @ rows >= threshold) & (reps[part, None] != others)).sum(axis=1)
        linked = np.flatnonzero(true)
        yield pa.RecordBatch.from_arrays([pa.array(reps[linked]), pa.array(true[linked])], ["rep", "true"])

    found = vectors.select("rep", "embedding").mapInArrow(work, "rep bigint, true bigint").groupBy("rep").agg(F.sum("true"))
    true = {rep: n for rep, n in found.collect()}
    held, linked = {"large": 0.0, "other": 0.0}, {"large": 0.0, "other": 0.0}
    for row in chosen:
        kind = row["kind"] if row["kind"] == "large" else "other"
        if n := true.get(row["rep"]):
            weight = total[row["kind"]] / min(total[row["kind"]], draws[row["kind"]])
            held[kind] += weight * min(1.0, row["near"] / n)
            linked[kind] += weight
    return min(held[kind] / linked[kind] if linked[kind] else 1.0 for kind in held)


def _graph_links(vectors: DataFrame, dim: int, threshold: float, target: float, block: int) -> DataFrame:
    """What ``_compare_members`` finds for the vectors of one length, by the neighbour graph."""
    spark = vectors.sparkSession
    limit, seen, most = threshold - SLACK, 0, NEIGHBOURS
    sizes = spark.createDataFrame([], "rep bigint, size int")
    lists = None
    n = vectors.count()
    tables, recall = _tables(n, threshold, target), -1.0
    while True:
        last = seen + max(seen, tables)
        while seen < last:
            pairs = _table_pairs(vectors, range(seen, min(seen + TABLES, last)), dim, NEIGHBOURS // 2)
            seen = min(seen + TABLES, last)
            if lists is not None:
                sizes = lists.groupBy("rep").agg(F.max("size").alias("size"))
                pairs = pairs.union(lists.select("rep", "near", "cosine"))
            lists = stage(_lists(pairs, sizes, most), "lists")
        for _ in range(ROUNDS):
            most *= 2
            lists = _descend(vectors, lists, limit, most)
        near = lists.filter(F.col("cosine") >= limit).select(F.col("rep").alias("a"), F.col("near").alias("b"))
        found = stage(components(near).withColumnRenamed("node", "rep"), "found")
        members = _parts(found, block).join(vectors.select("rep", "copies", "embedding"), "rep")
        compared = _compare_members(members, dim, threshold, block)
        counts = compared.filter(F.col("b").isNull()).groupBy("a").agg(
            F.sum("links").alias("links"), F.sum("near").alias("near")).withColumnRenamed("a", "rep")
        before, recall = recall, _audit(vectors, counts, found, dim, threshold, AUDITED)
        if recall >= target:
            return compared
        if recall <= before or seen * CHUNK >= n:
            everything = vectors.withColumns({"root": F.lit(0).cast("bigint"), "parts": F.lit(max(1, -(-n // block)))})
            return _compare_members(everything, dim, threshold, block)


def _rare_links(vectors: DataFrame, width: int, threshold: float, block: int) -> DataFrame:
    """What ``_compare_members`` finds for vectors of rare lengths up to ``width``: zeros behind them change no cosine,
    and only vectors of one length are compared."""
    kind = vectors.schema["embedding"].dataType.elementType
    zeros = F.array_repeat(F.lit(0).cast(kind), F.lit(width) - F.col("dim"))
    members = vectors.select(F.col("dim").cast("bigint").alias("root"), F.lit(1).alias("parts"), "rep", "copies",
                             F.concat("embedding", zeros).alias("embedding"))
    return _compare_members(members, width, threshold, block)


def near_duplicates(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD,
    target: float = TARGET, block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: links with a cosine of ``threshold`` or more.

    Vectors that are null, empty or zero, or that hold a null or a number that is not finite, link with nothing. Vectors
    link with others of their length: each length of more than ``RARE`` distinct vectors has a graph of its own, at least
    the most frequent one; vectors of a rarer length are compared with all of it. Equal vectors are one node with a count
    and link with each other; a vector's 128-bit hash stands for it. The smallest vec_id that can be reached is the
    component, and its rows are kept. Rows without vec_id take part, their component is null if it has no id at all.
    Repeated rows are vectors of their own. Labels are not read.

    A first graph comes from tables of random hyperplanes; rounds of NN-descent refine it on 8-bit vectors, and lists that
    are full of links double. Components of what is near the threshold are then compared in double precision, so no link
    is below it, and a dense group has all its links however small the lists were. The number of tables follows from the
    rows. The recall of single vectors is audited against brute force, in large components and elsewhere; below ``target``
    in one of them more tables and rounds follow. Once these no longer help, or have compared a vector with as many others
    as there are, all vectors are compared with all, in blocks, and no link is missed.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(
        "embedding", lambda x: x != 0)
    usable = F.coalesce(good, F.lit(False))
    rows = rows.withColumn("usable", usable).withColumns({
        "h1": F.when(F.col("usable"), F.xxhash64("embedding")),
        "h2": F.when(F.col("usable"), F.xxhash64(F.lit(SEED), "embedding")),
    })
    keys = stage(rows.select("vec_id", "h1", "h2"), "keys")
    vectors = rows.filter("usable").groupBy("h1", "h2", F.size("embedding").alias("dim")).agg(
        F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                short = _bytes(_short(_unit(_matrix(part.column("embedding"), dim))))
                yield pa.RecordBatch.from_arrays([*part.columns, short], [*part.schema.names, "short"])

    schema = vectors.withColumn("rep", F.lit(0).cast("bigint")).schema.add("short", "binary")
    vectors = stage(vectors.withColumn("rep", F.monotonically_increasing_id()).mapInArrow(shorten, schema), "vectors")
    lengths = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim")
    often = [row["dim"] for row in lengths.filter(F.col("count") > RARE).collect() or lengths.take(1)]
    # The power of two that a rare length fits in; rare ones are taken in one go for each of these.
    width = F.expr("shiftleft(1, length(bin(dim - 1)))")
    rare = vectors.filter(~F.col("dim").isin(often)).withColumn("width", width)
    parts = [_graph_links(vectors.filter(F.col("dim") == dim), dim, threshold, target, block) for dim in often]
    for row in rare.select("width").distinct().collect():
        parts.append(_rare_links(rare.filter(F.col("width") == row["width"]), row["width"], threshold, block))
    none = spark.createDataFrame([], "a bigint, b bigint, links bigint, near bigint")
    compared = functools.reduce(DataFrame.union, parts, none)
    counts = compared.filter(F.col("b").isNull()).groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    linked = components(compared.filter(F.col("b").isNotNull()).select("a", "b")).withColumnRenamed("node", "rep")
    nodes = vectors.select("rep", "h1", "h2", "copies", "least").join(counts, "rep", "left").join(linked, "rep", "left").withColumn(
        "root", F.coalesce("root", "rep"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stage(nodes.join(least, "root").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "classes")
    out = keys.join(classes, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
