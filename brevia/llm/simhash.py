"""SimHash near-duplicates: fingerprints joined in a grid of per-segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from brevia.llm.common import fresh
from brevia.llm.components import components, spanning
from brevia.session import stage

SHINGLE = 4
MOST_BITS = 4
SEED = 42
# Cells of up to this many fingerprints are compared in one go, larger ones in pairs of blocks of this size.
BLOCK = 4096
_BATCH = 1 << 18  # rows of sorted cells looked at together
_SMALL = 48  # runs up to this length are compared by shifting whole columns
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_FIELDS = 0x5555555555555555


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's shingles; 0 without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    stops = (ends - 1)[shingle - 1:].tolist()
    count, total = np.zeros(64, np.int64), len(starts)
    for at in range(0, total, 1 << 16):
        part = range(at, min(total, at + (1 << 16)))
        hashes = np.fromiter((digest(joined[starts[i]:stops[i]], seed) for i in part), ">u8", len(part))
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > total).tobytes(), "big")


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of each text as a long with the same bits."""

    @F.arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.to_pylist()], np.uint64)
            yield pa.array(found.view(np.int64))

    return of(text)


def embedding(bits: Column) -> Column:
    """Bit counts of the 32 segments of two bits, written as 00, 01 and 11.

    So the Manhattan distance of two embeddings is the number of bits in which they differ, and it is never above that of
    the fingerprints.
    """
    low, high = bits.bitwiseAND(F.lit(_FIELDS)), F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(_FIELDS))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseOR(high))


def grid(prints: DataFrame) -> DataFrame:
    """(cell, print): each fingerprint in the cells of its half embeddings and in those one step away.

    Embeddings at distance 4 or less have a half at distance 2 or less, and so a common cell: one of the halves, or one
    between them. A step changes one count by one; there are 24 of 32 on average, so about 50 rows a fingerprint.
    """
    mask = F.lit(0xFFFFFFFF)
    halves = F.array(F.col("counts").bitwiseAND(mask), F.shiftrightunsigned(F.col("counts"), 32))
    fields = F.lit(_FIELDS & 0xFFFFFFFF)

    def valid(half: Column) -> Column:
        return F.shiftright(half, 1).bitwiseAND(F.bitwise_not(half)).bitwiseAND(fields) == 0

    def near(half: Column) -> Column:
        steps = F.array(*(F.lit(1 << i).cast("bigint") for i in range(32)))
        return F.concat(F.array(half), F.filter(F.transform(steps, lambda step: half.bitwiseXOR(step)), valid))

    sides = prints.withColumn("counts", embedding(F.col("print"))).select("print", F.posexplode(halves).alias("side", "half"))
    return sides.select(
        "print", F.explode(F.transform(near(F.col("half")), lambda cell: cell.bitwiseOR(
            F.shiftleft(F.col("side").cast("bigint"), 32)))).alias("cell"))


def _counts(bits: np.ndarray) -> np.ndarray:
    fields = np.uint64(_FIELDS)
    low, high = bits & fields, bits >> np.uint64(1) & fields
    return (low & high) << np.uint64(1) | low | high


def _near(a: np.ndarray, b: np.ndarray, counts_a: np.ndarray, counts_b: np.ndarray, bits: int) -> np.ndarray:
    """Which of the aligned pairs link: the lower bound first, the fingerprints of the rest after."""
    hits = np.flatnonzero(np.bitwise_count(counts_a ^ counts_b) <= bits)
    return hits[np.bitwise_count(a[hits] ^ b[hits]) <= bits]


def _forest(a: np.ndarray, b: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect all that links between two blocks connect: at most one for each fingerprint."""
    counts_a, counts_b = _counts(a), _counts(b)
    link = np.zeros((len(a), len(b)), bool)
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        rows, columns = np.nonzero(np.bitwise_count(counts_a[at:at + step, None] ^ counts_b) <= bits)
        near = np.bitwise_count(a[at + rows] ^ b[columns]) <= bits
        link[at + rows[near], columns[near]] = True
    return [(x, y) for x, y in zip(*(side[at].tolist() for side, at in zip((a, b), spanning(link)))) if x != y]


class _Joined:
    """Links seen by one task, kept only if they connect what was not connected before."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        parent = self.parent
        top = node
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(node, node)) != top and up != node:
            parent[node] = top
            node = up
        return top

    def new(self, links: list[tuple[int, int]]) -> list[tuple[int, int]]:
        kept = []
        for a, b in links:
            x, y = self.root(a), self.root(b)
            if x != y:
                self.parent[x] = y
                kept.append((a, b))
        return kept


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


_OUT = ["a", "b", "cell", "block", "prints"]


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    n = len(pairs)
    a, b = ([p[i] for p in pairs] for i in (0, 1))
    empty = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([_signed(a), _signed(b), empty, empty, pa.nulls(n, pa.binary())], _OUT)


def _block(cell: int, number: int, prints: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(1, pa.int64())
    return pa.RecordBatch.from_arrays(
        [none, none, pa.array([cell], pa.int64()), pa.array([number], pa.int64()), pa.array([prints.tobytes()], pa.binary())],
        _OUT)


def _compare(cells: np.ndarray, prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links inside each run of one cell; runs are at most ``BLOCK`` long."""
    found: list[tuple[int, int]] = []
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    sizes = np.diff(np.r_[starts, len(cells)])
    small = np.repeat((sizes > 1) & (sizes <= _SMALL), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(cells))  # rows from here to the end of the run
    counts = _counts(prints)
    for shift in range(1, _SMALL):
        at = np.flatnonzero(small & (left > shift))
        if not len(at):
            break
        at = at[_near(prints[at], prints[at + shift], counts[at], counts[at + shift], bits)]
        found += zip(prints[at].tolist(), prints[at + shift].tolist())
    for at in np.flatnonzero(sizes > _SMALL):
        run = prints[starts[at]:starts[at] + sizes[at]]
        found += _forest(run, run, bits)
    return found


def cell_links(cells: DataFrame, bits: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between fingerprints of a cell that connect all of its links.

    Cells are sorted and read run by run. A run longer than ``block`` is written out in blocks, and each pair of its
    blocks is compared by a task of its own, so a cell of any size is shared between tasks and none holds more than two
    blocks. A task returns a forest, never all pairs.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = _Joined()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows, cut, number = 0, None, 0  # cut: the cell that is being written out in blocks

        def look(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, cut, number
            cell = np.concatenate([c for c, _ in held] or [np.zeros(0, np.int64)])
            bit = np.concatenate([p for _, p in held] or [np.zeros(0, np.uint64)])
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(cell)]
            plain = np.ones(len(cell), bool)
            keep = len(cell) if last or not len(cell) else starts[-1]  # the last run may go on
            for s, e in zip(starts, ends):
                whole = last or e < len(cell)
                if cell[s] != cut and e - s <= block:
                    continue
                plain[s:e] = False
                if cell[s] != cut:
                    cut, number = cell[s], 0
                full = e if whole else s + (e - s) // block * block
                for at in range(s, full, block):
                    yield _block(int(cut), number, bit[at:min(at + block, full)])
                    number += 1
                if not whole:
                    keep = full
            ready = np.flatnonzero(plain[:keep])
            new = joined.new(_compare(cell[ready], bit[ready], bits)) if len(ready) else []
            held, rows = [(cell[keep:], bit[keep:])], len(cell) - keep
            if new:
                yield _links(new)

        for batch in batches:
            held.append((batch.column("cell").to_numpy(), batch.column("print").to_numpy().view(np.uint64)))
            rows += len(batch)
            if rows >= _BATCH:
                yield from look(False)
        yield from look(True)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = _Joined()
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y")):
                sides = [np.frombuffer(side.as_buffer(), np.uint64) for side in (x, y)]
                new = joined.new(_forest(*sides, bits))
                yield pa.RecordBatch.from_arrays([_signed([p[i] for p in new]) for i in (0, 1)], ["a", "b"])

    found = stage(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(
        work, "a bigint, b bigint, cell bigint, block bigint, prints binary"), "cells")
    large = found.filter(F.col("prints").isNotNull()).select("cell", "block", "prints")
    x, y = (large.select("cell", F.col("block").alias(f"{n}_block"), F.col("prints").alias(n)) for n in ("x", "y"))
    pairs = x.join(y, "cell").filter("x_block <= y_block").repartition("cell", "x_block", "y_block")
    return found.filter(F.col("a").isNotNull()).select("a", "b").union(pairs.select("x", "y").mapInArrow(across, "a bigint, b bigint"))


def print_classes(rows: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """(print, component_id) from rows (doc_id, print): the smallest doc_id that links of fingerprints reach.

    Equal fingerprints are one node, so copies cost nothing. Rows without id take part; an id is null only if no document
    of the class has one.
    """
    nodes = stage(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "prints")
    roots = stage(components(cell_links(grid(nodes.select("print")), bits)), "roots")
    joined = nodes.join(roots, nodes["print"] == roots["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(least, "root").select("print", "component_id")


def near_duplicates(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, bits: int = MOST_BITS
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row, in no order.

    Texts are lower-cased in A-Z and cut into words at ASCII white space. Texts of fewer words than a shingle are one
    shingle; those without words, null included, have fingerprint 0 and link to each other. Fingerprints link if they
    differ in ``bits`` bits or fewer (4 at most, for which the grid is made). Other columns are left out.
    """
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"the grid finds links of 0 to {MOST_BITS} bits")
    rows = stage(df.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), shingle).alias("print")), "prints")
    classes = stage(print_classes(rows, bits), "classes")
    return rows.join(classes, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, bits: int = MOST_BITS
) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each class the row with the smallest id stays, rows without id last.

    Rows that tie in id keep the first as written. All rows are staged with a number of their own and their fingerprint;
    the rest reads these two columns, and the rows that go are removed by number, broadcast if they are few.
    """
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"the grid finds links of 0 to {MOST_BITS} bits")
    number, mark = fresh(df, "number_", "print_")
    rows = stage(df.withColumns({number: F.monotonically_increasing_id(), mark: fingerprints(F.col(text), shingle)}), "rows")
    prints = rows.select(F.col(number).alias("number"), F.col(mark).alias("print"), F.col(doc_id).alias("doc_id"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number")
    nodes = stage(prints.groupBy("print").agg(F.min(first).alias("first")), "nodes")
    roots = stage(components(cell_links(grid(nodes.select("print")), bits)), "roots")
    best = nodes.join(roots, nodes["print"] == roots["node"], "left").groupBy(
        F.coalesce("root", "print").alias("root")).agg(F.min("first").alias("first"))
    kept = best.select(F.col("first.number").alias("number"))
    gone = stage(prints.select("number").join(kept, "number", "left_anti").withColumnRenamed("number", number), "gone")
    return rows.join(gone, number, "left_anti").select(*df.columns)
