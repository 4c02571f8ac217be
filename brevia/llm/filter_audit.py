"""How document filters act together: what each removes at each step of every order, and its Shapley share."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brevia.llm.common import WORD, ship_package
from brevia.operators.joins import fits_broadcast, skew_join
from brevia.session import stage

FILTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
MARKS = "#$%&*|"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_EVERY = (1 << len(FILTERS)) - 1
_ORDERS = ["".join(order) for order in itertools.permutations(FILTERS)]


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: too few words, too few distinct ones, too many capitals, marks."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    conditions = (
        n < LEAST_WORDS,
        100 * distinct.cast("bigint") < DISTINCT_PERCENT * n.cast("bigint"),
        100 * capitals.cast("bigint") > CAPITAL_PERCENT * F.length(text).cast("bigint"),
        text.rlike(f"[{MARKS}]"),
    )
    return sum((F.when(failed, 1 << bit).otherwise(0) for bit, failed in enumerate(conditions)), F.lit(0))


def removed_by(counts: list[int]) -> list[int]:
    """Documents that each coalition of filters removes, from the documents of each set of failed filters."""
    return [sum(n for mask, n in enumerate(counts) if mask & coalition) for coalition in range(len(counts))]


def shapley_values(removed: list[int]) -> list[Fraction]:
    """The Shapley value of each filter from the removals of all coalitions, by least squares.

    The values are the linear game nearest to the removals under the Shapley kernel, with their sum fixed to what all filters
    remove together. The normal equations, with a multiplier for the sum, are solved by elimination over rationals, so the
    result is exact.
    """
    n = len(removed).bit_length() - 1
    rows = [[Fraction(0)] * (n + 2) for _ in range(n + 1)]
    for coalition in range(1, len(removed) - 1):
        size = coalition.bit_count()
        weight = Fraction(n - 1, math.comb(n, size) * size * (n - size))
        members = [i for i in range(n) if coalition >> i & 1]
        for i in members:
            for j in members:
                rows[i][j] += weight
            rows[i][n + 1] += weight * removed[coalition]
    for i in range(n):
        rows[i][n] = rows[n][i] = Fraction(1)
    rows[n][n + 1] = Fraction(removed[-1])
    for i in range(n + 1):
        pivot = next(r for r in range(i, n + 1) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [value / rows[i][i] for value in rows[i]]
        for r in range(n + 1):
            if r != i and rows[r][i]:
                rows[r] = [value - rows[r][i] * lead for value, lead in zip(rows[r], rows[i])]
    return [rows[i][n + 1] for i in range(n)]


def audit_part(counts: list[int], good: list[int], toxic: list[int]) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders and steps
    of one part, from its documents, those labelled good and those labelled toxic by the set of failed filters."""
    tables = [removed_by(n) for n in (counts, good, toxic)]
    total, orders = sum(counts), math.factorial(len(FILTERS))
    shares = [int(orders * value) for value in shapley_values(tables[0])]
    fails = [sum(n for mask, n in enumerate(counts) if mask >> bit & 1) for bit in range(len(FILTERS))]
    for order in _ORDERS:
        before = 0
        for step, letter in enumerate(order, start=1):
            bit = FILTERS.index(letter)
            after = before | 1 << bit
            removed, good_lost, toxic_lost = (table[after] - table[before] for table in tables)
            yield (
                order, step, total - tables[0][after], removed, fails[bit] - removed, counts[1 << bit], good_lost, toxic_lost,
                shares[bit])
            before = after


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _facts(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """(part, mask, good, toxic) for each document: the failed filters and labels."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = stage(docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        failures(whole).alias("mask"), F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(FILTERS), whole).alias("h2"),
    ), "facts")
    # Texts that more than one document has, by a hash of 128 bits. Sums are made before the shuffle.
    copies = stage(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("found")).filter(
        "found > 1").drop("found"), "copies")
    marks = stage(labels.groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).filter(
        F.col("doc_id").isNotNull() & (F.col("good") | F.col("toxic"))), "marks")
    found = skew_join(rows, copies, ["h1", "h2"], ["doc_id", "part"], fits_broadcast(copies), "left")
    found = skew_join(found, marks, ["doc_id"], ["h1", "part"], fits_broadcast(marks, ("doc_id",)), "left")
    repeats = F.when(F.col("doc_id") > F.col("least"), 1 << FILTERS.index("E")).otherwise(0)
    return found.select("part", (F.col("mask") + repeats).alias("mask"), *(
        F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")))


def audit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """600 rows (part, filter_order, step, kept, removed, ...) for each value of ``part``, null being the empty string.

    Each document is reduced to the set of filters it fails; a part's documents are then 32 counts, and everything else
    follows from them. A coalition of filters removes what fails any of them, a step removes the difference of two
    coalitions, and a filter's removals over all orders are its Shapley value times the orders.

    A null text is empty. A text repeats if a document with a smaller id has it, wherever that stands; a document without id
    never repeats, and documents of one id do not repeat each other. A document with several labels counts as good or toxic
    if one of them says so; a label without id marks none. Repeated rows are documents of their own. An empty table has no parts and no rows. Other
    columns are not read.

    The texts are read once; the slim facts are staged. Copies and labels are joined behind a check of their size, hot keys
    being split.
    """
    ship_package(docs.sparkSession)
    facts = _facts(docs, labels, doc_id, text, part)
    counts = facts.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("found"))  # 32 at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "filter_order", "step", *_COUNTS]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(_COUNTS)]
        for batch in batches:
            for name, found in zip(*(batch.column(c).to_pylist() for c in ("part", "found"))):
                tables = [[0] * (_EVERY + 1) for _ in range(3)]
                for row in found:
                    for table, value in zip(tables, (row["n"], row["good"], row["toxic"])):
                        table[row["mask"]] = value
                columns = zip(*((name, *row) for row in audit_part(*tables)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return parts.mapInArrow(work, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in _COUNTS))


_WORDS = r"list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
split AS (SELECT *, {_WORDS} AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM texts),
facts AS (
    SELECT part, len(words) < {LEAST_WORDS} AS a, 100 * len(list_distinct(words)) < {DISTINCT_PERCENT} * len(words) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(text) AS c,
        regexp_matches(text, '[{MARKS}]') AS d, coalesce(doc_id > least, false) AS e,
        coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
    FROM split LEFT JOIN labels USING (doc_id)),
fails AS (
    SELECT row_number() OVER () AS doc, part, good, toxic,
        map(['A', 'B', 'C', 'D', 'E'], [a, b, c, d, e]) AS failed, a::INT + b::INT + c::INT + d::INT + e::INT AS n_failed
    FROM facts),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
    SELECT v.f || w.f || x.f || y.f || z.f AS filter_order FROM letters v, letters w, letters x, letters y, letters z
    WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
patterns AS (
    SELECT part, failed, n_failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM fails GROUP BY ALL),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS f FROM orders, range(1, 6) r(s)),
hits AS (
    SELECT p.*, filter_order, min(step) FILTER (failed[f]) AS gone FROM patterns p, steps GROUP BY ALL),
counted AS (
    SELECT h.part, s.filter_order, s.step, s.f,
        sum(n) FILTER (gone IS NULL OR gone > step) AS kept, sum(n) FILTER (gone = step) AS removed,
        sum(n) FILTER (gone < step AND failed[f]) AS redundant, sum(n) FILTER (n_failed = 1 AND failed[f]) AS unique_fails,
        sum(good) FILTER (gone = step) AS good_lost, sum(toxic) FILTER (gone = step) AS toxic_lost
    FROM hits h JOIN steps s USING (filter_order) GROUP BY ALL)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in _COUNTS[:-1])},
    CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM counted
"""
