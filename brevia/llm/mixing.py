"""Mixing sources to target sizes by repeating documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from brevia.llm.common import fresh, others, word_count
from brevia.operators.numbering import rank_rows
from brevia.session import stage

# Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
# Size of the mix over the size of all documents, and most repetitions of a source.
SHARE = 1.5
MOST_REPEATS = 2
SEED = 42
NEW = ("size", "source_size", "target", "copies")
_DIGITS = 13  # hex digits of a digest that make a draw; 52 bits are exact in a double


def draw(*parts: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends only on the seed and the parts; null parts count as empty."""
    texts = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *texts))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS
) -> DataFrame:
    """Target size of each source from rows (source, source_size), one for each source.

    Sources are ranked by code point, null last, and weighted in turn. All targets together are ``share`` of all sizes.
    No target exceeds ``most`` times its source; what is above goes to the others by weight until none is above. That is
    one water level: target = min(most * size, level * weight). The level rises until the set below it stands still; each
    step is one sum over the sources, so no list of them reaches the driver. Sources without words get 0.
    """
    ranked = rank_rows(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], "rank", start=0)
    turn = F.array(*(F.lit(int(w)) for w in weights))
    ranked = stage(ranked.select(
        "source", "source_size", F.element_at(turn, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).alias("weight"),
        (F.lit(float(most)) * F.col("source_size")).alias("cap"),
    ), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    wanted, level, full = share * total, 0.0, None
    while True:
        below = F.lit(level) * F.col("weight") > F.col("cap") if full is not None else F.lit(False)
        now = ranked.agg(
            F.coalesce(F.sum(F.when(below, F.col("cap"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~below, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count(F.when(below, True)).alias("full"),
        ).first()
        if now["full"] == full or not now["weight"]:
            break
        level, full = max(level, (wanted - now["held"]) / now["weight"]), now["full"]
        if not full and total == 0:
            break
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight")) if now["weight"] else F.col("cap")
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def with_copies(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, seed: int = SEED,
) -> DataFrame:
    """Each row with size, source_size, target (of its source) and copies, the times the mix emits it.

    Size is the number of words, 0 for a null text. The rate of a source is target over size; a document is emitted
    floor(rate) times, and once more if its draw is below the remaining fraction. The draw hashes the seed, the id and
    the text, so reruns and other partitionings agree. Rows alike in id and text share their draw. A null source is a
    source of its own. Columns of the input named like a new one are replaced. An empty table gives no rows.

    Sizes are summed by source before the shuffle, so a hot source costs no more. The targets are staged: the optimiser
    broadcasts them below its threshold, and else splits hot sources in the join.
    """
    site = fresh(docs, "site_")[0]
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(word_count(F.col(text))).alias("source_size"))
    targets = stage(source_targets(sizes, weights, share, most), "targets").withColumnRenamed("source", site)
    joined = docs.select(*others(docs, *NEW)).join(
        targets, F.col(source).eqNullSafe(F.col(site)), "left"
    ).drop(site)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = draw(F.col(doc_id), F.col(text), seed=seed) < rate - F.floor(rate)
    return joined.withColumns({
        "size": word_count(F.col(text)), "copies": (F.floor(rate) + extra.cast("int")).cast("bigint"),
    })


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed rows with the columns of ``docs``: each document as often as ``with_copies`` says. Settings as there."""
    copies, turn, *held = fresh(docs, "copies_", "turn_", "h0_", "h1_", "h2_", "h3_")
    clash = dict(zip((c for c in docs.columns if c.lower() in NEW), held))
    planned = with_copies(docs.withColumnsRenamed(clash), **settings).withColumnRenamed("copies", copies)
    emitted = planned.filter(F.col(copies) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return emitted.select(*(F.col(clash.get(c, c)).alias(c) for c in docs.columns))


SQL = rf"""
WITH sized AS (
    SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
    FROM sized GROUP BY source),
ranked AS (
    SELECT *, CAST(2 * source_size AS DOUBLE) AS cap,
        row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS pos FROM sources),
levels AS (
    SELECT pos, cap, weight,
        (1.5 * CAST(sum(source_size) OVER () AS DOUBLE)
            - CAST(coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
        / CAST(sum(weight) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
    FROM ranked),
level AS (SELECT level FROM levels WHERE level * weight <= cap ORDER BY pos LIMIT 1),
targets AS (SELECT source, source_size, least(cap, (SELECT level FROM level) * weight) AS target FROM ranked),
drawn AS (
    SELECT s.doc_id, s.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS rate,
        CAST(CAST('0x' || substr(md5('42|' || coalesce(CAST(s.doc_id AS VARCHAR), '') || '|' || coalesce(s.text, '')), 1, 13)
            AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn
"""
