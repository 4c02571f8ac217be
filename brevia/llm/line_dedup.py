"""Boilerplate lines of a site, found by the share of its pages that contain them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brevia.llm.common import fresh, others
from brevia.session import stage

# A line on more than this share of a site's pages is boilerplate.
BOILERPLATE_RATIO = 0.1
# On a small site a line needs at least this many pages, so that a page's own lines never count.
LEAST_PAGES = 3
_EDGES = " \t\r"


def host_of(url: Column) -> Column:
    """Host of a URL, in lower case and without port or user; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(_EDGES))


def _keys(lines: Column) -> Column:
    """Digest of each line with content; lines of white space have none."""
    return F.transform(F.filter(lines, lambda line: _bare(line) != ""), lambda line: F.md5(_bare(line)))


def boilerplate_lines(
    df: DataFrame, host: str = "source", text: str = "text", ratio: float = BOILERPLATE_RATIO,
    least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """One row (host, lines) for each site with boilerplate: the MD5 digests of its boilerplate lines.

    Lines are compared without spaces, tabs and carriage returns at their ends. A line counts once a page. Every row is a
    page of its host, also one without text; rows without host are a site of their own. Only digests are shuffled, and
    summed before. A site's list stays short by its definition: fewer lines than the mean of lines a page over ``ratio``.
    """
    pages = df.select(F.col(host).alias("host"), F.split(F.col(text), "\n").alias("lines"))
    totals = df.groupBy(F.col(host).alias("site")).agg(F.count(F.lit(1)).alias("pages"))
    found = pages.select("host", F.explode(F.array_distinct(_keys(F.col("lines")))).alias("line")).groupBy(
        "host", "line"
    ).agg(F.count(F.lit(1)).alias("found")).filter(F.col("found") >= least_pages)
    return found.join(totals, F.col("host").eqNullSafe(F.col("site"))).filter(
        F.col("found") > F.lit(ratio) * F.col("pages")
    ).groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(
    df: DataFrame, host: str = "source", text: str = "text", ratio: float = BOILERPLATE_RATIO,
    least_pages: int = LEAST_PAGES, lines: str = "n_lines", dropped: str = "n_dropped",
) -> DataFrame:
    """The rows with boilerplate lines cut from ``text``, and two more columns: lines before, lines cut.

    A line goes if it is on more than ``ratio`` of its host's pages and on ``least_pages`` or more. Blank lines stay. A
    text of boilerplate only becomes empty; a null text stays null, with 0 lines; an empty one has one line. Repeated rows
    count as pages of their own and are all kept. Other columns pass through; those named like the two new ones are
    replaced.

    The boilerplate lists are written to the shared folder first, so the optimiser knows their size: it broadcasts them
    below its threshold and else joins by host, splitting hot hosts. Texts are not shuffled in the first case.
    """
    site, cut, rows, hits, kept = fresh(df, "site_", "cut_", "rows_", "hits_", "kept_")
    lists = stage(boilerplate_lines(df, host, text, ratio, least_pages), "boilerplate").select(
        F.col("host").alias(site), F.col("lines").alias(cut)
    )
    found = F.when(F.col(cut).isNotNull(), F.array_intersect(_keys(F.col(rows)), F.col(cut)))
    left = F.filter(F.col(rows), lambda line: (_bare(line) == "") | ~F.array_contains(F.col(hits), F.md5(_bare(line))))
    split = (
        df.withColumn(rows, F.split(F.col(text), "\n"))
        .join(lists, F.col(host).eqNullSafe(F.col(site)), "left")
        .withColumn(hits, found)
        .withColumn(kept, F.when(F.size(hits) > 0, left).otherwise(F.col(rows)))
    )
    before, after = (F.coalesce(F.size(F.col(c)), F.lit(0)) for c in (rows, kept))
    return split.select(
        *others(df, text, lines, dropped),
        F.array_join(kept, "\n").alias(text),
        F.when(F.col(rows).isNull(), F.lit(0)).otherwise(before).cast("bigint").alias(lines),
        F.when(F.col(rows).isNull(), F.lit(0)).otherwise(before - after).cast("bigint").alias(dropped),
    ).select(*others(df, lines, dropped), lines, dropped)


SQL = f"""
WITH numbered AS (SELECT row_number() OVER () AS page, doc_id, source, text FROM documents),
bare AS (
    SELECT page, source, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS key FROM (
        SELECT page, source, unnest(string_split(text, chr(10))) AS line,
            generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM numbered)),
totals AS (SELECT source, count(*) AS pages FROM numbered GROUP BY source),
found AS (SELECT source, key, count(DISTINCT page) AS found FROM bare WHERE key <> '' GROUP BY source, key),
cut AS (
    SELECT f.source, f.key FROM found f JOIN totals t ON f.source IS NOT DISTINCT FROM t.source
    WHERE f.found >= {LEAST_PAGES} AND f.found > CAST({BOILERPLATE_RATIO} AS DOUBLE) * t.pages),
marked AS (
    SELECT b.*, c.key IS NOT NULL AS gone FROM bare b
    LEFT JOIN cut c ON b.source IS NOT DISTINCT FROM c.source AND b.key = c.key),
joined AS (
    SELECT page, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) AS n_lines,
        count(*) FILTER (gone) AS n_dropped
    FROM marked GROUP BY page)
SELECT n.doc_id, n.source, j.text, coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_dropped, 0) AS n_dropped
FROM numbered n LEFT JOIN joined j USING (page)
"""
