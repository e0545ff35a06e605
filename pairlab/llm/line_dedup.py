"""Removal of lines that many sites share, by merged distinct-count sketches, all in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.session import durable

MIN_SITES = 5
LG_K = 12  # a sketch has 2 ** LG_K registers; its relative error is about 1.04 / sqrt(2 ** LG_K)
SIGMAS = 4
BLANKS = " \t\r"


def _lines(text: F.Column) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _trimmed(line: str) -> F.Column:
    return F.btrim(F.col(line), F.lit(BLANKS))


def shared_lines(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """``(lines, spread)``: every line's place and hash, and the lines of ``min_sites`` sites or more.

    ``lines`` is ``(id, th, pos, h, g, site)`` and ``spread`` ``(h, g, sites, keep)``; ``keep`` is
    the first place of the line by identifier and position. A line's sites are counted by
    sketches that merge on the map side. Only where the estimate is too close to ``min_sites`` to
    decide are its sites counted exactly. Fewer occurrences than ``min_sites`` decide at once.
    """
    lines = durable(
        docs.select(
            F.col(id_col).alias("id"),
            F.xxhash64(text_col).alias("th"),
            F.col(site_col).cast("string").alias("site"),
            F.posexplode(_lines(F.col(text_col))).alias("pos", "line"),
        )
        .withColumn("line", _trimmed("line"))
        .where("line <> ''")
        # two hashes: at 10^12 lines one of 64 bits would join some lines by chance
        .select("id", "th", "pos", F.xxhash64("line").alias("h"), F.crc32("line").alias("g"), "site")
    )
    place = F.struct(F.col("id").isNull().alias("bare"), "id", "pos")
    counted = (
        lines.groupBy("h", "g")
        .agg(
            F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"),
            F.count("site").alias("n"),
            F.min(place).alias("keep"),
        )
        .where(F.col("n") >= min_sites)
        .select("h", "g", "keep", F.hll_sketch_estimate("sketch").alias("sites"))
    )
    margin = max(1.0, SIGMAS * 1.04 / 2 ** (LG_K / 2) * min_sites)
    counted = durable(counted.where(F.col("sites") >= min_sites - margin))
    sure = counted.where(F.col("sites") > min_sites + margin)
    near = counted.where(F.col("sites") <= min_sites + margin)
    exact = (
        lines.where(F.col("site").isNotNull())
        .join(near.select("h", "g"), ["h", "g"], "left_semi")
        .select("h", "g", "site")
        .distinct()
        .groupBy("h", "g")
        .agg(F.count(F.lit(1)).alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    close = near.drop("sites").join(exact, ["h", "g"])
    return lines, durable(sure.unionByName(close))


def remove_shared_lines(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    keep_first: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """All rows and columns of ``docs``, without lines that at least ``min_sites`` sites share.

    Adds ``n_lines`` and ``n_removed`` (columns of these names are replaced). Lines compare after
    blanks, tabs and carriage returns at their ends are cut; blank lines stay. With ``keep_first``
    a shared line stays where it occurs first, by identifier and position, so that its text is
    not lost; null identifiers come last.

    A null text stays null with no lines; an empty one stays empty. Rows with a null site are
    cleaned but count towards no line's sites. Repeated rows are treated alike. An empty table
    gives an empty result.

    Lines are shuffled as hashes; the texts move once, to meet the positions to drop.
    """
    lines, spread = shared_lines(docs, min_sites, id_col, text_col, site_col)
    drop = lines.join(spread.select("h", "g", "keep"), ["h", "g"])
    if keep_first:
        first = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("pos") == F.col("keep.pos"))
        drop = drop.where(~first)
    drop = drop.groupBy("id", "th").agg(F.collect_set("pos").alias("_drop"))
    base = docs.drop("n_lines", "n_removed")
    same = base[id_col].eqNullSafe(drop["id"]) & (F.xxhash64(base[text_col]) == drop["th"])
    joined = base.join(drop, same, "left").withColumn("_l", _lines(F.col(text_col)))
    kept = F.expr("array_join(filter(_l, (x, i) -> NOT array_contains(_drop, i)), '\n')")
    text = F.when(F.col("_drop").isNull(), F.col(text_col)).otherwise(kept)
    return joined.select(
        *[text.alias(c) if c == text_col else base[c] for c in base.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size("_l")).cast("bigint").alias("n_lines"),
        F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("bigint").alias("n_removed"),
    )


SQL = rf"""
WITH d AS (SELECT *, row_number() OVER () AS r FROM documents),
l AS (
  SELECT r, doc_id, source, unnest(generate_series(1, len(s))) AS pos, unnest(s) AS line
  FROM (SELECT r, doc_id, source, string_split(text, chr(10)) AS s FROM d WHERE text IS NOT NULL)),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM l),
shared AS (
  SELECT k FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT t.*, shared.k IS NOT NULL AND row_number() OVER (PARTITION BY t.k ORDER BY doc_id NULLS LAST, pos) > 1 AS gone
  FROM t LEFT JOIN shared ON t.k = shared.k),
out AS (
  SELECT r, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
  FROM marked GROUP BY r)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(out.text, '') END AS text, d.lang, d.source,
       CAST(coalesce(out.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(out.n_removed, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN out USING (r)
"""
