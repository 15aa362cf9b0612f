"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_hot, settle

#: A line is boilerplate of a site if more than this share of the site's pages has it ...
RATIO = 0.01
#: ... and at least so many pages, or more than this share of them (but two at least).
MIN_PAGES = 5
SMALL_RATIO = 0.5
#: Copies of each site's page total, so that the lines of one large site are spread over tasks.
SALTS = 32


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def boilerplate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Lines (by the md5 of their trimmed text) that stand on more than ``ratio`` of their site's pages.

    Columns: site, line (binary), pages_with, pages, first_id (the smallest id that has it).
    """
    one = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.col(text_col).alias("text"))
    totals = one.groupBy("site").agg(F.count(F.lit(1)).alias("pages")).select("site", "pages", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    counts = _lines(one).groupBy("site", "line").agg(F.count(F.lit(1)).alias("pages_with"), F.min("id").alias("first_id")).where(F.col("pages_with") >= min(2, min_pages))
    salted = counts.withColumn("salt", F.pmod(F.xxhash64("line"), F.lit(SALTS)).cast("int"))
    often = (F.col("pages_with") >= min_pages) | (F.col("pages_with") > SMALL_RATIO * F.col("pages"))
    return salted.join(totals, ["site", "salt"]).where(often & (F.col("pages_with") > F.lit(ratio) * F.col("pages"))).select("site", "line", "pages_with", "pages", "first_id")


def _lines(one: DataFrame) -> DataFrame:
    """Each page's distinct lines that are not blank."""
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0), _key))
    return one.select("id", "site", F.explode(keys).alias("line"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Drops each site's boilerplate lines; all rows and columns of ``docs`` stay, with ``n_lines`` and ``n_dropped`` (long) added.

    Pages are grouped by site; a line's share is the number of the site's pages that contain it over the
    number of the site's pages. A line over ``ratio`` (and on ``min_pages`` pages at least, or on more than half of a small site's) is dropped from
    every page but the one with the site's smallest id that has it, so that a group of whole copies keeps one
    of them. Lines are compared trimmed of spaces; blank lines stay. Null text stays null and has no lines; a
    null site is a site of its own (with the empty name); a line that a page repeats counts once for it and
    is dropped at each place; rows that repeat an id count as pages of their own and are changed alike; rows
    with a null id count as pages and stay unchanged. Other columns pass through, whatever their names, but
    ``n_lines`` and ``n_dropped``, which are replaced.
    """
    one = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.col(text_col).alias("text"))
    bad = settle(boilerplate(docs, id_col=id_col, text_col=text_col, site_col=site_col, ratio=ratio, min_pages=min_pages))
    gone = join_hot(_lines(one), bad, ["site", "line"], "pages_with").where(F.col("id") != F.col("first_id")).groupBy("id", "site").agg(F.collect_set("line").alias("gone"))
    gone = gone.select(F.col("id").alias("__gone_id"), F.col("site").alias("__gone_site"), F.col("gone").alias("__gone"))
    named = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*named).join(gone, (F.col(id_col) == F.col("__gone_id")) & (F.coalesce(F.col(site_col).cast("string"), F.lit("")) == F.col("__gone_site")), "left")
    parts = F.split(F.col(text_col), "\n")
    left = F.when(F.col("__gone").isNull(), parts).otherwise(F.filter(parts, lambda x: ~F.array_contains(F.col("__gone"), _key(x))))
    joined = joined.withColumn("__parts", parts).withColumn("__left", left)
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    size = F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(count("__parts"))
    kept = F.when(F.col("__left").isNull(), F.lit(0)).otherwise(count("__left"))
    return joined.select(*[F.array_join("__left", "\n").alias(c) if c == text_col else F.col(c) for c in named], size.cast("long").alias("n_lines"), (size - kept).cast("long").alias("n_dropped"))


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


SQL = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
d AS (SELECT DISTINCT doc_id, site, trim(line, ' ') AS t FROM l WHERE length(trim(line, ' ')) > 0),
p AS (SELECT coalesce(source, '') AS site, count(*) AS pages FROM documents GROUP BY 1),
b AS (SELECT site, t, count(*) AS n, min(doc_id) AS first_id FROM d GROUP BY 1, 2),
bad AS (SELECT site, t, first_id FROM b JOIN p USING (site) WHERE n >= 2 AND (n >= {MIN_PAGES} OR n > {SMALL_RATIO}::DOUBLE * pages) AND n > {RATIO}::DOUBLE * pages),
m AS (SELECT l.*, bad.t IS NOT NULL AND l.doc_id <> bad.first_id AS gone
      FROM l LEFT JOIN bad ON bad.site = l.site AND bad.t = trim(l.line, ' ')),
a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS t
      FROM m GROUP BY doc_id)
SELECT documents.doc_id, documents.source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       sha256(coalesce(a.t, '')) AS text_sha256
FROM documents LEFT JOIN a USING (doc_id)
"""
