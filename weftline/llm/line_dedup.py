"""Operator 4: drop a site's boilerplate lines by their frequency among the site's pages (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, written

#: A line goes if it stands on more than this share of its host's pages, and on at least so many of them: on a host of
#: fewer than 1 / RATIO pages every line exceeds the share, so one that a single page has is spared there.
RATIO, MIN_PAGES = 0.1, 2
#: Boilerplate lines are broadcast up to this count; beyond it Spark joins them by host, splitting hot hosts.
BROADCAST_ROWS = 200_000


def _key(line: Column) -> Column:
    """128 bits of hash: no two lines of a corpus are taken for each other."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Lines that stand on more than `ratio` of the host's pages, as (host, key struct<a,b>, n_pages, host_pages).

    A page counts once however often it repeats a line. Lines of white space only aren't counted. Pages without text
    count in the host's total. A null host is a host of its own.
    """
    narrow = pages.select(host.cast("string").alias("host"), text.alias("text"))
    totals = narrow.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = narrow.select("host", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    counts = lines.select("host", _key(F.col("line")).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= min_pages)
    totals, counts = totals.withColumnRenamed("host", "host_"), counts
    return (
        counts.join(totals, F.col("host").eqNullSafe(F.col("host_")))
        .where(F.col("n_pages") > F.lit(ratio) * F.col("host_pages"))
        .select("host", "key", "n_pages", "host_pages")
    )


def drop_lines(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with the boilerplate lines of their host taken out of the text.

    All columns stay, and `n_lines`, `n_dropped` (long) are put into a struct column `line_dedup`. A null text stays
    null with zero lines; a page whose lines all go becomes empty. Blank lines stay. No row is dropped; repeated rows
    count as pages of their own. A host has at most (lines of its pages / pages / ratio) boilerplate lines, so the
    array joined to a page is bounded by that, whatever the size of the host.
    """
    spark = pages.sparkSession
    found = written(boilerplate(pages, F.col(f"`{host_col}`"), F.col(f"`{text_col}`"), ratio, min_pages), "boilerplate")
    by_host = found.groupBy(F.col("host").alias("__wl_host")).agg(F.collect_list("key").alias("__wl_keys"))
    if found.count() <= BROADCAST_ROWS:
        by_host = F.broadcast(by_host)
    out = pages.join(by_host, F.col(f"`{host_col}`").cast("string").eqNullSafe(F.col("__wl_host")), "left")
    lines = F.split(F.col(f"`{text_col}`"), "\n")
    kept = F.when(F.col("__wl_keys").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("__wl_keys"), _key(x)) | ~x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("__wl_kept", kept)
    n_lines, n_kept = (F.coalesce(F.size(x), F.lit(0)).cast("long") for x in (lines, F.col("__wl_kept")))
    n_lines, n_kept = F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(n_lines).cast("long"), F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(n_kept).cast("long")
    fields = [F.when(F.col("__wl_keys").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join("__wl_kept", "\n")).alias(c) if c == text_col else F.col(f"`{c}`") for c in pages.columns if c != "line_dedup"]
    return out.select(*fields, F.struct(n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped")).alias("line_dedup"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with each source taken as a site. Of lines above the ratio those that one page alone has are spared."""
    out = drop_lines(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.col("line_dedup.n_lines").alias("n_lines"), F.col("line_dedup.n_dropped").alias("n_dropped"), "text")


SQL = f"""
WITH l AS (SELECT doc_id, source, text, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents),
c AS (SELECT source, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1, 2),
t AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
bad AS (SELECT c.source, c.line FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO} * t.n),
b AS (SELECT source, list(line) AS lines FROM bad GROUP BY 1),
k AS (SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS lines,
      list_filter(string_split(d.text, chr(10)), lambda x: NOT coalesce(list_contains(b.lines, x), false)) AS kept
      FROM documents d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped,
       array_to_string(kept, chr(10)) AS text FROM k
"""
