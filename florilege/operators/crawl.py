"""The link graph of a crawl: frontier by depth, and what a new crawl has to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.storage import cut


def frontier(edges: DataFrame, seeds: DataFrame, most_depth: int = 50) -> DataFrame:
    """(url, depth, parent): pages reached from the seeds over edges (src, dst, high), breadth first.

    A page belongs to the first depth that reaches it; its parent is the least page of the depth before. Each depth
    is one anti-join against what is visited, written before the next.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst").distinct()
    now = cut(seeds.select("url").where("url IS NOT NULL").distinct().select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")))
    seen = now
    for depth in range(1, most_depth + 1):
        reached = now.select(F.col("url").alias("src")).join(edges, "src").groupBy("dst").agg(F.min("src").alias("parent"))
        now = cut(reached.join(seen.select(F.col("url").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("url"), F.lit(depth).alias("depth"), "parent"))
        if now.isEmpty():
            break
        seen = seen.unionByName(now)
    return seen


def crawl_order(pages: DataFrame) -> DataFrame:
    """``pages`` (url, depth, priority_score) with ``position``: within a depth high-value pages first, then by URL.

    Positions are ranks within the depth; a depth is one range of the crawl.
    """
    return pages.withColumn("position", F.row_number().over(Window.partitionBy("depth").orderBy(F.desc(F.col("priority_score") >= 4), "url")))


def file_date(file: str = "file"):
    """Date in front of a file name, or null where there is no valid one."""
    return F.regexp_extract(file, r"(?:^|/)(\d{4}-\d{2}-\d{2})_[^/]*$", 1).try_cast("date")


def corpus_diff(files: DataFrame, links: DataFrame, as_of, days: int = 7) -> DataFrame:
    """(url, state): fresh, stale or discovered.

    ``files`` has source_url and file: a page is fresh if one of its files is dated at most ``days`` before ``as_of``,
    otherwise stale; links that are neither are discovered. Files without date are stale, null URLs are left out.
    """
    dated = files.where("source_url IS NOT NULL").groupBy(F.col("source_url").alias("url")).agg(F.max(file_date("file")).alias("d"))
    known = dated.select("url", F.when(F.col("d") >= F.date_sub(F.lit(as_of).cast("date"), days), "fresh").otherwise("stale").alias("state"))
    found = links.select(F.col("link").alias("url")).where("url IS NOT NULL").distinct().join(known.select("url"), "url", "left_anti").select("url", F.lit("discovered").alias("state"))
    return known.unionByName(found)


def errors_with_referrers(errors: DataFrame, referrers: DataFrame) -> DataFrame:
    """(url, referrer, error): every failed page with the page that led to it, ``(unknown)`` where there is none."""
    first = referrers.groupBy("url").agg(F.min("referrer").alias("referrer"))
    return errors.join(first, "url", "left").select("url", F.coalesce("referrer", F.lit("(unknown)")).alias("referrer"), "error")
