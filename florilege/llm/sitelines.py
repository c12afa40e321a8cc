"""Lines repeated across the documents of one site, by bitmaps of the pages that hold them.

Pages get dense numbers within hash containers of at most 2**15 pages. Every variant of a line has one bitmap a
container; the variants' bitmaps are united under their line key, cardinalities are added up exactly, and
lines are deleted by looking up their page in the bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.llm.common import cut, host_of

MIN_PAGES, MIN_SHARE, MIN_KEY = 5, 0.05, 10
CONTAINER = 1 << 15


def line_keys(text: Column) -> Column:
    """Line keys of a text, in order: lower case, digits as 0, anything else than letters and digits as one blank."""
    keys = F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{Nd}+", "0"), r"[^\p{L}\p{N}\n]+", " ")
    return F.transform(F.split(keys, "\n", -1), lambda x: F.trim(x))


def _lines(df: DataFrame) -> DataFrame:
    """(url, host, key, variant) of every line whose key is long enough; rows without text or host have none."""
    rows = df.select(F.col("source_url").alias("url"), host_of(F.col("source_url")).alias("host"), "text").where("text IS NOT NULL AND host IS NOT NULL")
    both = F.arrays_zip(line_keys(F.col("text")).alias("k"), F.split("text", "\n", -1).alias("v"))
    lines = rows.select("url", "host", F.explode(both).alias("x")).where(F.length("x.k") >= MIN_KEY)
    return lines.select("url", "host", F.col("x.k").alias("key"), F.xxhash64("x.v").alias("variant"), F.xxhash64("host", "x.k").alias("kh"))


def _pages(df: DataFrame) -> DataFrame:
    """Every distinct page with its container and bit position."""
    urls = df.select(F.col("source_url").alias("url")).where("url IS NOT NULL").distinct()
    parts = max(1, urls.count() // (CONTAINER // 2))
    numbered = urls.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(parts))).withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("url")) - 1)
    return numbered.select("url", host_of(F.col("url")).alias("host"), (F.col("part") * 64 + F.floor(F.col("n") / CONTAINER)).alias("container"), (F.col("n") % CONTAINER).cast("long").alias("bit"))


def line_bitmaps(df: DataFrame, min_pages: int = MIN_PAGES, by: str = "key") -> DataFrame:
    """(host, key, container, pages): the bitmap of the pages of a host that hold a line, variants united.

    With ``by`` set to kh the keys are hashes of host and key, which keeps long keys out of the shuffle.

    A key on fewer than ``min_pages`` rows can't reach that many pages and gets no bitmap; all others do.
    """
    lines = _lines(df)
    often = lines.groupBy("kh").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).select("kh")
    rows = lines.join(often, "kh", "left_semi").select("url", "host", by, "variant")
    at = rows.join(_pages(df).select("url", "container", "bit"), "url")
    variants = at.groupBy("host", by, "variant", "container").agg(F.bitmap_construct_agg("bit").alias("b"))
    return variants.groupBy("host", by, "container").agg(F.bitmap_or_agg("b").alias("pages"))


def repeated_lines(df: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, line_key, n_pages, host_pages) of keys on at least ``min_pages`` pages and that share of their host's."""
    found = line_bitmaps(df, min_pages).groupBy("host", "key").agg(F.sum(F.bitmap_count("pages")).alias("n_pages"))
    hosts = _host_pages(df)
    # Both sides of a threshold in whole numbers: a share of 5 % is n * 100 >= 5 * pages.
    enough = (F.col("n_pages") >= min_pages) & (F.col("n_pages") * 10000 >= F.col("host_pages") * round(min_share * 10000))
    return found.join(hosts, "host").where(enough).select("host", F.col("key").alias("line_key"), "n_pages", "host_pages")


def _host_pages(df: DataFrame) -> DataFrame:
    pages = df.select(host_of(F.col("source_url")).alias("host"), F.col("source_url").alias("url")).where("host IS NOT NULL").distinct()
    return pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))


def without_repeated_lines(df: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(id, source_url, text, removed): every distinct chunk without the repeated lines of its host.

    A line goes if its page's bit is set in the bitmap of its key. Lines travel as hashes and line numbers to delete
    are gathered per chunk, so the texts are shuffled once. Chunks without host or text stay as they are.
    """
    counted = line_bitmaps(df, min_pages, by="kh").withColumn("n", F.sum(F.bitmap_count("pages")).over(Window.partitionBy("host", "kh")))
    enough = (F.col("n") >= min_pages) & (F.col("n") * 10000 >= F.col("host_pages") * round(min_share * 10000))
    # A host's repeated lines are at most its lines a page divided by the least share.
    chosen = cut(counted.join(_host_pages(df), "host").where(enough).select("kh", "container", "pages"))
    base = df.select("id", "source_url", "text").withColumn("_k", F.xxhash64("id", "source_url", "text"))
    chunks = base.groupBy("_k").agg(*[F.first(c).alias(c) for c in ("id", "source_url", "text")])
    host = host_of(F.col("source_url"))
    lines = base.where("text IS NOT NULL").select("_k", F.col("source_url").alias("url"), host.alias("host"), F.posexplode(line_keys(F.col("text"))).alias("no", "key")).where((F.length("key") >= MIN_KEY) & F.col("host").isNotNull())
    near = lines.select("_k", "url", "no", F.xxhash64("host", "key").alias("kh")).join(chosen.select("kh").distinct(), "kh", "left_semi")
    hit = near.join(_pages(df).select("url", "container", "bit"), "url").join(chosen, ["kh", "container"]).where(_bit(F.col("pages"), F.col("bit")))
    gone = hit.groupBy("_k").agg(F.collect_set("no").alias("gone"))  # at most as many as a chunk has lines
    none = F.array().cast("array<int>")
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(F.coalesce("gone", none), i))
    return chunks.join(gone, "_k", "left").select("id", "source_url", F.array_join(kept, "\n").alias("text"), F.size(F.coalesce("gone", none)).alias("removed"))


def _bit(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (bit % 8).cast("int")) == 1
