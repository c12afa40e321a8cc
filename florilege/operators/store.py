"""The store of URL decisions: upsert in batches, and look-up by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(*batches: DataFrame) -> DataFrame:
    """One row for each normalized_url out of any number of batches of rows of the store's form.

    The first columns come from the earliest row, the last ones and the decision from the latest; seen_count adds
    up. Rows without last_seen count as seen at first_seen; ties go to the greater source, decision and reason. A
    null URL is a key of its own.
    """
    rows = batches[0]
    for b in batches[1:]:
        rows = rows.unionByName(b)
    seen = F.coalesce("last_seen", "first_seen")
    first = F.min(F.struct("first_seen", F.coalesce("first_source", F.lit("")).alias("s")))
    last = F.max(F.struct(seen.alias("t"), F.coalesce("last_source", "first_source", F.lit("")).alias("s"), "decision", "reason"))
    out = rows.groupBy("normalized_url").agg(first.alias("f"), last.alias("l"), F.sum("seen_count").alias("seen_count"))
    return out.select("normalized_url", "l.decision", "l.reason", F.col("f.first_seen").alias("first_seen"), F.col("l.t").alias("last_seen"), F.col("f.s").alias("first_source"), F.col("l.s").alias("last_source"), "seen_count")


def lookup(store: DataFrame, keys: DataFrame, key: str = "normalized_url") -> DataFrame:
    """``keys`` with the store's decision and reason, null where it has none."""
    return keys.join(store.select(F.col("normalized_url").alias(key), "decision", "reason"), key, "left")
