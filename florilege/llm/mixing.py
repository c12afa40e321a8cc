"""Mixing sources to target weights with hash-threshold histograms.

Tokens are summed by source and hash bucket. The budget of a source becomes whole passes over it and a part of one
more pass; that part is the documents whose hash lies under a threshold, found in the histogram. Only the bucket in
which the threshold falls is looked at by document. Thresholds are nested: a larger budget keeps every document of
a smaller one. Nothing is sorted, and documents are never collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.llm.common import cut, tokenizer_path

TOKENIZER = "byte_bpe_50k.tiktoken"
BUCKETS = 4096
#: Pieces of a text that the tokenizer gets at a time.
BATCH = 256


@cache
def _encoding(path: str):
    import base64
    import importlib.util
    import os
    import sys

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    init = os.path.join(os.path.dirname(path), "__init__.py")
    if os.path.exists(init) and (spec := importlib.util.spec_from_file_location("_vocabulary", init)):
        module = importlib.util.module_from_spec(spec)
        sys.modules["_vocabulary"] = module
        spec.loader.exec_module(module)
        pattern = getattr(module, "PATTERN", pattern)
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = _encoding(path).encode_ordinary
    for batch in batches:
        n = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
        kept = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(n, pa.int64())], names=[*kept.schema.names, "tokens"])


def source_key(source: Column) -> Column:
    """A source's name however it is spelled: lower case, anything else than letters and digits as one underscore."""
    key = F.trim(F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))
    return F.when(key != "", key)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens): the size of every document; null, empty and blank texts have none and are left out.

    Repeated rows of a document count once.
    """
    path = path or tokenizer_path(TOKENIZER)
    rows = docs.where("doc_id IS NOT NULL AND text RLIKE '\\\\S'").select("doc_id", source_key(F.col("source")).alias("source"), "text")
    counts = rows.mapInArrow(lambda b: _count(b, path), "doc_id long, source string, tokens long")
    return counts.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens"))


def budgets(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, budget): tokens each target source should give.

    Without a total the mixture is as large as the scarcest source with documents allows, so that all of them reach
    their shares. Sources without documents have no budget; sources without a target are left out.
    """
    want = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("max_repeats"))
    want = want.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").cast("int").alias("max_repeats"))
    have = sizes.where("source IS NOT NULL").groupBy("source").agg(F.sum("tokens").alias("available"))
    both = want.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("long"))
    reach = F.when(F.col("available") > 0, F.col("available") * F.col("max_repeats") / F.col("target_share"))
    whole = F.lit(total) if total is not None else F.floor(F.min(reach).over(Window.partitionBy()))
    budget = F.least(F.floor(whole * F.col("target_share") + F.lit(1e-6)), F.col("available") * F.col("max_repeats"))
    return both.withColumn("budget", F.when(F.col("available") > 0, budget).otherwise(0).cast("long"))


def mixed(sizes: DataFrame, targets: DataFrame, total: int | None = None, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """(doc_id, source, tokens, repeats) of the documents chosen, ``repeats`` being how often each is taken.

    ``sizes`` has doc_id, source and tokens and is read three times, so it should be materialised. The part pass of a
    source ends at the last document, in hash order, that still fits its budget.
    """
    # A row for each target source: a bounded table, and the histogram has at most ``buckets`` rows for each.
    plan = budgets(sizes, targets, total).withColumn("passes", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0))
    plan = plan.withColumn("rest", F.col("budget") - F.col("passes") * F.col("available"))
    hashed = sizes.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.floor(F.shiftrightunsigned("h", 1) / F.lit(2.0**63 / buckets)).cast("int"))
    histogram = hashed.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
    cumulated = histogram.withColumn("upto", upto).join(plan.select("source", "rest"), "source")
    edge = cumulated.where("upto > rest").groupBy("source").agg(F.min("bucket").alias("edge"))
    filled = cumulated.where("upto <= rest").groupBy("source").agg(F.max("upto").alias("filled"))
    plan = plan.join(edge, "source", "left").join(filled, "source", "left").withColumns({"edge": F.coalesce("edge", F.lit(buckets)), "filled": F.coalesce("filled", F.lit(0))})
    # The plan has a row for each target; it is broadcast, and only boundary buckets are ordered within.
    plan = F.broadcast(cut(plan))
    docs = hashed.join(plan, "source")
    boundary = docs.where("bucket = edge").withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    inside = boundary.where(F.col("filled") + F.col("upto") <= F.col("rest")).select("doc_id", F.lit(1).alias("extra"))
    once = docs.where("bucket < edge").select("doc_id", "source", "tokens", (F.col("passes") + 1).alias("repeats"))
    more = docs.where("bucket = edge").join(inside, "doc_id", "left").select("doc_id", "source", "tokens", (F.col("passes") + F.coalesce("extra", F.lit(0))).alias("repeats"))
    beyond = docs.where("bucket > edge").select("doc_id", "source", "tokens", F.col("passes").alias("repeats"))
    return once.unionByName(more).unionByName(beyond).where("repeats > 0").select("doc_id", "source", "tokens", F.col("repeats").cast("int").alias("repeats"))


def shares(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, budget, taken, documents, repeats, actual_share) of every target."""
    chosen = mixed(sizes, targets, total).groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("taken"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("repeats"))
    plan = budgets(sizes, targets, total)
    rows = plan.join(chosen, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("taken", "documents", "repeats")})
    everything = F.sum("taken").over(Window.partitionBy())
    return rows.withColumn("actual_share", F.when(everything > 0, F.round(F.col("taken") / everything, 6)).otherwise(F.lit(0.0)))
