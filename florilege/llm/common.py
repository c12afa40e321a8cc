"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.storage import checkpoint_dir, cut

__all__ = ["WORD", "checkpoint_dir", "cut", "host_of", "spread", "table", "tokenizer_path"]
#: A run of Unicode letters and digits.
WORD = re.compile(r"[^\W_]+")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, pruned to the columns named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it has fewer, so that one small file isn't one Python task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; null where there is none."""
    authority = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\\s]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":\d*$", "")
    return F.when(host != "", host)


def tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file; FLORILEGE_TOKENIZERS overrides the folder."""
    return os.path.join(os.environ.get("FLORILEGE_TOKENIZERS", "/opt/tokenizers"), name)
