"""Sinks: Markdown with front matter, reports, chunk tables and run results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.operators.chunks import layout_order


def markdown(meta: Column, body: Column) -> Column:
    """A document with its metadata in front; double quotes in values become single ones."""
    lines = F.transform(F.map_entries(meta), lambda e: F.concat(e["key"], F.lit(': "'), F.replace(F.coalesce(e["value"], F.lit("")), F.lit('"'), F.lit("'")), F.lit('"')))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), body)


def write_chunks(df: DataFrame, path: str) -> None:
    """Chunk table in zstd Parquet, laid out by family, group and URL; what was there is replaced."""
    layout_order(df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.write.mode("overwrite").json(path)


def write_run(results: DataFrame, path: str) -> None:
    """Case results as JSON, a folder for each run_id; folders of other runs stay."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(path)


def write_errors(errors: DataFrame, path: str) -> None:
    """Failed pages as CSV with a header."""
    errors.select("url", "referrer", "error").write.mode("overwrite").option("header", "true").csv(path)
