"""Chunks of documents: split at headings, then by size, with breadcrumbs, ids and counts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.functions.ids import chunk_id
from florilege.operators.pages import chunk_faculty

SIZE, OVERLAP = 1000, 200
HEADING = re.compile(r"^(#{1,3}) +(.*)$")
FENCE = re.compile(r"^\s*(```|~~~)")
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def sections(text: str) -> list[tuple[str, str]]:
    """(breadcrumb, text) of the sections of a Markdown text; headings stay in the text, code fences are no headings."""
    out, path, lines, fenced = [], {}, [], False

    def close() -> None:
        body = "\n".join(lines).strip()
        if body:
            out.append((" > ".join(path[k] for k in sorted(path)), body))
        lines.clear()

    for line in text.split("\n"):
        if FENCE.match(line):
            fenced = not fenced
        m = None if fenced else HEADING.match(line.strip())
        if m:
            close()
            level = len(m.group(1))
            path = {k: v for k, v in path.items() if k < level}
            path[level] = m.group(2).strip()
        lines.append(line)
    close()
    return out


def split(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that does, neighbours sharing up to ``overlap``."""
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next(s for s in separators if s == "" or s in text)
    finer = separators[separators.index(sep) + 1 :] or ("",)
    parts = list(text) if sep == "" else text.split(sep)
    out, held, length = [], [], 0

    def flush() -> None:
        piece = sep.join(held).strip()
        if piece:
            out.append(piece)

    for part in parts:
        if len(part) > size:
            if held:
                flush()
            held, length = [], 0
            out += split(part, size, overlap, finer)
            continue
        if held and length + len(sep) + len(part) > size:
            flush()
            while held and (length > overlap or length + len(sep) + len(part) > size):
                length -= len(held.pop(0)) + (len(sep) if held else 0)
        length += len(part) + (len(sep) if held else 0)
        held.append(part)
    if held:
        flush()
    return out


def _chunks(batches: Iterator[pa.RecordBatch], size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of, index, total, heading, texts = [], [], [], [], []
        for k, body in enumerate(batch.column("_body").to_pylist()):
            pieces = [(h, p) for h, s in sections(body) for p in split(s, size, overlap)]
            for i, (h, p) in enumerate(pieces):
                of.append(k)
                index.append(i)
                total.append(len(pieces))
                heading.append(h)
                texts.append(p)
        kept = batch.drop_columns(["_body"]).take(pa.array(of, pa.int32()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(heading, pa.string()), pa.array(texts, pa.string()), pa.array(index, pa.int32()), pa.array(total, pa.int32())], names=[*kept.schema.names, "section_heading", "text", "chunk_index", "total_chunks"])


def chunk(df: DataFrame, body: str, keep: list[str], size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id, keep.., faculty, section_heading, text, chunk_index, total_chunks) of every document with text.

    ``keep`` must hold source_url. Null and empty bodies give no chunks.
    """
    rows = df.where(F.col(body).isNotNull()).select(*keep, F.col(body).alias("_body"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_body")
    out = rows.mapInArrow(lambda b: _chunks(b, size, overlap), f"{schema}, section_heading string, text string, chunk_index int, total_chunks int")
    return out.withColumns({"id": chunk_id(F.col("source_url"), F.col("chunk_index")), "faculty": chunk_faculty(F.coalesce("source_url", F.lit("")))})


def layout_order(df: DataFrame) -> DataFrame:
    """Documents ordered for writing: by family, group, URL and name, unknown ones last."""
    last = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("zz_unknown"))
    return df.repartitionByRange(last("source_family"), last("document_group"), last("source_url")).sortWithinPartitions(last("source_family"), last("document_group"), last("source_url"))


def latest(df: DataFrame, key: str = "id", date: str = "crawl_date") -> DataFrame:
    """One row for each key: the one with the latest date, nulls and malformed dates first; the upsert of a store."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col(date).try_cast("date"), F.lit("0001-01-01").cast("date")), F.coalesce(F.col(date).cast("string"), F.lit(""))))
    return df.groupBy(key).agg(best.alias("_x")).select(key, *[F.col(f"_x.{c}").alias(c) for c in rest])
