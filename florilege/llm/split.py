"""Splitting oversized texts at natural boundaries, with balanced targets.

For a text longer than the limit the least possible number of pieces is computed, equal-length targets are
placed, every target is snapped to the strongest boundary near it, and a piece is added whenever a limit fails.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1000, 200
#: Chunks of one page are renumbered in blocks of this many index values, so that no page is sorted by one task.
INDEX_BLOCK = 512
#: Strength of a boundary by the name of its group; the cut comes after the match.
STRENGTH = {"head": 6, "para": 5, "line": 4, "sent": 3, "clause": 2, "word": 1}
BOUNDARY = re.compile(
    r"(?P<head>\n+(?=\#{1,6} ))|(?P<para>\n[ \t]*\n\s*)|(?P<line>\n)"
    r"|(?P<sent>[.!?…。！？][\"'”»)\]]*(?:\s+|(?<=[。！？])))"
    r"|(?P<clause>[;:,、，]\s+|\s[–—]\s)|(?P<word>\s+)"
)


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Positions after which the text may be cut, and their strengths."""
    at, strength = [], []
    for m in BOUNDARY.finditer(text):
        if 0 < m.end() < len(text):
            at.append(m.end())
            strength.append(STRENGTH[m.lastgroup])
    return at, strength


def _joined(text: str, i: int) -> bool:
    """Whether position i would part a character from its combining marks or joiners."""
    return 0 < i < len(text) and (unicodedata.combining(text[i]) != 0 or text[i] in "‍︎️" or text[i - 1] == "‍")


def _plain(text: str, i: int, least: int) -> int:
    """Position i moved back, not below ``least``, until it parts no character."""
    j = i
    while j > least and _joined(text, j):
        j -= 1
    return j if j > least else i


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, shared) of every piece: ``shared`` leading characters repeat the end of the piece before.

    Every piece has at most ``limit`` characters, ``shared`` is at most ``overlap``, and the pieces without
    their shared parts are the text again.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, 0)]
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    at, strength = boundaries(text)
    room = limit - overlap
    count = max(2, -(-(n - overlap) // room))
    while True:
        target = n / count
        slack = max(0, min(int(target / 3), room - 1))
        out, last, start, good = [], 0, 0, True
        for k in range(1, count + 1):
            ideal = round(k * target)
            if k == count:
                cut = n
            else:
                low, high = max(last + 1, ideal - slack), min(ideal + slack, start + limit, n - 1)
                if low > high:
                    good = False
                    break
                i, j = bisect_left(at, low), bisect_right(at, high)
                cut = max(range(i, j), key=lambda x: (strength[x], -abs(at[x] - ideal)), default=None)
                cut = at[cut] if cut is not None else _plain(text, min(max(ideal, low), high), last)
            if cut - start > limit:
                good = False
                break
            out.append((start, cut, last - start))
            if k < count:
                first = max(last + 1, cut - overlap)
                i, j = bisect_left(at, first), bisect_left(at, cut)
                start = next((at[x] for x in range(i, j) if strength[x] >= 3), at[i] if i < j else cut)
                while _joined(text, start) and start < cut:
                    start += 1
                last = cut
        if good:
            return out
        count += 1


def _split(batches: Iterator[pd.DataFrame], limit: int, overlap: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(k, p, len(s), *x) for k, text in enumerate(batch["text"]) for s in [spans(text, limit, overlap)] for p, x in enumerate(s)]
        if rows:
            of, piece_no, n_pieces, start, end, shared = map(list, zip(*rows, strict=True))
            part = batch.drop(columns="text").iloc[of].reset_index(drop=True)
            texts = batch["text"].tolist()
            yield part.assign(piece_no=piece_no, n_pieces=n_pieces, start=start, end=end, shared=shared, text=[texts[k][a:b] for k, a, b in zip(of, start, end, strict=True)])


PIECE = "piece_no int, n_pieces int, start int, end int, shared int, text string"


def split_oversized(df: DataFrame, keep: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the texts of ``df`` that exceed ``limit`` characters, beside the columns ``keep``.

    Null texts and texts within the limit give no rows here; ``pieces`` adds them. Only oversized rows reach Python.
    """
    big = df.where(F.length("text") > limit).select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in big.schema if f.name != "text")
    return big.mapInPandas(lambda b: _split(b, limit, overlap), f"{schema}, {PIECE}")


def pieces(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """All chunks, oversized ones in pieces, with ``section_heading`` and ``chunk_index`` renumbered within the page.

    Repeated rows of an id count once: the one with the latest crawl_date, null dates last. Rows without
    an id are repeated only if source_url, chunk_index and text are the same too. A null text gives one piece without
    text. Null pages are one page of their own, null indexes come last. Renumbering adds up piece counts by blocks of
    the old index first, so no task sorts a whole page.
    """
    keep = ["id", "source_url", "section_heading", "chunk_index"]
    whole = df.select(*keep, "crawl_date", "text")
    latest = F.max_by(F.struct(*[c for c in keep if c != "id"], "text"), F.struct(F.coalesce("crawl_date", F.lit("")), F.coalesce("text", F.lit(""))))
    unnamed = [F.when(F.col("id").isNull(), x).alias(n) for n, x in (("_url", F.col("source_url")), ("_index", F.col("chunk_index")), ("_text", F.sha2("text", 256)))]
    rows = whole.groupBy("id", *unnamed).agg(latest.alias("x")).select("id", "_text", "x.*")
    small = rows.where(F.col("text").isNull() | (F.length("text") <= limit)).select(
        *keep, "_text", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(0).alias("shared"), "text"
    )
    out = small.unionByName(split_oversized(rows, [*keep, "_text"], limit, overlap))
    page, old = F.coalesce("source_url", F.lit("")), F.coalesce("chunk_index", F.lit(2**31 - 1))
    out = out.withColumns({"_page": page, "_block": F.floor(old / INDEX_BLOCK)})
    sums = out.groupBy("_page", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_page").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_page", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_page", "_block").orderBy(old, "id", "_text", "piece_no")
    out = out.withColumn("_rank", F.row_number().over(within)).join(sums, ["_page", "_block"])
    return out.select("id", "source_url", "section_heading", (F.col("_before") + F.col("_rank") - 1).cast("int").alias("chunk_index"), "piece_no", "n_pieces", "start", "end", "shared", "text")
