"""Answers and turns: clean-up, routing, memory and prompts, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions import text as T

# Headings and markers of answers and follow-up questions.
SOURCE_HEADING = r"(?im)^\s*(?:#{1,6}\s*)?(?:\*\*)?quellen?(?:\*\*)?\s*:?\s*(?:\*\*)?\s*$"
AFTER_SOURCE = r"(?im)^\s*(?:#{1,6}\s*)?(?:\*\*)?(?:hinweise?|antwort|zusammenfassung)(?:\*\*)?\s*:"
LINK_MARKERS = ("link geht nicht", "link funktioniert nicht", "der link", "seite geht nicht", "nicht erreichbar", "toter link", "kaputter link", "fehler 404", "erneut")
SOURCE_MARKERS = ("quelle", "quellen", "welche meinst du", "welchen meinst du", "welches meinst du")


def without_thoughts(text: Column) -> Column:
    """An answer without the passages between think tags, the last of which may be open."""
    return T.strip(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def collapse_paragraphs(text: Column) -> Column:
    """Paragraphs without those that repeat the one before, whatever their case and white space."""
    parts = F.transform(F.split(T.strip(text), r"\n{2,}"), lambda p: F.struct(T.strip(p).alias("p"), F.lower(T.squeeze(p)).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit("").alias("last"))
    step = lambda acc, x: F.struct(F.when((x["n"] != "") & (x["n"] == acc["last"]), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x["p"]))).alias("kept"), x["n"].alias("last"))
    return F.array_join(F.aggregate(parts, start, step, lambda acc: acc["kept"]), "\n\n")


def clean_answer(text: Column) -> Column:
    """An answer up to the end of its first block of sources, repeated paragraphs collapsed; null counts as empty."""
    one = T.strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"))
    # Split at the source headings: the first block stays, and of what follows only the part before a new section.
    marked = F.regexp_replace(one, SOURCE_HEADING, "\u0001$0")
    parts = F.split(marked, "\u0001")
    head, first = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    sources = F.get(F.split(F.regexp_replace(F.coalesce(first, F.lit("")), AFTER_SOURCE, "\u0002$0"), "\u0002"), F.lit(0))
    cut = F.when(F.size(parts) > 1, T.strip(F.concat(head, sources))).otherwise(one)
    return T.strip(collapse_paragraphs(cut))


def route(question: Column, has_last: Column) -> Column:
    """Mode of a follow-up about the last turn: followup_link, followup_source, or null for a new question."""
    low = F.lower(F.coalesce(question, F.lit("")))
    return F.when(~has_last, None).when(T.contains_any(low, LINK_MARKERS), "followup_link").when(T.contains_any(low, SOURCE_MARKERS), "followup_source")


def memory(turns: DataFrame, conversation: str, turn: str, value: str, size: int = 5) -> DataFrame:
    """``turns`` with ``memory``, the last ``size`` values joined by ``|``, and ``previous``, the value before."""
    order = Window.partitionBy(conversation).orderBy(turn)
    return turns.withColumns({"memory": F.array_join(F.collect_list(value).over(order.rowsBetween(1 - size, 0)), "|"), "previous": F.lag(value).over(order)})


def context_blocks(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, context): the hits of each question as one text in rank order, with rules between; k hits a question."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.concat_ws(" – ", "title", F.nullif("section_heading", F.lit(""))), F.lit("\n"), F.coalesce("source_url", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    rows = hits.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"))
    return rows.select(query, F.array_join(F.transform("x", lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def stale(dates: Column, as_of: Column, days: int = 180) -> Column:
    """Whether the oldest valid date of an array is more than ``days`` old."""
    return F.coalesce(F.date_diff(as_of, F.array_min(F.transform(dates, lambda d: d.try_cast("date")))) > days, F.lit(False))


def json_object(text: Column) -> Column:
    """The JSON object in an untrusted reply as text: the whole, a fenced block, or between the outer braces; else null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    good = lambda c: F.when((c.startswith("{")) & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(good(F.trim(text)), good(fenced), good(braces))
