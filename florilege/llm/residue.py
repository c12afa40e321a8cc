"""Template residue, filler and error pages, by aligning the records of a template.

Lines with the same opening or ending are records of one template, what differs between them its slots. Templates are
judged by their records: a template that makes up the whole body of most texts it stands in, and whose pages were noted
as short or faulty far more often than others, is an error page, a notice or a stand-in text, and all its records are
residue, noted or not. Slots that still hold the variable's name are told by the syntax of templates, slots left blank by
their line. The words of filler text are learned too: they stand beside its best-known words and hardly anywhere else.
Page furniture is left aside, so that a page whose only content is a notice counts as whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm import codes
from florilege.llm.common import cut
from florilege.llm.maincontent import BLOCK, DIGITS, LEFT, NAME, RIGHT, _member, ends_of, line_key, with_furniture

_NAME = r"[\p{L}][\p{L}\p{N}_.\-]*"
# The syntax of slots in common template languages and forms.
SLOT = "|".join((
    rf"\{{\{{\s*{_NAME}[^{{}}]*\}}\}}", rf"[$#]\{{\s*{_NAME}\s*\}}", rf"\{{%+-?\s*{_NAME}[^{{}}%]*%+\}}", rf"\{{\$\s*{_NAME}\s*\}}",
    rf"\[\[\s*{_NAME}\s*\]\]", rf"@@\s*{_NAME}\s*@@", rf"\#\#\#\s?{_NAME}\s?\#\#\#", rf"%%\s*{_NAME}\s*%%", r"(?<![\p{L}\p{N}%])%[\p{L}][\p{L}_]+%(?![\p{L}\p{N}%])",
    r"(?<![\p{L}\p{N}_])__\p{L}[\p{L}\p{N}]*(?:_\p{L}[\p{L}\p{N}]*)*__(?![\p{L}\p{N}_])", rf"&lt;\s*{_NAME}\s*&gt;", rf"<!--\s*{_NAME}\s*-->", r"«\p{Ll}[\p{L}_]+»",
    r"<(?:bitte )?[\p{L} ]{1,40} (?:eintragen|einfügen|ergänzen|einsetzen)>", r"<(?:enter|insert) [\p{L} ]{1,40}>",
    r"\[(?:bitte |hier )*[\p{L} ]{1,40} (?:eintragen|einfügen|ergänzen|einsetzen)\]", r"\[(?:enter|insert|your) [\p{L} ]{1,40}\]", r"\[\p{L}[\p{L}_]*_(?:platzhalter|placeholder)\]",
))
#: A slot left blank after its label.
BLANK = r"^[\p{L}][\p{L} ]{1,40}: ?(?:_{3,}|\.{4,}|…{2,})$"
#: One of these stands in whatever SLOT matches, of these characters too, and one of those at the end of what BLANK matches.
SIGNS, SIGN, ENDS = re.compile(r"\{[{$%]|[$#]\{|\[[^\d\]]|@@|###|%[^\d\s]|__|&lt;|<[^\d/>]|«", re.IGNORECASE), re.compile(r"[{\[@#%_&<«]"), ("___", "....", "……")
#: The best-known words of filler text.
SEEDS = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua".split())
#: The two that stand in no other text.
SURE = frozenset(("lorem", "ipsum"))
#: Least share of filler words in a line, and its least words.
FILLER_SHARE, FILLER_WORDS = 0.7, 5
#: Lines in which a word must stand to be learned as filler, and least share of them that hold a sure word.
LEARN_LINES, LEARN_SHARE = 3, 0.3
#: Noted pages of a template, and least share of pages on which it makes up the body.
NOTED_PAGES, WHOLE_SHARE = 3, 0.7
#: Least evidence, in nats, that a template's pages are noted more often than pages are: e to the minus this bounds the chance.
EVIDENCE = 8.0
#: Most lines of a body that one record makes up.
BODY_LINES = 3
# Beginnings of the reasons by which an earlier run noted short and faulty pages.
NOTES = r"^(?:fehlerseitenmuster|zu_wenig_text|viele_bildplatzhalter)"
#: Least letters of a word.
WORD_LETTERS = 3
CODE = re.compile(r"`[^`]*`")
HASH = re.compile(r"^\s*#+\s+")


_SLOT, _BLANK = regex.compile(f"(?i:{SLOT})"), regex.compile(BLANK)


def template_keys(line: str) -> list[int]:
    """Hashes of a line as a record: with the slot after its opening or before its ending left out, and whole if it's short."""
    return _record_keys(DIGITS.sub("0", line.lower()), line_key(line))


def _record_keys(low: str, whole: str) -> list[int]:
    """The same of a line in lower case that has digit runs as 0, and its line key."""
    keys = ends_of((HASH.sub("", low) if "#" in low else low).lstrip(LEFT).rstrip(RIGHT))
    if len(keys) < 4 and NAME.search(whole):
        keys.append(f"= {whole}")
    return [xxhash.xxh64_intdigest(k) - (1 << 63) for k in keys]


def syntax_of(line: str) -> str | None:
    """field or blank for a line with a slot that holds a variable's name or nothing, else None."""
    if SIGN.search(line) and SIGNS.search(line) and _SLOT.search(CODE.sub("`", " ".join(line.split()))):
        return "field"
    if line.rstrip().endswith(ENDS) and _BLANK.search(HASH.sub("", " ".join(line.split()))):
        return "blank"
    return None


def may_have_slots(text: str) -> bool:
    """Whether ``syntax_of`` may find something in a line of the text; cheaper than to ask each."""
    return any(x in text for x in ENDS) or (SIGN.search(text) is not None and SIGNS.search(text) is not None)


def body_lines(text: str, gone: list[int]) -> tuple[list[tuple[int, str]], bool]:
    """The filled lines of a text beside furniture, and whether there are so few that one record makes up the body."""
    aside = set(gone)
    lines = [(k, x) for k, x in enumerate(text.split("\n")) if k not in aside and x.strip()]
    return lines, sum(1 for _, x in lines if "#" not in x or not HASH.match(x)) <= BODY_LINES


def _noted(batches: Iterator[pa.RecordBatch], noted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(key, page) of the records that make up the body of a page, of the pages noted if they are given."""
    for batch in batches:
        keys, pages = [], []
        if noted is not None:
            batch = batch.filter(pa.array(_member(batch.column("page").to_numpy(zero_copy_only=False), noted)))
        for page, text, gone in zip(*(batch.column(c).to_pylist() for c in ("page", "text", "gone")), strict=True):
            lines, alone = body_lines(text, gone)
            for _, line in lines if alone else ():
                ks = template_keys(line)
                keys += ks
                pages += [page] * len(ks)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(pages, pa.int64())], names=["key", "page"])


def _lowered(texts: list[str], gone: list[list[int]]) -> Iterator[tuple[str, list[int], list[str], list[str], list[str]]]:
    """(text, gone, low, keys, words) of every text: its lines in lower case with digit runs as 0, their keys and their words."""
    for part in codes.blocks(texts):
        (low, keys, words), at = codes.lines_keys_and_words("\n".join(texts[part])), 0
        for text, aside in zip(texts[part], gone[part], strict=True):
            own = slice(at, at := at + text.count("\n") + 1)
            yield text, aside, low[own], keys[own], words[own]


def _records(batches: Iterator[pa.RecordBatch], among: np.ndarray, words: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """(rid, page, line_no, key, whole, kind, words, n, sure).

    One row for each record whose template may be residue (key), each slot or blank and each line that may be filler (kind and
    the words asked for in it, with how many words it has), and the counts of lines of the words asked for (words, n, sure).
    """
    either = words | SEEDS
    n, sure = Counter(), Counter()
    for batch in batches:
        flat, of, no, alone, marks = [], [], [], [], []
        for k, (text, gone, low, whole, every_line) in enumerate(_lowered(batch.column("text").to_pylist(), batch.column("gone").to_pylist())):
            lines, one = body_lines(text, gone)
            alone.append(int(one))
            signed = may_have_slots(text)
            for at, line in lines:
                ks = _record_keys(low[at], whole[at])
                flat += ks
                of += [k] * len(ks)
                no += [at] * len(ks)
                if signed and (kind := syntax_of(line)):
                    marks.append((k, at, kind, None, None))
                every = every_line[at].split()
                if not either.isdisjoint(every):
                    every = [w for w in every if len(w) >= WORD_LETTERS]
                    here = words.intersection(every)
                    n.update(here)
                    if not SURE.isdisjoint(every):
                        sure.update(here)
                    found = [w for w in every if w in either]
                    if len(every) >= FILLER_WORDS and len(found) >= FILLER_SHARE * len(every):
                        marks.append((k, at, "filler", found, len(every)))
        hit = np.array(flat, np.int64)
        at = np.flatnonzero(_member(hit, among))
        rows = np.r_[np.array(of, np.int64)[at], np.array([m[0] for m in marks], np.int64)]
        if len(rows):
            m = len(marks)
            cols = [batch.column(c).take(pa.array(rows)) for c in ("rid", "page")]
            cols.append(pa.array(np.r_[np.array(no, np.int64)[at], np.array([x[1] for x in marks], np.int64)].astype(np.int32)))
            cols.append(pa.concat_arrays([pa.array(hit[at]), pa.nulls(m, pa.int64())]))
            cols.append(pa.array(np.array(alone, np.int32)[rows]))
            cols.append(pa.concat_arrays([pa.nulls(len(at), pa.string()), pa.array([x[2] for x in marks], pa.string())]))
            cols.append(pa.concat_arrays([pa.nulls(len(at), pa.list_(pa.string())), pa.array([x[3] for x in marks], pa.list_(pa.string()))]))
            cols += [pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array([x[4] for x in marks], pa.int64())]), pa.nulls(len(rows), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=RECORD)
    if n:
        m = len(n)
        none = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string())]
        yield pa.RecordBatch.from_arrays([*none, pa.array([[w] for w in n]), pa.array(list(n.values()), pa.int64()), pa.array([sure[w] for w in n], pa.int64())], names=RECORD)


RECORD = ["rid", "page", "line_no", "key", "whole", "kind", "words", "n", "sure"]
RECORD_TYPES = "rid long, page long, line_no int, key long, whole int, kind string, words array<string>, n long, sure long"


def filler_candidates(rows: DataFrame) -> frozenset[str]:
    """Words that stand in LEARN_LINES lines with a sure word of filler text, which only texts flagged ``sure`` hold."""
    lines = rows.where("sure").where(F.lower("text").rlike("lorem|ipsum")).select(F.explode(F.split(F.lower("text"), "\n")).alias("line")).where(F.col("line").rlike(r"\b(?:lorem|ipsum)\b"))
    words = lines.select(F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\p{L}{3,}"), 0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEARN_LINES).select("word")
    words = cut(words)
    if words.count() > 1_000_000:
        raise ValueError("more than a million words beside filler words; filter the texts first")
    return frozenset(r["word"] for r in words.collect())


def noted_pages(reasons: DataFrame, page: str = "source_url") -> DataFrame:
    """(page): hashes of the pages for which short or faulty text was noted; null reasons note nothing."""
    return reasons.where(F.exists(F.coalesce("reasons", F.array().cast("array<string>")), lambda r: r.rlike(NOTES)) & F.col(page).isNotNull()).select(F.xxhash64(page).alias("page")).distinct()


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sure = pc.match_substring_regex(batch.column("text"), "|".join(sorted(SURE)), ignore_case=True)
        yield pa.RecordBatch.from_arrays([*batch.columns, sure], names=[*batch.schema.names, "sure"])


def with_bodies(df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep.., page, text, gone, sure, rid) of every row with text, written once: texts with their furniture's lines, and whether a sure word may be in them."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    flagged = _flagged, f"{schema}{', ' if keep else ''}_page long, text string, gone array<int>, sure boolean"
    rows = with_furniture(df.select(*keep, F.xxhash64("source_url").alias("_page"), "source_url", "text"), [*keep, "_page"], then=flagged)
    return cut(rows.withColumnRenamed("_page", "page").withColumn("rid", F.monotonically_increasing_id()))


def residue_lines(rows: DataFrame, noted: DataFrame) -> DataFrame:
    """(rid, line_no, kind) of the residue in (rid, page, text, gone, sure), given the pages noted; all texts are counted.

    Templates are judged further only if they make up the body of NOTED_PAGES noted pages; as broadcast they are at most BLOCK (32 MB).
    """
    noted, narrow = cut(noted), rows.select("page", "text", "gone")
    if noted.count() <= BLOCK:
        # Few enough to be known to every task: the texts stay where they are.
        pages = rows.sparkSession.sparkContext.broadcast(np.sort(np.array([r["page"] for r in noted.collect()], np.int64)))
        first = narrow.mapInArrow(lambda b: _noted(b, pages.value), "key long, page long").distinct()
    else:
        first = narrow.join(noted, "page", "left_semi").mapInArrow(lambda b: _noted(b, None), "key long, page long").distinct()
    first = cut(first.groupBy("key").agg(F.count(F.lit(1)).alias("noted")).where(F.col("noted") >= NOTED_PAGES))
    if first.count() > BLOCK:
        raise ValueError(f"more than {BLOCK} templates on noted pages; run the operator by groups of sites")
    among = np.sort(np.array([r["key"] for r in first.select("key").collect()], np.int64))
    shared = rows.sparkSession.sparkContext.broadcast((among, filler_candidates(rows)))
    found = cut(rows.select("rid", "page", "text", "gone").mapInArrow(lambda b: _records(b, *shared.value), RECORD_TYPES))
    every = found.where("key IS NOT NULL").groupBy("key", "page").agg(F.max("whole").alias("whole"))
    every = every.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("whole")).join(first, "key")
    total = rows.select("page").distinct().join(noted.withColumn("bad", F.lit(1)), "page", "left").agg((F.count("bad") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("rate"))
    p, base = F.least(F.col("noted") / F.col("n"), F.lit(1.0)), F.least(F.greatest("rate", F.lit(1e-9)), F.lit(1 - 1e-9))
    evidence = F.col("n") * (p * F.log(p / base) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - base))).otherwise(F.lit(0.0)))
    every = every.crossJoin(F.broadcast(total))  # one row
    bad = every.where((p > base) & (evidence >= EVIDENCE) & (F.col("whole") >= F.col("n") * WHOLE_SHARE)).select("key")
    notices = found.where("key IS NOT NULL").join(bad, "key", "left_semi").select("rid", "line_no", F.lit("notice").alias("kind"))
    words = found.where("kind IS NULL AND key IS NULL").select(F.col("words")[0].alias("word"), "n", "sure").groupBy("word").agg(F.sum("n").alias("n"), F.sum("sure").alias("sure"))
    words = words.where(F.col("sure") >= F.col("n") * LEARN_SHARE).select("word").unionByName(rows.sparkSession.createDataFrame([(w,) for w in sorted(SEEDS)], "word string")).distinct()
    lines = found.where("kind = 'filler'").select("rid", "line_no", "n", F.explode("words").alias("word")).join(words, "word", "left_semi")
    filler = lines.groupBy("rid", "line_no").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).where(F.col("k") >= F.col("n") * FILLER_SHARE).select("rid", "line_no", F.lit("filler").alias("kind"))
    syntax = found.where("kind IN ('field', 'blank')").select("rid", "line_no", "kind")
    return notices.unionByName(filler).unionByName(syntax).distinct()


def residue(df: DataFrame, keep: list[str], reasons: DataFrame) -> DataFrame:
    """(keep.., line_no, kind): the lines of ``df`` (source_url, text) that are residue: field, blank, filler or notice.

    ``reasons`` (source_url, reasons) are the notes of an earlier run; without any, only fields, blanks and filler are
    found. Null texts have none, repeated rows count once.
    """
    rows = with_bodies(df, keep)
    # The residue is a small part of the lines; only keys are joined, never texts.
    return rows.select("rid", *keep).join(residue_lines(rows, noted_pages(reasons)), "rid").select(*keep, "line_no", "kind").distinct()


def marked(df: DataFrame, reasons: DataFrame) -> DataFrame:
    """(id, kinds, lines, whole): every id with residue, its kinds, the residue's lines, and whether nothing else is there."""
    rows = residue(df.select("id", "source_url", "text"), ["id"], reasons).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"), F.countDistinct("line_no").alias("lines"))
    full = df.groupBy("id").agg(F.max(F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""))).alias("n"))
    return rows.join(full, "id").select("id", "kinds", "lines", (F.col("lines") >= F.col("n")).alias("whole"))


def without_residue(df: DataFrame, reasons: DataFrame) -> DataFrame:
    """The rows of ``df`` whose id has no residue; rows without id or text stay."""
    bad = residue(df.select("id", "source_url", "text"), ["id"], reasons).select("id").distinct()
    return df.join(bad, "id", "left_anti")
