"""Main content of web pages, by removing the template of their site.

A text is read as a tree: sections under their headings, tables, and lines as leaves. Every subtree is hashed over
its letters and digits, whatever its case and decoration; digit runs of a single line count as 0. Hashes are counted by distinct page for each
host; subtrees on many pages of their host are template and go, wherever they stand. A heading goes only with its
whole section and a row only with its whole table, so headings and rows that recur over different content stay.

Lines of the template that differ from page to page have slots. Subtrees with slots are hashed with the slot left out
by position: what opens or closes a line, or its delimiters alone. Such a hash is template if lines with it stand
outside of the content, beyond template lines, on several pages and on a certain share of the pages on which they stand
at an edge. The search repeats from the edges inward. Running titles of one long document are lines at the edges
of its chunks that recur but for a number that is another each time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.llm import codes
from florilege.llm.common import cut, host_of, spread

#: Pages, and share of the host's pages, on which a subtree must recur.
EXACT_PAGES, EXACT_SHARE = 5, 0.03
#: Pages on which lines with one slot hash must stand beyond template lines, and their least share of the pages with such lines at an edge.
OUTSIDE_PAGES, OUTSIDE_SHARE = 3, 0.04
#: Times that slot hashes are learned; every time the edges have moved inward by what was learned before.
ROUNDS = 2
#: Chunks of one document that must share a running title, least share of different numbers in it, and its least words.
RUNNING_CHUNKS, RUNNING_SHARE, RUNNING_WORDS = 5, 0.8, 3
#: Most hashes that are broadcast, of slots and of what recurs (32 MB each).
BLOCK = 4_000_000
#: Columns by which the lines that recur are told.
FOUND = ("eh", "ef", "et", "running")

HEADING, ROW = re.compile(r"\s*(#{1,6})\s"), re.compile(r"\s*\|")
DIGITS, OTHER = re.compile(r"\d+"), re.compile(r"[\W_]+")
NAME = re.compile(r"[^\W\d_]{3}")
WORDS = re.compile(r"\w[\w\s]*")
#: Decoration and marks before and after a line.
LEFT, RIGHT = " \t\r\xa0*_>+•–-", " \t\r\xa0*_"
#: Most slot hashes of a line: the 1 to 3 pieces that open it, the 2 or 3 that close it, and its delimiters.
SLOTS = 6
#: Lines whose slot hashes a task remembers at a time, and the longest of them.
REMEMBERED, SHORT = 50_000, 300


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\n".join(parts)) - (1 << 63)


def line_key(line: str) -> str:
    """Letters and digits of a line in lower case, digit runs as 0, anything else as one blank."""
    return OTHER.sub(" ", DIGITS.sub("0", line.lower())).strip()


def slot_keys(line: str, shape: bool = True) -> list[str]:
    """The line with its slots left out, at most SLOTS strings, none where too little is left to tell it by."""
    one = line.lstrip(LEFT).rstrip(RIGHT)
    out = ends_of(DIGITS.sub("0", one.lower()))
    if shape and one and not (one[0].isalnum() and (one[-1].isalnum() or one[-1] in ".!?:;")) and NAME.search(one):
        out.append(f"* {WORDS.sub('*', one)}")
    return out


def ends_of(one: str) -> list[str]:
    """What opens and what closes a line that is stripped, in lower case and has digit runs as 0."""
    first = one.split(None, 3)
    n, out = len(first), []
    if n > 1:
        a, b = first[:2]
        if not a[-1].isalnum() and NAME.search(a):
            out.append(f"1 {a}")
        if n > 2:
            x, y, z = (one.rsplit(None, 3) if n > 3 else first)[-3:]
            two, end = NAME.search(a) or NAME.search(b), NAME.search(y) or NAME.search(z)
            if two:
                out.append(f"2 {a} {b}")
            if end:
                out.append(f"-2 {y} {z}")
            if n > 3:
                if two or NAME.search(first[2]):
                    out.append(f"3 {a} {b} {first[2]}")
                if end or NAME.search(x):
                    out.append(f"-3 {x} {y} {z}")
    return out


def subtrees(lines: list[str], keys: list[str], plain: list[str] | None) -> tuple[list[int], list[int], list[tuple[int, int, str]]]:
    """(line numbers, what, subtrees) of a text's filled lines: ``what`` is 1 for a heading, 2 for a row, else 0.

    ``keys`` are the line keys, ``plain`` those with digits as they are, None for a text without headings and rows. A
    subtree is its first and last filled line and its key.
    """
    no, what, heads, out = [], [], [], []
    for k, key in enumerate(keys):
        if not key and (not (line := lines[k]) or line.isspace()):
            continue
        w = kind(lines[k]) if plain else 0
        if w == 0:
            if NAME.search(key):
                out.append((len(no), len(no), key))
        elif w == 1:
            heads.append((len(no), len(HEADING.match(lines[k]).group(1))))
        no.append(k)
        what.append(w)
    if not plain:
        return no, what, out
    inner = lambda i, j: "\n".join([plain[k] for k in no[i:j]])
    open_ = []
    for i, level in [*heads, (len(no), 0)]:
        while open_ and open_[-1][1] >= level:
            j, _ = open_.pop()
            if i - j > 1:
                out.append((j, i - 1, "# " + inner(j, i)))
        open_.append((i, level))
    i = what.index(2) if 2 in what else len(no)
    while i < len(no):
        j = i
        while j < len(no) and what[j] == 2:
            j += 1
        if j - i > 1:
            out.append((i, j - 1, "| " + inner(i, j)))
        i = max(j, i + 1)
    return no, what, out


def kind(line: str) -> int:
    """1 for a heading, 2 for a row of a table, else 0."""
    start = line.lstrip()[:1]
    return 2 if start == "|" else 1 if start == "#" and HEADING.match(line) else 0


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    for whole in batches:
        every = whole.column("text").to_pylist()
        for part in codes.blocks(every):
            batch, texts = whole.slice(part.start, part.stop - part.start), every[part]
            cols: list[list] = [[] for _ in range(4)]
            keys = codes.line_keys("\n".join(texts))
            marked = ["#" in t or "|" in t for t in texts]
            plain = codes.line_keys("\n".join(t for t, x in zip(texts, marked, strict=True) if x), digits=False)
            at = plain_at = 0
            for text, host, page, x in zip(texts, *(batch.column(c).to_pylist() for c in ("host", "page")), marked, strict=True):
                lines = text.split("\n")
                own = keys[at : (at := at + len(lines))]
                no, what, trees = subtrees(lines, own, plain[plain_at : (plain_at := plain_at + len(lines))] if x else None)
                running = []
                for i in dict.fromkeys((0, len(no) - 1)) if no else ():
                    if what[i] == 0 and (n := DIGITS.findall(lines[no[i]])) and len(NAME.findall(key := own[no[i]])) >= RUNNING_WORDS:
                        running += (i, _hash(str(page), key), _hash(*n))
                head = f"{host}\n"
                row = ([xxhash.xxh64_intdigest(head + t[2]) - (1 << 63) for t in trees], [t[0] for t in trees], [t[1] for t in trees], running)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kept = batch.drop_columns(["host"])
            kinds = (longs, ints, ints, longs)
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*kept.schema.names, "eh", "ef", "et", "running"])


def site_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def trees(rows: DataFrame) -> DataFrame:
    """``rows`` (host, page, text, ..) without host, and their eh, ef, et, running: hash, first and last line of every subtree."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("host").schema]
    return spread(rows).mapInArrow(_trees, ", ".join([*kinds, "eh array<long>, ef array<int>, et array<int>, running array<long>"]))


def _recurring(tree: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """(key): hashes of subtrees that recur on many pages of their host."""
    # Distinct pages are counted in two steps, so no key's pages are ever in one task.
    once = tree.select(F.explode("eh").alias("key"), "group", "page").distinct()
    counts = once.groupBy("key", "group").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    hosts = tree.select("group", "page").distinct().groupBy("group").agg(F.count(F.lit(1)).alias("all"))
    return counts.join(hosts, "group").where(F.col("pages") >= F.col("all") * min_share).select("key")


def _edges(tree: DataFrame) -> DataFrame:
    """(ta, tb, ord, key, number) of the lines that may be running titles."""
    edge = tree.where(F.size("running") > 0).select("ta", "tb", F.explode(F.sequence(F.lit(0), F.size("running") - 1, F.lit(3))).alias("i"), "running")
    return edge.select("ta", "tb", *[F.expr(f"running[i + {k}]").alias(n) for k, n in enumerate(("ord", "key", "number"))])


def _running(tree: DataFrame) -> DataFrame:
    """(key): running titles of long documents."""
    once = _edges(tree).select("key", "ta", "number").distinct()
    numbers = once.select("key", "number").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("numbers"))
    texts = once.select("key", "ta").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= RUNNING_CHUNKS)
    return texts.join(numbers, "key").where(F.col("numbers") >= F.col("texts") * RUNNING_SHARE).select("key")


def _keys(df: DataFrame) -> np.ndarray:
    """The hashes of ``df`` (key), sorted."""
    return np.sort(df.toArrow()["key"].to_numpy())


def _joined(tree: DataFrame, often: DataFrame, titles: DataFrame) -> DataFrame:
    """``tree`` with the filled lines of the subtrees and running titles given as ``exact``, for more hashes than are broadcast."""
    found = tree.select("ta", "tb", F.explode(F.arrays_zip("eh", "ef", "et")).alias("x")).select("ta", "tb", F.col("x.eh").alias("key"), "x.ef", "x.et")
    lines = found.join(often, "key", "left_semi").select("ta", "tb", F.explode(F.sequence("ef", "et")).alias("ord"))
    lines = lines.unionByName(_edges(tree).join(titles, "key", "left_semi").select("ta", "tb", F.col("ord").cast("int").alias("ord")))
    lines = lines.groupBy("ta", "tb").agg(F.collect_set("ord").alias("exact"))  # at most as many as a text has lines
    return tree.join(lines, ["ta", "tb"], "left")


def _exact(batch: pa.RecordBatch, often: np.ndarray, titles: np.ndarray) -> list[Iterable[int]]:
    """The filled lines of each text that recur, or are running titles."""
    if "exact" in batch.schema.names:
        return [x or () for x in batch.column("exact").to_pylist()]
    found: list[Iterable[int]] = [()] * batch.num_rows
    for c, known, width in (("eh", often, 1), ("running", titles, 3)):
        lists = batch.column(c)
        starts = lists.offsets.to_numpy()
        values = lists.values.to_numpy()[starts[0] : starts[-1]]
        hit = np.flatnonzero(_member(values[width // 2 :: width], known))
        of = (np.searchsorted(starts - starts[0], hit * width, side="right") - 1).tolist()
        if width == 1:
            spans = [batch.column(x).values.to_numpy()[starts[0] + hit].tolist() for x in ("ef", "et")]
        else:
            spans = [values[hit * width].tolist()] * 2
        for k, a, b in zip(of, *spans, strict=True):
            found[k] = found[k] or set()
            found[k].update(range(a, b + 1))
    return found


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted ones."""
    if not len(among):
        return np.zeros(values.shape, bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def edges(flag: list[bool]) -> tuple[int, int]:
    """The first line from the top, and from the bottom the line after the last, that isn't flagged."""
    a, b = 0, len(flag)
    while a < b and flag[a]:
        a += 1
    while b > a and flag[b - 1]:
        b -= 1
    return a, b


class Among:
    """A sorted array of hashes that is asked for single ones; most that aren't in it are told by a table of their last bits."""

    def __init__(self, known: np.ndarray) -> None:
        self.known, self.mask = known, (1 << max(12, int(len(known)).bit_length() + 3)) - 1
        there = np.zeros(self.mask + 1, bool)
        there[known & self.mask] = True
        self.there = there.tobytes()

    def __len__(self) -> int:
        return len(self.known)

    def any(self, keys: tuple[int, ...]) -> bool:
        for k in keys:
            if self.there[k & self.mask] and self.known[min(int(np.searchsorted(self.known, k)), len(self.known) - 1)] == k:
                return True
        return False


def _slots(site: str, line: str) -> tuple[int, ...]:
    return tuple([_hash(site, x) for x in slot_keys(line)])


_slots_again = lru_cache(maxsize=REMEMBERED)(_slots)


class Page:
    """A text's filled lines with flags; slot hashes are made only of the lines that are asked for."""

    def __init__(self, text: str, site: str, exact: Iterable[int], known: Among) -> None:
        self.lines = text.split("\n")
        self.no = [k for k, x in enumerate(self.lines) if x and not x.isspace()]
        self.site, self.marks, n = site, ("#" in text, "|" in text), len(self.no)
        self.flag = [False] * n
        for i in exact:
            self.flag[i] = True
        a, b = edges(self.flag)
        if len(known):
            # Slot lines are flagged as far as they are joined to an edge.
            while a < b and (self.flag[a] or known.any(self.slots(a))):
                self.flag[a] = True
                a += 1
            while b > a and (self.flag[b - 1] or known.any(self.slots(b - 1))):
                self.flag[b - 1] = True
                b -= 1
        self.a, self.b = a, b

    def what(self, i: int) -> int:
        return kind(self.lines[self.no[i]]) if any(self.marks) else 0

    def slots(self, i: int) -> tuple[int, ...]:
        line = self.lines[self.no[i]]
        return () if self.what(i) else _slots_again(self.site, line) if len(line) <= SHORT else _slots(self.site, line)

    def outside(self) -> dict[int, bool]:
        """Whether it stands outside of the content, for the lines at an edge and those just beyond flagged lines.

        A line stands outside if the line on its inner side is flagged, content lies further in, and no heading opens
        a section between it and that edge of the text.
        """
        flag, n, a, b = self.flag, len(self.flag), self.a, self.b
        found = {i: False for i in ((a, b - 1) if a < b else ())}
        if not any(flag):
            return found
        heads = [i for i in range(n) if not flag[i] and self.what(i) == 1] if self.marks[0] else []
        first, last = (heads[0], heads[-1]) if heads else (n, -1)
        inner = n  # the nearest line further down that isn't flagged
        for i in range(n - 1, -1, -1):
            if not flag[i]:
                if i + 1 < inner < n and first > i:
                    found[i] = True
                inner = i
        inner = -1
        for i in range(n):
            if not flag[i]:
                if -1 < inner < i - 1 and last < i:
                    found[i] = True
                inner = i
        return found


#: Sorted hashes of subtrees that recur, of running titles, and of slots.
Known = tuple[np.ndarray, np.ndarray, np.ndarray]


def _texts(batch: pa.RecordBatch, known: Known, among: Among) -> Iterator[Page]:
    exact = _exact(batch, *known[:2])
    for text, site, lines in zip(*(batch.column(c).to_pylist() for c in ("text", "site")), exact, strict=True):
        yield Page(text, site, lines, among)


def _evidence(batches: Iterator[pa.RecordBatch], known: Known) -> Iterator[pa.RecordBatch]:
    among = Among(known[2])
    for batch in batches:
        keys, pages, out = [], [], []
        for page, text in zip(batch.column("page").to_pylist(), _texts(batch, known, among), strict=True):
            for i, x in text.outside().items():
                ks = text.slots(i)
                keys += ks
                pages += [page] * len(ks)
                out += [int(x)] * len(ks)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(pages, pa.int64()), pa.array(out, pa.int32())], names=["key", "page", "out"])


def _marked(batches: Iterator[pa.RecordBatch], known: Known) -> Iterator[pa.RecordBatch]:
    among = Among(known[2])
    for batch in batches:
        gone = [[n for n, f in zip(text.no, text.flag, strict=True) if f] for text in _texts(batch, known, among)]
        kept = batch.drop_columns([c for c in batch.schema.names if c in (*FOUND, "exact", "site", "page")])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(gone, pa.list_(pa.int32()))], names=[*kept.schema.names, "gone"])


def slot_hashes(rows: DataFrame, known: Known, pages: int, share: float) -> DataFrame:
    """(key): hashes of lines with slots that stand outside of the content, given those known before."""
    shared = rows.sparkSession.sparkContext.broadcast(known)
    found = rows.mapInArrow(lambda b: _evidence(b, shared.value), "key long, page long, out int")
    once = found.groupBy("key", "page").agg(F.max("out").alias("out"))
    counts = once.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("out").alias("out"))
    return counts.where((F.col("out") >= pages) & (F.col("out") >= F.col("n") * share)).select("key")


def with_furniture(df: DataFrame, keep: list[str], exact_pages: int = EXACT_PAGES, exact_share: float = EXACT_SHARE, rounds: int = ROUNDS, then: tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str] | None = None) -> DataFrame:
    """(keep.., text, gone): the rows of ``df`` (source_url, text) that have text, with the numbers of their furniture lines.

    Rows without host are one host; repeated rows are repeated. The hashes of what recurs are broadcast up to BLOCK of them, more are
    joined to their texts. The slot hashes learned are broadcast, at most BLOCK of
    them; if there are more, the operator raises an error rather than dropping some. With ``then``, a function of the batches and the
    schema of what it yields, that is returned, made in the same pass.
    """
    host = F.coalesce(host_of(F.col("source_url")), F.lit(""))
    rows = df.where("text IS NOT NULL").select(*keep, host.alias("host"), F.xxhash64(host).alias("group"), site_of(host).alias("site"), F.xxhash64("source_url").alias("page"), F.xxhash64("source_url", "text").alias("ta"), F.xxhash64("text", F.lit(1), "source_url").alias("tb"), "text")
    # Texts are written with their subtrees and stay where they are: no text is shuffled to learn which of its lines recur.
    tree = cut(trees(rows))
    often, titles = cut(_recurring(tree, exact_pages, exact_share)), cut(_running(tree))
    if often.count() + titles.count() <= BLOCK:
        rows, exact, known = tree, FOUND, (_keys(often), _keys(titles), np.empty(0, np.int64))
    else:
        rows, exact, known = cut(_joined(tree, often, titles).select(*keep, "site", "page", "text", "exact")), ("exact",), (np.empty(0, np.int64),) * 3
    for _ in range(rounds):
        new = cut(slot_hashes(rows.select("page", "site", "text", *exact), known, OUTSIDE_PAGES, OUTSIDE_SHARE))
        if new.count() + len(known[2]) > BLOCK:
            raise ValueError(f"more than {BLOCK} slot hashes; run the operator by groups of sites")
        more = np.setdiff1d(_keys(new), known[2])
        if not len(more):
            break
        known = *known[:2], np.union1d(known[2], more)
    shared, rows = df.sparkSession.sparkContext.broadcast(known), rows.select(*keep, "site", "page", "text", *exact)
    if then:
        return rows.mapInArrow(lambda b: then[0](_marked(b, shared.value)), then[1])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(lambda b: _marked(b, shared.value), f"{schema}{', ' if keep else ''}text string, gone array<int>")


def furniture(df: DataFrame, keep: list[str], **options) -> DataFrame:
    """(keep.., line_no): the lines of page furniture. Rows without text have none; repeated rows count once."""
    return with_furniture(df, keep, **options).select(*keep, F.explode("gone").alias("line_no")).distinct()


def main_content(df: DataFrame) -> DataFrame:
    """(id, source_url, text, removed): every distinct chunk without page furniture; blank runs become one blank line.

    A chunk without text stays null.
    """
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("gone", i))
    text = F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n(?:[ \t]*\n){2,}", "\n\n"), r"(?U)^\s+|\s+$", "")
    url = df.select("id", F.col("source_url").alias("url"), "source_url", "text")
    full = with_furniture(url, ["id", "url"]).select("id", F.col("url").alias("source_url"), text.alias("text"), F.size("gone").alias("removed"))
    return full.unionByName(df.where("text IS NULL").select("id", "source_url", "text", F.lit(0).alias("removed"))).distinct()
