"""Statistics of page texts, and prose told from lists, tables and debris.

Three signals of layout decide the kind of a run of lines, together with ratios of words, symbols and punctuation. Rows
of a table have delimiters that stand under those of rows near them: at the same columns, or as many of them where they
are written out. Entries of a list begin alike with a period: the autocorrelation of indents and marks over one to
four lines is high. Entries without marks must have lengths that repeat: the likeness of line lengths at the best
lag. Lines that hold sentences by their words and punctuation are prose whatever their layout, and lines of few
word-like pieces or many symbols are debris. Page furniture and residue are left aside, as their operators find them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm import codes
from florilege.llm.common import cut, spread
from florilege.llm.residue import noted_pages, residue_lines, with_bodies

#: Share of the words that makes a page a list, a table or junk; least words of a sentence, most of an entry, and of a longer one.
MOST, SENTENCE_WORDS, ENTRY_WORDS, LONG_ENTRY = 0.5, 6, 9, 14
#: Lines of an aligned run, and of a run of entries.
ROWS, ENTRIES = 2, 3
#: Content lines before and after that a row may stand under, and most words of its cells on average.
ROWS_NEAR, CELL_WORDS = 3, 6
#: Share of word-like pieces below which a line is debris, and share of symbols among its characters above which it is.
WORDLIKE, SYMBOLS = 0.5, 0.35
#: Least period of indents and marks, and least likeness of lengths, of a run of entries; lags tried.
PERIOD, REGULAR, LAGS = 0.4, 0.45, range(1, 5)
#: Lines of residue up to which they are broadcast (some 50 MB); beyond, they are joined to their texts.
RESIDUE_LINES = 500_000
#: Lines whose features, and pieces whose shares in them, a task remembers from block to block, and the longest of these lines.
REMEMBERED, REMEMBERED_CHARS = 100_000, 300

MARK = re.compile(r"^\s*(?:[-*+•–—▪◦·]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,4}[.)])\s+")
HEADING = re.compile(r"^\s*#{1,6}\s")
RULE = re.compile(r"^\s*\|?(?:\s*:?-{2,}:?\s*\|?)+\s*$")
LINKS = re.compile(r"\[([^\]\n]*)\]\([^)\s]*\)|https?://\S+")
GAP = re.compile(r"\S( {2,})(?=\S)")
COLUMN = re.compile(r"(?<=\S)(?: {2,}| *\t[ \t]*)(?=\S)")
ENDS = frozenset(".!?…:;")
LETTERS = re.compile(r"[^\W\d_]+")
SYMBOL = re.compile(r"[^\w\s]+")
VOWEL = re.compile(r"[aeiouyäöüáéíóúàèìòùâêîôûãõåæøœëïęąőűıAEIOUYÄÖÜÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÅÆØŒĘĄİI]")
CODE = re.compile(r"(?=.*\d)(?=.*[a-zA-Z])[\w+/=-]{6,}$|[0-9a-fA-F]{16,}$|[\w+/=-]{28,}$")
NUMBER = re.compile(r"^[-+(]?[\d.,:/%€$-]+\)?$")
# Determiners, pronouns and verbs that sentences hold and entries of lists rarely do, and common words.
SENTENCE_MARKS = frozenset((
    "der die das dem den des ein eine einen einem einer ist sind war wird werden wurde hat haben kann können muss müssen soll sollen darf wer sich nicht es sie er wir ihr ihre dass weil wenn sobald damit bleibt liegen finden gehört umfasst beantwortet wendet möchte an im "
    "the a an is are was were be been has have had can could must should will would it they their there this that these those who if so because until not we you stays takes "
    "le la les un une est sont il elle ils elles qui que ce cette être peut el los las es son está están se lo gli è il uno una si che het een de zijn hij zij wordt worden omdat waar jest są się że który bir bu şu ve için olarak gerekir hakkında"
).split())
COMMON = SENTENCE_MARKS | frozenset((
    "und oder aber mit für von auf zu zur zum bei nach über unter zwischen durch gegen ohne um seit vor während bis als auch nur wie and or but of to in for with on at by from as about before after "
    "et ou de des du dans pour par sur avec y o en con por para del al e di del della per con su en of van op voor met i w na z do dla ile de da"
).split())


def _piece(piece: str) -> tuple[bool, bool]:
    """Whether a piece between white space looks like a word, and whether it is a number or code."""
    code = (not piece.isalpha() or len(piece) >= 28) and (NUMBER.match(piece) or CODE.match(piece))
    return _wordlike(piece), bool(code)


def _wordlike(piece: str) -> bool:
    """Whether a piece looks like a word of some language."""
    core = piece.strip(".,;:!?…\"'()[]{}„“”»«*_-–—/|·•©")
    if not core:
        return False
    if not all(c.isalpha() or c in "-'’/.&" for c in core):
        return False
    if len(core) > 45 or (len(core) > 3 and not VOWEL.search(core)):
        return False
    parts = LETTERS.findall(core)
    inner = sum(1 for p in parts if p[1:] != p[1:].lower() and p != p.upper())
    odd = sum(1 for c in core if "\x80" <= c <= "¿" or c in "×÷�")
    return bool(parts) and inner <= 1 and not odd and (len(core) > 1 or core.lower() in "aeioyuàéèóyiw")


def line_features(line: str, runs: str | None = None, symbols: int = 0) -> tuple:
    """(words, word-like, numbers and codes, sentence marks, mark, heading, ends like a sentence, delimiter, cells,
    letter words, their letters, common words, symbols). ``runs`` are the line's runs of letters in lower case, if they are known,
    and ``symbols`` its symbols."""
    body, mark, linked = _body(line)
    pieces = body.split()
    heading = "#" in line and HEADING.match(line) is not None
    if heading:
        pieces = [p for p in pieces if p.strip("#")]
    if runs is None or mark or linked:
        letters, symbols = LETTERS.findall(body.lower()), sum(map(len, SYMBOL.findall(body)))
    else:
        letters = runs.split()
    common = [w for w in letters if w in COMMON]
    marks = sum(map(SENTENCE_MARKS.__contains__, common))
    both = [_piece(p) for p in pieces]
    like = sum(x for x, _ in both)
    coded = 0 if like == len(pieces) and len(line) < 28 else sum(x for _, x in both)
    return len(pieces), like, coded, marks, mark, heading, *_shape(line, mark), len(letters), sum(map(len, letters)), len(common), symbols


def _body(line: str) -> tuple[str, bool, bool]:
    """A line without its mark and with its links as their texts, and whether it has either."""
    mark = MARK.match(line)
    body = line[mark.end() :] if mark else line
    linked = "](" in body or "://" in body
    return LINKS.sub(r" \1 ", body) if linked else body, mark is not None, linked


def _shape(line: str, mark: bool) -> tuple[bool, str, int]:
    """(ends like a sentence, delimiter, cells)."""
    filled = line.strip()
    if "|" in line and filled.startswith("|"):
        delimiter, cells = "|", filled.strip("|").count("|") + 1
    elif "\t" in filled:
        delimiter, cells = "\t", filled.count("\t") + 1
    elif not mark and "  " in filled and (n := len(GAP.findall(filled))):
        delimiter, cells = " ", n + 1
    elif ";" in line and (n := line.count("; ")):
        delimiter, cells = ";", n + 1
    else:
        delimiter, cells = "", 1
    last = filled.rstrip("\"'”»)]")
    if last and ord(last[-1]) > 0x1F2FF:
        last = last[:-1].rstrip().rstrip("\"'”»)]")
    return last[-1:] in ENDS, delimiter, cells


class Pieces(dict):
    """Numbers of pieces between white space, and a table of what each of them adds to its line."""

    def __init__(self) -> None:
        self.new: list[tuple] = []
        self.table = np.empty((0, 8), np.int64)

    def __missing__(self, piece: str) -> int:
        letters = LETTERS.findall(piece.lower())
        common = [w for w in letters if w in COMMON]
        marks, symbols = sum(map(SENTENCE_MARKS.__contains__, common)), sum(map(len, SYMBOL.findall(piece)))
        self.new.append((*_piece(piece), marks, len(letters), sum(map(len, letters)), len(common), symbols, not piece.strip("#")))
        self[piece] = at = len(self)
        return at

    def sums(self, pieces: list[str], counts: list[int]) -> list[list[int]]:
        """What so many pieces each add up to, line after line."""
        if len(self) > REMEMBERED:
            self.__init__()
            self.clear()
        at = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        if self.new:
            self.table = np.concatenate([self.table, np.array(self.new, np.int64)])
            self.new = []
        total = np.zeros((len(at) + 1, 8), np.int64)
        np.cumsum(self.table[at], axis=0, out=total[1:])
        return np.diff(total[np.cumsum([0, *counts])], axis=0).tolist()


class Lines(dict):
    """(pieces, features, indent, what repeats of it if it's short) of the lines of many texts, None for a blank one.

    Features are those of ``line_features``, added up from pieces for all the lines of a block that aren't known yet.
    """

    def __init__(self) -> None:
        self.pieces = Pieces()

    def read(self, lines: list[str]) -> None:
        """Know these lines; what isn't to be remembered goes with the next call."""
        if len(self) > REMEMBERED:
            self.clear()
        for line in [x for x in self if len(x) > REMEMBERED_CHARS]:
            del self[line]
        flat, counts, fresh = [], [], []
        for line in dict.fromkeys(lines):
            if line in self:
                continue
            if not line or line.isspace():
                self[line] = None
                continue
            body, mark, linked = _body(line)
            pieces = body.split()
            flat += pieces
            counts.append(len(pieces))
            fresh.append((line, mark, len(line.split()) if mark or linked else len(pieces)))
        for (line, mark, n), size, (like, coded, marks, letters, length, common, symbols, plain) in zip(fresh, counts, self.pieces.sums(flat, counts), strict=True):
            heading = "#" in line and HEADING.match(line) is not None
            if heading:
                size -= plain
            if like == size and len(line) < 28:
                coded = 0
            short = " ".join(line.lower().split()) if len(line) <= 80 else ""
            self[line] = n, (size, like, coded, marks, mark, heading, *_shape(line, mark), letters, length, common, symbols), len(line) - len(line.lstrip()), short


def _autocorrelation(values: list[int], lags: range) -> float:
    """Greatest autocorrelation over the lags; 0 for few or equal values."""
    x = np.array(values, float)
    if len(x) < 4:
        return 0.0
    x -= x.sum() / len(x)
    total = float(x @ x)
    if total < 1e-9:
        return 0.0
    return max((float(x[:-k] @ x[k:]) / total for k in lags if len(x) > k + 2), default=0.0)


STATS = (
    ("words", "long"), ("lines", "long"), ("mean_word_length", "double"), ("symbol_ratio", "double"), ("end_punctuation", "double"), ("common_words", "double"),
    ("tables", "long"), ("links", "long"), ("duplicate_short_lines", "long"), ("indent_period", "double"), ("length_autocorrelation", "double"),
    ("furniture_words", "long"), ("residue_words", "long"), ("prose_words", "long"), ("list_words", "long"), ("table_words", "long"), ("junk_words", "long"), ("kind", "string"),
)


def page_statistics(text: str, gone: list[int] | None = None, bad: list[int] | None = None, known: Lines | None = None) -> tuple:
    """The values of STATS for one text; ``kind`` is prose, list, table, junk, or empty if no content is left.

    ``gone`` are the numbers of its furniture lines, ``bad`` those of residue, ``known`` what is known of its lines.
    """
    aside, bad = frozenset(gone or ()), frozenset(bad or ())
    lines = text.split("\n")
    if known is None:
        known = Lines()
        known.read(lines)
    words = furniture = residue = 0
    rows, indents, lengths, features, some = [], [], [], [], []
    for no, (line, x) in enumerate(zip(lines, map(known.__getitem__, lines), strict=True)):
        if x is None:
            rows.append(None)
            continue
        n, f, indent, short = x
        words += n
        features.append(f)
        if short:
            some.append(short)
        if no in aside:
            furniture += n
            continue
        if no in bad:
            residue += n
            rows.append(None)
            continue
        rows.append((line, f))
        indents.append(indent)
        lengths.append(len(line))
    kinds = line_kinds(rows)
    total = Counter()
    for row, kind in zip(rows, kinds, strict=True):
        if row is not None and kind:
            total[kind] += row[1][0]
    content = total["prose"] + total["list"] + total["table"] + total["junk"]
    kind = "empty" if not content else next((k for k in ("junk", "table", "list") if total[k] > MOST * content), "prose")
    if kind == "prose" and content and total["prose"] < MOST * content:
        # No single kind has most of the words: the largest that isn't prose, if together they outweigh it.
        kind = max(("junk", "table", "list"), key=lambda k: total[k])
    columns, filled = list(zip(*features, strict=True)) or [()] * 13, len(features)
    ended, letters, length_of, common, symbols = map(sum, (columns[6], *columns[9:]))
    tables = _tables(rows, kinds)
    short = Counter(some if len(some) >= 3 else ())
    return (
        words, filled, round(length_of / max(1, letters), 4), round(symbols / max(1, len(text)), 4), round(ended / max(1, filled), 4),
        round(common / max(1, letters), 4), tables, len(LINKS.findall(text)) if "](" in text or "://" in text else 0, sum(n for n in short.values() if n >= 3),
        round(_autocorrelation(indents, LAGS), 4), round(_autocorrelation(lengths, range(1, 4)), 4),
        furniture, residue, total["prose"], total["list"], total["table"], total["junk"], kind,
    )


def _columns(line: str) -> set[int]:
    """Where the cells after the first begin, tabs widened."""
    return {len(line[: m.end()].expandtabs(8)) for m in COLUMN.finditer(line)}


def _stands_under(line: str, other: str) -> bool:
    """Whether the cells of the line with fewer of them all begin where cells of the other do."""
    a, b = _columns(line), _columns(other)
    return bool(a and b) and (a <= b or b <= a)


def _aligned(row: tuple, other: tuple) -> bool:
    """Whether the delimiters of two lines stand under each other; a row may lack cells that the other has."""
    (line, f), (under, g) = row, other
    if f[7] in ("\t", " ") and g[7] in ("\t", " ") and _stands_under(line, under):
        return True
    return f[7] == g[7] != "" and f[8] == g[8] >= 2


def period(rows: list[tuple]) -> float:
    """Share of lines that begin like the line before them at the best of LAGS: the same indent, and a mark or none."""
    starts = [(len(line) - len(line.lstrip()), f[4]) for line, f in rows]
    return max((sum(a == b for a, b in zip(starts, starts[k:], strict=False)) / (len(starts) - k) for k in LAGS if len(starts) > k), default=0.0)


def regularity(rows: list[tuple]) -> float:
    """Mean likeness of the lengths of lines at the best of LAGS: the shorter divided by the longer."""
    n = [len(line.strip()) for line, _ in rows]
    return max((sum(min(a, b) / max(a, b) for a, b in zip(n, n[k:], strict=False)) / (len(n) - k) for k in LAGS if len(n) > k), default=0.0)


def line_kinds(rows: list) -> list[str]:
    """Kind of every content line, by its section's layout and its own words; blank lines don't part neighbours."""
    out = [""] * len(rows)
    content = [k for k, row in enumerate(rows) if row is not None]
    maybe = set()
    for i, k in enumerate(content):
        line, (n, like, codes, marks, mark, heading, ended, delimiter, cells, letters, length, _, symbols) = rows[k]
        if heading or not n:
            continue
        if RULE.match(line):
            out[k] = "table" if delimiter == "|" else ""
            continue
        if delimiter and n <= CELL_WORDS * cells and (delimiter == "|" or marks < 2):
            near = (rows[j] for j in content[max(0, i - ROWS_NEAR) : i + ROWS_NEAR + 1] if j != k)
            if any(_aligned(rows[k], r) for r in near):
                out[k] = "table"
                continue
        sentence = n >= SENTENCE_WORDS and (marks >= 2 or (ended and like >= 0.7 * n)) and like >= WORDLIKE * n
        if sentence or (ended and n >= 4 and marks and like >= 0.7 * n):
            out[k] = "prose"
        elif like < WORDLIKE * (n - (0 if codes == n else min(codes, 1))) or codes > 0.6 * n or symbols > SYMBOLS * len(line):
            out[k] = "junk"
        elif n > LONG_ENTRY and not mark:
            out[k] = "prose" if like >= 0.7 * n else "junk"
        else:
            maybe.add(k)
    k = 0
    while k < len(content):
        if content[k] not in maybe:
            k += 1
            continue
        j = k
        while j < len(content) and content[j] in maybe:
            j += 1
        run = content[k:j]
        lines = [rows[i] for i in run]
        marked = sum(f[4] for _, f in lines)
        after = k > 0 and out[content[k - 1]] == "list"
        # A list begins alike with a period, and where no marks show it, its entries have lengths that repeat.
        listed = period(lines) >= PERIOD and (marked >= 0.5 * len(run) or regularity(lines) >= REGULAR) if len(run) >= ENTRIES else after
        for i in run:
            n, like, mark = rows[i][1][0], rows[i][1][1], rows[i][1][4]
            if listed or (mark and len(run) < ENTRIES):
                out[i] = "list"
            elif n <= ENTRY_WORDS:
                out[i] = "short"  # captions and names
            else:
                out[i] = "prose" if like >= 0.7 * n else "junk"
        k = j
    return out


def _tables(rows: list, kinds: list[str]) -> int:
    """Number of runs of table rows."""
    runs, size = 0, 0
    for kind in [*kinds, ""]:
        if kind == "table":
            size += 1
        else:
            runs += size >= ROWS
            size = 0
    return runs


def _statistics(batches: Iterator[pa.RecordBatch], residue: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
    known, kinds = Lines(), {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    for batch in batches:
        every = batch.column("text").to_pylist()
        for block in codes.blocks(every):
            part, texts = batch.slice(block.start, block.stop - block.start), every[block]
            known.read("\n".join(texts).split("\n"))
            bad = part.column("bad").to_pylist() if "bad" in part.schema.names else map(residue.get, part.column("rid").to_pylist())
            each = zip(texts, part.column("gone").to_pylist(), bad, strict=True)
            values = list(zip(*(page_statistics(*x, known) for x in each), strict=True))
            arrays = [pa.array(v, kinds[k]) for v, (_, k) in zip(values, STATS, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("file"), *arrays], names=["file", *(n for n, _ in STATS)])


def statistics(bodies: DataFrame, reasons: DataFrame) -> DataFrame:
    """(file, STATS..) of every file of ``bodies`` (file, source_url, text) with text, repeated rows once.

    ``reasons`` (source_url, reasons) are notes that help to tell residue. A null file name is one of its own.
    """
    rows = with_bodies(bodies, ["file"])
    bad = cut(residue_lines(rows, noted_pages(reasons)).select("rid", "line_no").distinct())
    lines: dict[int, list[int]] = {}
    rows = rows.select("file", "rid", "text", "gone")
    if bad.count() <= RESIDUE_LINES:
        for r in bad.collect():
            lines.setdefault(r["rid"], []).append(r["line_no"])
    else:
        rows = rows.join(bad.groupBy("rid").agg(F.collect_set("line_no").alias("bad")), "rid", "left")  # at most as many as a text has lines
    shared = bodies.sparkSession.sparkContext.broadcast(lines)
    return spread(rows).mapInArrow(lambda b: _statistics(b, shared.value), "file string, " + ", ".join(f"{n} {k}" for n, k in STATS)).distinct()


def not_prose(bodies: DataFrame, reasons: DataFrame) -> DataFrame:
    """(file, kind): files whose main content is a list, a table or junk; pages without content are none."""
    rows = statistics(bodies, reasons)
    return rows.where(F.col("kind").isin("list", "table", "junk") & F.col("file").isNotNull()).select("file", "kind").distinct()
