"""Keyword-stuffed pages, bare link lists and product tags, by rank-frequency curves.

The word frequencies of a page are ranked with SQL windows and a line is fitted to log frequency over log rank. The
slope, the residual and the share of the top ranks are compared with those of prose of the same language and of
comparable length, over all documents. A page whose curve lies far off, and whose words are neither sentences nor
code, is keyword spam; words of links and tags are counted apart.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.llm.common import cut

#: Least words of a page, least share of spam words, ranks that count as top.
MIN_WORDS, SPAM_SHARE, TOP = 20, 0.5, 5
#: Most code symbols and function words a word of keyword spam, and least function words of prose.
MAX_SYMBOLS, MAX_FUNCTION, PROSE_FUNCTION = 0.25, 0.12, 0.2
#: Deviations from prose beyond which a curve is extreme, and the least spread taken for prose.
FAR, LEAST_SPREAD = 3.0, 0.03
#: Prose pages of a language and length class below which all prose of that length is the standard.
ENOUGH = 30

LINK = re.compile(r"\[([^\]\n]*)\]\(\s*(https?://[^)\s]*)[^)]*\)|<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)[^>]*>([^<]*)</a>|(https?://[^\s\"'<>)\]]+|\bwww\.[^\s\"'<>)\]]+)", re.I)
TAG = re.compile(r"(?<![\w&/#(\"':=.-])#(?![0-9a-fA-F]{3,8}\b)([^\W\d_]\w+)(?![\w({:;])")
#: Words of the C preprocessor that look like tags.
DIRECTIVES = frozenset("include define undef if ifdef ifndef elif else endif pragma error line warning region endregion".split())
WORD = re.compile(r"[^\W_]+")
LETTERS = re.compile(r"[^\W\d_]{2,}")
SYMBOL = re.compile(r"[{}()=<>\[\]_:+&!@$\\`^~]")
# Frequent function words of German and English.
FUNCTION = frozenset((
    "the and of to in is are was were be been an for with on at by from as that this these it its they them their we our you your he she his her not or but if so because before after between under over without within about into during until when while where which who what how can could must should may might will would have has had do does all any each there here than then stays remains such "
    "der die das und ist nicht ein eine einen einer eines mit für von auf dem den des im zu zur zum werden wird wurde haben hat sich auch als an bei nach über unter zwischen oder aber wenn weil damit sobald können müssen sollen dürfen alle diese dieser wer was wo wie nur durch gegen um seit vor während vom am bis sowie"
).split())


def page_words(text: str) -> tuple[int, int, int, int, int, int, Counter]:
    """(words, link words, tag words, plain words, function words, symbols, frequencies of the plain words)."""
    link = 0

    def one(m: re.Match) -> str:
        nonlocal link
        link += len(WORD.findall(m.group()))
        return " "

    rest = LINK.sub(one, text)
    tags = [m.group() for m in TAG.finditer(rest) if m.group(1).lower() not in DIRECTIVES]
    tag = sum(len(WORD.findall(t)) for t in tags)
    if tags:
        rest = TAG.sub(lambda m: m.group() if m.group(1).lower() in DIRECTIVES else " ", rest)
    words = WORD.findall(rest)
    plain = LETTERS.findall(rest.lower())
    counts = Counter(plain)
    function = sum(n for w, n in counts.items() if w in FUNCTION)
    return len(words) + link + tag, link, tag, len(plain), function, len(SYMBOL.findall(rest)), counts


FEATURES = ("words", "links", "tags", "plain", "functions", "symbols")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        cols: list[list] = [[] for _ in FEATURES]
        hashes, counts, ends = [], [], [0]
        for text in texts:
            *numbers, freq = page_words(text)
            for c, x in zip(cols, numbers, strict=True):
                c.append(x)
            hashes += [xxhash.xxh32_intdigest(w) for w in freq]
            counts += freq.values()
            ends.append(len(hashes))
        kept = batch.drop_columns(["text"])
        offsets = pa.array(ends, pa.int32())
        arrays = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (hashes, counts)]
        yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, pa.int64()) for c in cols), *arrays], names=[*kept.schema.names, *FEATURES, "w", "n"])


def curves(df: DataFrame) -> DataFrame:
    """(doc_id, lang, words.., slope, residual, top, distinct) of every row with text.

    Ranks come from a window over each row's words, so a page is never split, and no page shares a task's memory.
    """
    rows = df.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"), F.monotonically_increasing_id().alias("rid"), "text")
    numbers = ", ".join(f"{f} long" for f in FEATURES)
    rows = rows.mapInArrow(_features, f"doc_id long, lang string, rid long, {numbers}, w array<long>, n array<long>")
    words = rows.select("doc_id", "lang", "rid", *FEATURES, F.explode_outer(F.arrays_zip("w", "n")).alias("x")).select("doc_id", "lang", "rid", *FEATURES, F.col("x.w").alias("w"), F.col("x.n").alias("n"))
    words = words.repartition("rid")
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("n"), "w"))
    x, y = F.ln("r"), F.ln("n")
    fit = words.withColumn("r", rank).groupBy("rid", "doc_id", "lang", *FEATURES).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.count("w").alias("distinct"), F.sum(F.when(F.col("r") <= TOP, F.col("n"))).alias("top")
    )
    residual = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.coalesce(F.col("slope") * F.col("sxy"), F.lit(0.0))) / F.greatest(F.col("distinct"), F.lit(1)))
    some = F.greatest("plain", F.lit(1))
    return fit.select("rid", "doc_id", "lang", *FEATURES, "distinct", F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce(residual, F.lit(0.0)).alias("residual"), (F.coalesce("top", F.lit(0)) / some).alias("top"), (F.col("distinct") / some).alias("variety"))


MEASURES = ("slope", "residual", "top", "variety")


def judged(df: DataFrame) -> DataFrame:
    """``curves`` with the deviations from prose of the same language and length, and ``kind``: links, tags, keywords or null.

    Null or blank texts have no kind. Pages under MIN_WORDS words are never spam. A repeated row is judged as each.
    """
    page = cut(curves(df).withColumn("size", F.floor(F.log2(F.greatest("plain", F.lit(1))))))
    prose = page.where((F.col("plain") >= MIN_WORDS) & (F.col("functions") >= PROSE_FUNCTION * F.col("plain")) & (F.col("symbols") <= MAX_SYMBOLS * F.col("plain")))
    stats = [f(F.col(m)).alias(f"{m}_{k}") for m in MEASURES for k, f in (("mean", F.avg), ("std", F.stddev_pop))]
    # Standards are a row for each language and power of two of the length: a bounded table, sizes at most 64.
    own = prose.groupBy("lang", "size").agg(F.count(F.lit(1)).alias("pages"), *stats).where(F.col("pages") >= ENOUGH)
    every = prose.groupBy("size").agg(*stats)
    page = page.join(own, ["lang", "size"], "left")
    page = page.join(every.select("size", *[F.col(f"{m}_{k}").alias(f"all_{m}_{k}") for m in MEASURES for k in ("mean", "std")]), "size", "left")
    far = {}
    for m in MEASURES:
        mean, std = (F.coalesce(f"{m}_{k}", f"all_{m}_{k}") for k in ("mean", "std"))
        far[m] = F.round((F.col(m) - mean) / F.greatest(std, F.lit(LEAST_SPREAD)), 3)
    page = page.withColumns({f"far_{m}": c for m, c in far.items()})
    extreme = (F.col("far_slope").between(-FAR, FAR) == F.lit(False)) | (F.col("far_residual") > FAR) | (F.col("far_top") > FAR) | (F.col("far_variety") < -FAR)
    # Where no prose of such a length is known, repetition alone decides.
    extreme = F.coalesce(extreme, F.lit(True))
    # Terms strung together like sentences have some function words but hardly any variety.
    bare = (F.col("functions") <= MAX_FUNCTION * F.col("plain")) & (F.col("top") >= 0.25) & (F.col("variety") <= 0.5)
    strung = (F.col("functions") <= PROSE_FUNCTION * F.col("plain")) & (F.col("top") >= 0.5) & (F.col("variety") <= 0.25)
    stuffed = extreme & (F.col("symbols") <= MAX_SYMBOLS * F.col("plain")) & (bare | strung)
    keyword = F.when(stuffed, F.col("words") - F.col("links") - F.col("tags")).otherwise(0)
    total = F.col("links") + F.col("tags") + keyword
    kind = F.when(F.col("words") < MIN_WORDS, None).when(total <= SPAM_SHARE * F.col("words"), None).when(keyword >= F.greatest("links", "tags"), "keywords").when(F.col("links") >= F.col("tags"), "links").otherwise("tags")
    return page.withColumn("kind", kind).withColumn("share", F.round(total / F.greatest("words", F.lit(1)), 4))


def spam(df: DataFrame) -> DataFrame:
    """(doc_id, kind, share): the documents that are spam; repeated rows of a document give one."""
    return judged(df).where("kind IS NOT NULL").groupBy("doc_id").agg(F.min("kind").alias("kind"), F.max("share").alias("share"))
