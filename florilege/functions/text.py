"""Scalar functions over text, all as column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
#: White space as Python and Unicode see it.
SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"


def fold(c: Column, sharp_s: bool = True) -> Column:
    """Lower case with umlauts spelled out, ß as ss unless told otherwise."""
    out = F.lower(c)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), *([("ß", "ss")] if sharp_s else [])):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def squeeze(c: Column) -> Column:
    """White space at the ends removed and single within."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def strip(c: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(c, rf"^{SPACE}|{SPACE}$", "")


def word_count(c: Column) -> Column:
    """Pieces between white space."""
    return F.size(F.filter(F.split(c, SPACE), lambda x: x != "")).cast("long")


def token_count(c: Column) -> Column:
    """Runs of letters, digits, underscores and hyphens that aren't hyphens alone."""
    return F.regexp_count(c, F.lit(rf"[\p{{L}}\p{{N}}_-]*{WORD}[\p{{L}}\p{{N}}_-]*")).cast("long")


def lines(c: Column) -> Column:
    """Lines of a text, whatever ends them."""
    return F.split(c, r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]", -1)


def table_lines(c: Column) -> Column:
    """Lines that hold a separator of a Markdown table."""
    return F.size(F.filter(lines(c), lambda x: x.rlike(r"\|[\s\-:]+\|"))).cast("long")


def occurrences(c: Column, needle: str) -> Column:
    """Occurrences of a literal that don't overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles])


def hits(c: Column, needles: Iterable[str]) -> Column:
    """How many of the literals stand in a text, each counted once."""
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(n)).cast("int") for n in needles])


def weighted(c: Column, weights: dict[str, int]) -> Column:
    """Sum of the weights of the literals that stand in a text, each counted once."""
    return reduce(lambda a, b: a + b, [F.when(F.contains(c, F.lit(k)), w).otherwise(0) for k, w in weights.items()])


# Markers of German and English.
GERMAN = (" und ", " der ", " die ", " das ", " für ", " studium ", " bewerbung ", " ordnung ")
ENGLISH = (
    " and ", " contact ", " courses offered ", " deadline ", " english language ", " the ", " course ", " courses ", " exchange students ", " information for ", " international office ",
    " offered in english ", " application ",
)


def marker_counts(text: Column, hints: Column) -> tuple[Column, Column]:
    """(German, English) occurrences of the markers in a text and its hints."""
    sample = F.concat(F.lit(" "), F.lower(text), F.lit(" "), F.lower(hints), F.lit(" "))
    both = [reduce(lambda a, b: a + b, [occurrences(sample, m) for m in markers]) for markers in (GERMAN, ENGLISH)]
    return both[0], both[1]


def marker_language(german: Column, english: Column) -> Column:
    return (
        F.when((german == 0) & (english == 0), "unknown")
        .when((german >= english * 2) & (german >= 2), "de")
        .when((english >= german * 2) & (english >= 2), "en")
        .otherwise("mixed")
    )


def clean_inline(c: Column) -> Column:
    """Text of a Markdown line: links and emphasis as plain words, list marks and outer punctuation removed."""
    out = F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", " ")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"[*_`#>]+", " ")
    return F.regexp_replace(squeeze(out), r"^[ :\-]+|[ :\-]+$", "")


def clip(c: Column, limit: int) -> Column:
    """A squeezed text of at most ``limit`` characters, with an ellipsis where it was cut."""
    one = squeeze(c)
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, limit - 1)), F.lit("…")))
