"""Texts as arrays of code points: lower case, words and lines of many texts at once, as ``str`` and ``re`` see them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np

#: What a character in lower case is: white space, a letter or a digit, a decimal digit, a letter or number that is none.
SPACE, WORD, DIGIT, LETTER = 1, 2, 4, 8
#: The only character whose lower case has two; the second is no word character.
DOTTED = 0x130
DIGITS = re.compile(r"\d+")
#: Characters that are read at once.
BLOCK_CHARS = 1_000_000


def _lower(c: int) -> int:
    return ord(chr(c).lower()[0])


def _kind(c: int) -> int:
    x = chr(c)
    digit, word = x.isdecimal(), x.isalnum()
    return SPACE * x.isspace() | WORD * word | DIGIT * digit | LETTER * (word and not digit)


@cache
def _table() -> np.ndarray:
    """Lower case, and from bit 24 on the kind of the lower case, of the first 65,536 characters."""
    lower = [_lower(c) for c in range(0x10000)]
    return np.array([c | _kind(c) << 24 for c in lower], np.uint32)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def string(data: np.ndarray) -> str:
    return data.astype("<u4", copy=False).tobytes().decode("utf-32-le", "surrogatepass")


def read(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower, kind, after) of the characters of a text: lower case, its kind, and where a word begins after DOTTED."""
    data = codes(text)
    after = np.flatnonzero(data == DOTTED) + 1 if chr(DOTTED) in text else np.empty(0, np.int64)
    if "Σ" in text:  # its lower case depends on what stands beside it
        data = codes(text.replace(chr(DOTTED), "i").lower())
    both = _table().take(data, mode="clip")
    low, kinds = both & 0xFFFFFF, (both >> 24).astype(np.uint8)
    if len(data) and data.max() >= 0x10000:
        far = np.flatnonzero(data >= 0x10000)
        values, at = np.unique(data[far], return_inverse=True)
        values = [_lower(c) for c in values.tolist()]
        low[far] = np.array(values, np.uint32)[at]
        kinds[far] = np.array([_kind(c) for c in values], np.uint8)[at]
    return low, kinds, after[after < len(data)]


def starts(word: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where runs of the characters flagged begin."""
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[after] = word[after]
    return first


def _runs(low: np.ndarray, run: np.ndarray, after: np.ndarray, again: np.ndarray | None = None) -> list[str]:
    """The runs of characters flagged, parted by single blanks, of every line, without the characters in ``again``."""
    line = low == 10
    kept = run | line
    if len(after):
        first = starts(run, after)
        kept = kept if again is None else kept & ~again
        at = np.flatnonzero(kept)
        return string(_spaced(low[at], first[at])).split("\n")
    gap = ~kept
    gap[:1] = False
    gap[1:] &= run[:-1]
    kept |= gap
    if again is not None:
        kept &= ~again
    text = string(np.where(gap, np.uint32(32), low)[kept]).replace(" \n", "\n")
    return (text[:-1] if text.endswith(" ") else text).split("\n")


def _spaced(data: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """``data`` with a blank before the words that begin where flagged and don't open a line."""
    blank[:1] = False
    blank[1:] &= data[:-1] != 10
    out = np.full(len(data) + np.count_nonzero(blank), 32, np.uint32)
    place = np.cumsum(blank, dtype=np.int32)
    place += np.arange(len(data), dtype=np.int32)
    out[place] = data
    return out


def line_keys(text: str, digits: bool = True) -> list[str]:
    """Letters and digits of every line in lower case, anything else as one blank; digit runs as 0 if asked for."""
    return _keys(*read(text), digits)


def keys_and_words(text: str) -> tuple[list[str], list[str]]:
    """``line_keys`` and ``line_words``."""
    return lines_keys_and_words(text)[1:]


def lines_keys_and_words(text: str) -> tuple[list[str], list[str], list[str]]:
    """Every line in lower case with digit runs as 0, ``line_keys`` and ``line_words``."""
    low, kind, after = read(text)
    flat, again = _zeros(low, kind)
    if len(after) or chr(DOTTED) in text:  # in lower case it has two characters
        lines = DIGITS.sub("0", text.lower()).split("\n")
    else:
        lines = string(flat[~again]).split("\n")
    return lines, _runs(flat, (kind & WORD) > 0, after, again), _words(low, kind, after)


def _zeros(low: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters with 0 for digits, and where a digit follows another."""
    digit = (kind & DIGIT) > 0
    again = digit.copy()
    again[:1] = False
    again[1:] &= digit[:-1]
    return np.where(digit, np.uint32(48), low), again


def _keys(low: np.ndarray, kind: np.ndarray, after: np.ndarray, digits: bool) -> list[str]:
    flat, again = _zeros(low, kind) if digits else (low, None)
    return _runs(flat, (kind & WORD) > 0, after, again)


def line_words(text: str) -> list[str]:
    """Runs of letters of every line in lower case, parted by single blanks."""
    return _words(*read(text))


def _words(low: np.ndarray, kind: np.ndarray, after: np.ndarray) -> list[str]:
    return _runs(low, (kind & LETTER) > 0, after)


def line_parts(text: str) -> tuple[list[str], list[int], list[int]]:
    """``line_words``, and how many pieces between white space and how many symbols are in every line; _ is none."""
    low, kind, after = read(text)
    ends = np.r_[np.flatnonzero(low == 10), len(low)]
    space = (kind & SPACE) > 0
    piece, symbol = starts(~space, after[:0]), ((kind & (SPACE | WORD)) == 0) & (low != 95)
    counts = [np.diff(np.searchsorted(np.flatnonzero(x), ends), prepend=0).tolist() for x in (piece, symbol)]
    return _words(low, kind, after), *counts


def blocks(texts: list[str], chars: int = BLOCK_CHARS) -> Iterator[slice]:
    """Slices of the texts of about so many characters."""
    at = size = 0
    for k, x in enumerate(texts):
        if size and size + len(x) > chars:
            yield slice(at, k)
            at, size = k, 0
        size += len(x)
    if at < len(texts):
        yield slice(at, len(texts))
