"""Languages of documents and of stretches of mixed documents, by cross-parsing entropy.

For every language a suffix automaton is built over labelled text. A sentence is cut greedily into the longest
phrases, across its words, that stand in the labelled text; the number of phrases times the logarithm of that text's length,
per character, estimates the cross entropy, and the language that needs least wins. Texts are cut into sentences and words
as arrays of code points, and all sentences of a block of texts are parsed at once, a character at a time, against the
automata of all languages.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.llm import codes
from florilege.llm.common import spread
from florilege.llm.maincontent import with_furniture

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pl", "tr")
#: Bounds of the labelled sample: pages of each label, characters of a page, and characters of a language's text.
SAMPLE_PAGES, PAGE_CHARS, TRAIN_CHARS = 80, 20_000, 16_000
#: Words below which a page is no case, share of a second language that makes a page mixed, and of known words.
MIN_WORDS, MIXED_SHARE, KNOWN_SHARE = 30, 0.25, 0.2
#: Entropy a character above which a stretch is in no known language.
MAX_ENTROPY = 5.0
#: Characters of labelled text below which a language's seed text is learned too, and of a piece that is parsed at once.
ENOUGH_CHARS, PIECE_CHARS = 4_000, 1_000
#: Share of the next language's entropy below which a seed's judgement is clear.
CLEAR = 0.97

# Names of the languages in labels, in lower case; a region after - or _ is cut off first.
NAMES = {
    "de": "de deu ger german deutsch germany", "en": "en eng english englisch anglais", "fr": "fr fra fre french französisch français francais",
    "es": "es spa spanish spanisch español espanol", "nl": "nl nld dut dutch niederländisch nederlands", "it": "it ita italian italienisch italiano",
    "pl": "pl pol polish polnisch polski", "tr": "tr tur turkish türkisch türkçe turkce", "mixed": "mixed mix mul multi multiple multilingual gemischt mehrsprachig",
}
#: Seed text of each language, learned where there is little labelled text.
SEEDS = {
    "de": "der die das und ist nicht ein eine mit für von auf dem den des im zu zur zum werden wird wurde haben hat sich auch als an bei nach über unter zwischen oder aber wenn weil damit sobald können müssen sollen dürfen alle diese dieser jede ihre ihr unsere wir sie es er wer was wo wie nur noch schon mehr sehr durch gegen ohne um seit vor während beim vom ins am bis höchstens dazu danach hier dort studierende hochschule prüfung vorlesung anmeldung frist raum termin antrag leitung ordnung gebäude beschäftigte bewerbung unterlagen stunden tage wochen jahr öffnungszeiten fragen beantwortet umfasst gehört finden plätze",
    "en": "the and of to in is are was were be been a an for with on at by from as that this these those it its they them their we our you your he she his her not or but if so because before after between under over without within about into during until when while where which who what how can could must should may might will would have has had do does all any each every some more most other such only also there here than then students university course exam library office committee programme application deadline questions answered places days hours weeks year open takes needs remains valid staff members room report schedule",
    "fr": "le la les un une des du de et est sont dans pour par sur avec sans sous entre que qui quoi dont où ce cette ces il elle ils elles nous vous leur leurs son sa ses notre votre ne pas plus moins très aussi mais ou si car parce lorsque pendant avant après depuis jusque chez vers au aux en à être avoir fait peut doit faut ont tous toutes chaque autre étudiants étudiantes université bibliothèque bureau examen cours semestre inscription séance réseau commission faculté rapport jours heures semaines année demande écrite ouverte prête trouvent près",
    "es": "el la los las un una unos unas de del y es son en para por con sin sobre entre que quien cual donde este esta estos estas ese esa él ella ellos ellas nosotros su sus nuestro no más menos muy también pero o si porque cuando mientras antes después desde hasta hacia al a ser estar hay puede debe tiene han todos todas cada otro estudiantes universidad biblioteca oficina examen curso semestre inscripción reunión red comisión facultad informe días horas semanas año solicitud escrita abierta lista encuentran cerca según",
    "it": "il lo la i gli le un uno una di del della dei degli delle e è sono in nel nella per con senza su sul sulla tra fra che chi cui dove questo questa questi queste quello egli lei loro noi suo sua nostro non più meno molto anche ma o se perché poiché quando mentre prima dopo da dal dalla fino verso al alla ai alle essere avere può deve ha hanno tutti tutte ogni altro studenti università biblioteca ufficio esame corso semestre iscrizione riunione rete commissione facoltà relazione giorni ore settimane anno richiesta scritta aperta pronta trovano vicino",
    "nl": "de het een en is zijn in op voor van met zonder over onder tussen dat die wie wat waar deze dit hij zij wij jullie hun haar ons onze niet meer minder zeer ook maar of als omdat wanneer terwijl voordat nadat sinds tot naar bij aan door uit om te worden wordt hebben heeft kan moet mag alle elke ieder andere studenten universiteit hogeschool bibliotheek bureau examen cursus semester inschrijving vergadering netwerk commissie faculteit verslag dagen uren weken jaar aanvraag schriftelijke open klaar vinden vlak duurt",
    "pl": "i w na z ze do od dla po przed przez pod nad między o u za bez jest są być był była było może musi należy ma mają który która które kto co gdzie ten ta to ci te on ona oni one my wy ich jego jej nasz nie więcej mniej bardzo także też ale lub albo jeśli ponieważ gdy kiedy podczas aby że jak tylko wszyscy każdy inny studenci uczelnia uczelni uniwersytet biblioteka biuro egzamin kurs semestr rekrutacja spotkanie sieć komisja wydział raport dni godzin tygodni rok wniosek pisemny otwarty gotowy znajdują obok",
    "tr": "ve bir bu şu o ile için gibi kadar göre sonra önce beri arasında altında üzerinde de da ki mi ne kim nerede nasıl her bütün tüm bazı diğer daha en çok az değil var yok olan olarak oldu olur olacak gerekir gerek alabilir yapabilir biz siz onlar onların bizim ama veya eğer çünkü iken sırasında yeni öğrenciler üniversite kütüphane büro sınav ders kurs dönem kayıt toplantı ağı komisyon fakültesi rapor gün saat hafta yıl başvuru yazılı açık hazır hakkında bilgi zaman her",
}
LETTERS = re.compile(r"[^\W\d_]+")
ADDRESS = re.compile(r"\]\([^)\s]*\)|https?://\S+|www\.\S+|\S+@\S+\.\w+")
#: The same where no @ stands.
LINK = re.compile(r"\]\([^)\s]*\)|https?://\S+|www\.\S+")
END = re.compile(r"[.!?;:]+[\"'”»)\]]*\s+|\n+")
#: What ends a sentence before white space, and what may stand between.
STOPS, CLOSING = codes.codes(".!?;:"), codes.codes("\"'”»)]")


def automaton(text: str) -> dict[int, int]:
    """Transitions of the suffix automaton of a text, keyed by state * 2**21 + character; state 0 is the root."""
    links, length, moves = [-1], [0], [{}]
    last = 0
    for ch in map(ord, text):
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        links.append(0)
        p = last
        while p >= 0 and ch not in moves[p]:
            moves[p][ch] = new
            p = links[p]
        if p >= 0:
            q = moves[p][ch]
            if length[p] + 1 == length[q]:
                links[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                links.append(links[q])
                while p >= 0 and moves[p].get(ch) == q:
                    moves[p][ch] = copy
                    p = links[p]
                links[q] = links[new] = copy
        last = new
    return {(s << 21) | c: t for s, m in enumerate(moves) for c, t in m.items()}


def phrases(moves: dict[int, int], token: str) -> int:
    """Number of phrases of the greedy cross parsing; a character the automaton doesn't know is a phrase."""
    state, n = 0, 0
    for ch in map(ord, token):
        to = moves.get((state << 21) | ch)
        if to is None:
            n += state != 0
            to = moves.get(ch)
            if to is None:
                n += 1
                to = 0
        state = to
    return n + (state != 0)


class Model:
    """Automata of all languages as one table: what follows a state by a character, and the phrases that ends.

    Its size is bounded by the learned text: at most two states for each of its characters, times its alphabet.
    """

    BITS, CODES = 29, 0x3000
    STATE = (1 << BITS) - 1

    def __init__(self, texts: dict[str, str]) -> None:
        self.languages = tuple(sorted(texts))
        self.bits = np.array([math.log2(max(2, len(texts[x]))) for x in self.languages])
        moves = [automaton(f" {texts[x]} ") for x in self.languages]
        alphabet = sorted({c for x in self.languages for c in f" {texts[x]}"})
        self.width = len(alphabet) + 1
        self.code = np.zeros(self.CODES + 1, np.int32)  # the last stands for all characters beyond
        for k, c in enumerate(alphabet):
            if ord(c) < self.CODES:
                self.code[ord(c)] = k + 1
        roots, tables, first, unit = [], [], 0, 1 << self.BITS
        for m in moves:
            size = 1 + max((max(k >> 21, t) for k, t in m.items()), default=0)
            table = np.full((size, self.width), -1, np.int64)
            for k, t in m.items():
                if (k & 0x1FFFFF) < self.CODES:
                    table[k >> 21, self.code[k & 0x1FFFFF]] = (t + first) * self.width
            table[:, 0] = -1
            root = np.where(table[0] < 0, first * self.width + unit, table[0])  # an unknown character is a phrase
            rest = np.where(table[1:] < 0, root + unit, table[1:])
            tables += [root[None], rest]
            roots.append(first * self.width)
            first += size
        if first * self.width > self.STATE:
            raise ValueError("the learned text has too many different characters")
        self.roots = np.array(roots, np.int32)
        self.table = np.concatenate(tables).astype(np.int32).ravel()

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of every text in every language."""
        size = np.array([len(t) for t in texts], np.int64)
        return self._phrases(codes.codes("".join(texts)), np.cumsum(size) - size, size)

    def _phrases(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases of the pieces of ``data`` that begin at ``first``; states are kept as places in the table."""
        char = self.code.take(data, mode="clip")
        order = np.argsort(-size, kind="stable")
        start, left = first[order], size[order]
        n = len(size)
        state = np.broadcast_to(self.roots, (n, len(self.roots))).copy()
        count = np.zeros((n, len(self.roots)), np.int32)
        longer = np.searchsorted(-left, -np.arange(int(left[0]) if n else 0), "left")  # texts longer than k
        for k, n in enumerate(longer.tolist()):
            now = state[:n]
            now += char.take(start[:n] + k)[:, None]
            to = self.table.take(now)
            np.bitwise_and(to, self.STATE, out=now)
            to >>= self.BITS
            count[:n] += to
        out = np.empty_like(count)
        out[order] = count + (state != self.roots)
        return out

    def entropies(self, sentences: list[str]) -> np.ndarray:
        """Bits a character of every sentence, its words parted by single blanks, in every language."""
        size = np.array([len(s) for s in sentences], np.int64)
        return self._entropies(codes.codes("".join(sentences)), np.cumsum(size) - size, size)

    def _entropies(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        at, of, n = first, np.arange(len(size)), size
        long = np.flatnonzero(size > PIECE_CHARS)
        if len(long):
            more = []
            n = size.copy()
            for k in long.tolist():
                begin, left = int(first[k]), int(size[k])
                while left > PIECE_CHARS:
                    blank = np.flatnonzero(data[begin + 1 : begin + PIECE_CHARS] == 32)
                    cut = int(blank[-1]) + 1 if len(blank) else PIECE_CHARS
                    more.append((k, begin, cut))
                    begin, left = begin + cut, left - cut
                more.append((k, begin, left))
            short = np.flatnonzero(size <= PIECE_CHARS)
            more = np.array(more, np.int64).reshape(-1, 3)
            of, at, n = np.r_[short, more[:, 0]], np.r_[first[short], more[:, 1]], np.r_[size[short], more[:, 2]]
        total = np.zeros((len(size), len(self.languages)))
        np.add.at(total, of, self._phrases(data, at, n))
        return total * self.bits / np.maximum(1, size - 1)[:, None]


def sentences(text: str) -> list[tuple[int, int, int, str, int]]:
    """(start, end, line, words, number of words) of the sentences of a text that have words; addresses count as none.

    ``words`` are in lower case, parted and enclosed by single blanks.
    """
    out, at, line = [], 0, 0
    for m in [*END.finditer(text), None]:
        end = m.end() if m else len(text)
        if end > at:
            part = text[at:end]
            if "/" in part or "@" in part:
                part = ADDRESS.sub("] ", part)
            words = " ".join(LETTERS.findall(part.lower()))
            if words:
                out.append((at, end, line, f" {words} ", words.count(" ") + 1))
            line += text.count("\n", at, end)
            at = end
    return out


class Parts(NamedTuple):
    """Sentences of many texts: text, start, line, words and their number, as ``sentences`` has them.

    The words of a sentence are ``size`` of the code points ``data``, from ``first``.
    """

    text: np.ndarray
    start: np.ndarray
    line: np.ndarray
    n: np.ndarray
    data: np.ndarray
    first: np.ndarray
    size: np.ndarray


def split(texts: list[str]) -> Parts:
    """The sentences of all texts at once."""
    whole = "\0".join(texts)
    low, kind, after = codes.read(whole)
    length = np.array([len(t) for t in texts], np.int64) + 1
    begin = np.cumsum(length) - length  # of the texts
    lines = np.flatnonzero(low == 10)
    # A run of white space parts sentences at its end if a stop stands before it, else after its last line break.
    turn = np.diff((kind & codes.SPACE).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(turn > 0), np.flatnonzero(turn < 0)
    before, last = starts - 1, lines[np.searchsorted(lines, ends) - 1] if len(lines) else np.full(len(ends), -1)
    while True:
        quoted = np.flatnonzero((before >= 0) & np.isin(low[before], CLOSING)) if len(before) else before
        if not len(quoted):
            break
        before[quoted] -= 1
    stop = (before >= 0) & np.isin(low[before], STOPS) if len(before) else np.zeros(0, bool)
    bounds = np.unique(np.r_[begin, ends[stop], last[~stop & (last >= starts) & (last < ends)] + 1])
    part_of = lambda at: np.searchsorted(bounds, at, "right") - 1
    letter = (kind & codes.LETTER) > 0
    if "/" in whole or "@" in whole:
        mail = low == 64
        odd, mailed = np.unique(part_of(np.flatnonzero(mail | (low == 47)))), set(part_of(np.flatnonzero(mail)).tolist())
        upto = np.r_[bounds[1:], len(low)]
        spans = [(int(bounds[k]), m) for k in odd.tolist() for m in (ADDRESS if k in mailed else LINK).finditer(whole[bounds[k] : upto[k]])]
        spans = [(a + m.start(), a + m.end()) for a, m in spans]
        for a, b in spans:
            letter[a:b] = False
        if "Σ" in whole and spans:  # a word ends before an address
            low = codes.read("".join(whole[a:b] + " " * (c - b) for a, b, c in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(whole)], [*(b for _, b in spans), len(whole)], strict=True)))[0]
    at = np.flatnonzero(letter)
    new = codes.starts(letter, after)[at]
    words = np.flatnonzero(new)
    own = part_of(at[words])  # part of every word
    head = np.flatnonzero(np.diff(own, prepend=-1))  # first word of every part that has any
    part = own[head]
    n = np.diff(head, append=len(words))
    index = np.zeros(len(at), np.int32)
    index[words[head[1:]]] = 1
    # Before every word and after a part's last one there is a blank.
    place = np.arange(len(at)) + np.cumsum(new) + np.cumsum(index)
    data = np.full(len(at) + len(words) + len(part), 32, np.uint32)
    data[place] = low[at]
    first = place[words[head]] - 1
    text = np.searchsorted(begin, bounds[part], "right") - 1
    line = np.searchsorted(lines, bounds[part]) - np.searchsorted(lines, begin[text])
    return Parts(text, bounds[part] - begin[text], line, n, data, first, np.diff(first, append=len(data)))


def _choose(h: np.ndarray, n: np.ndarray, text: np.ndarray, window: int = 6) -> np.ndarray:
    """Language of every sentence, -1 if unknown. Sentences of few words take the side of their neighbours in their text."""
    best = h.argmin(axis=1)
    two = np.partition(h, 1, axis=1)[:, :2] if h.shape[1] > 1 else np.c_[h, h + 1]
    best = np.where(two[:, 0] > MAX_ENTROPY, -1, best)
    unsure = (n < window) & ((two[:, 1] - two[:, 0]) < 0.25 * two[:, 1])
    sure, ask = np.flatnonzero(~unsure & (best >= 0)), np.flatnonzero(unsure & (best >= 0))
    if len(sure) and len(ask):
        at = np.searchsorted(sure, ask)
        before, behind = sure[np.maximum(at - 1, 0)], sure[np.minimum(at, len(sure) - 1)]
        far = len(n) + 1
        back = np.where((at > 0) & (text[before] == text[ask]), ask - before, far)
        on = np.where((at < len(sure)) & (text[behind] == text[ask]), behind - ask, far)
        best[ask] = np.where(np.minimum(back, on) == far, best[ask], best[np.where(back <= on, before, behind)])
    return best


def page_language(text: str, m: Model, gone: list[int] | None = None) -> tuple[str, float, int, dict[str, int]]:
    """(language, confidence, words, words by language) of a text; "und" where there are no words of any language.

    Headings and the lines ``gone`` (page furniture) are left aside where they might add a language to the page.
    """
    language, confidence, _, words, by = _judged([text], [gone or []], m)
    return language[0], float(confidence[0]), int(words[0]), {m.languages[k]: int(by[0, k]) for k in np.flatnonzero(by[0])}


def _judged(texts: list[str], gone: list[list[int]], m: Model) -> tuple[list[str], np.ndarray, list[int], np.ndarray, np.ndarray]:
    """(language, confidence, words between white space, words of its sentences, words by language) of every text."""
    parts = split(texts)
    text, n, h = parts.text, parts.n, m._entropies(parts.data, parts.first, parts.size)
    k, total = len(texts), len(m.languages)
    best = _choose(h, n, text)

    def counts() -> np.ndarray:
        at = np.flatnonzero(best >= 0)
        return np.bincount(text[at] * total + best[at], n[at], k * total).astype(np.int64).reshape(k, total)

    every, by = [len(x.split()) for x in texts], counts()
    pieces = np.array(every, np.int64)
    mixed = ((by > 0).sum(axis=1) > 1) | (2 * by.sum(axis=1) < pieces)
    mixed &= np.bincount(text, minlength=k) > 0
    kept, none = np.ones(len(n), bool), np.zeros(k, bool)
    bounds = np.searchsorted(text, np.arange(k + 1)).tolist()
    for i in np.flatnonzero(mixed).tolist():
        lines, aside = texts[i].split("\n"), set(gone[i])
        body = [j not in aside and not x.lstrip().startswith("#") for j, x in enumerate(lines)]
        pieces[i] = sum(len(x.split()) for x, b in zip(lines, body, strict=True) if b)
        own = slice(bounds[i], bounds[i + 1])
        stay = np.array(body)[parts.line[own]]
        if stay.any():
            kept[own] = stay
        else:
            none[i] = pieces[i] > 0
    if not kept.all():
        text, n, h = text[kept], n[kept], h[kept]
        best = _choose(h, n, text)
        by = counts()
    by[none] = 0
    words = np.bincount(text, n, k).astype(np.int64)
    all_ = by.sum(axis=1)
    first = by.argmax(axis=1)
    und = (all_ == 0) | (all_ < KNOWN_SHARE * np.maximum(pieces, words))
    own = np.flatnonzero(best == first[text])
    mean = np.stack([np.bincount(text[own], h[own, j] * n[own], k) for j in range(total)], axis=1) / np.maximum(1, np.bincount(text[own], n[own], k))[:, None]
    rows = np.arange(k)
    most = by[rows, first]
    least, rest = mean[rows, first].copy(), by.copy()
    mean[rows, first] = np.inf
    rest[rows, first] = -1
    with np.errstate(divide="ignore", invalid="ignore"):
        sure = np.clip(2 * (1 - least / mean.min(axis=1)) if total > 1 else np.full(k, 2.0), 0, 1)
        second = rest.max(axis=1)
        two = (second > 0) & (second >= MIXED_SHARE * all_)
        confidence = np.where(und, 0.0, sure * np.where(two, most + second, most) / all_)
    language = ["und" if u else "mixed" if t else m.languages[f] for u, t, f in zip(und.tolist(), two.tolist(), first.tolist(), strict=True)]
    return language, confidence, every, words, by


def segments(text: str, m: Model) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of the stretches of a text in one language; they cover it without gap."""
    return _segmented([text], m)[0]


def _segmented(texts: list[str], m: Model) -> list[list[tuple[int, int, str, float]]]:
    """The stretches of every text."""
    parts = split(texts)
    h = m._entropies(parts.data, parts.first, parts.size)
    best = _choose(h, parts.n, parts.text)
    out, bounds, starts = [], np.searchsorted(parts.text, np.arange(len(texts) + 1)).tolist(), parts.start.tolist()
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        if a == b:
            out.append([(0, len(text), "und", 0.0)] if text else [])
            continue
        groups = [a, *(np.flatnonzero(np.diff(best[a:b])) + a + 1).tolist(), b]
        rows = []
        for i, j in zip(groups, groups[1:], strict=False):
            code = best[i]
            mean = np.average(h[i:j], axis=0, weights=parts.n[i:j])
            sure = 0.0 if code < 0 else float(np.clip(2 * (1 - mean[code] / np.delete(mean, code).min()), 0, 1))
            rows.append((0 if i == a else starts[i], len(text) if j == b else starts[j], "und" if code < 0 else m.languages[code], round(sure, 4)))
        out.append(rows)
    return out


def label_code(label: Column) -> Column:
    """Code that a label names, "mixed", or null where it names no language."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)", 1)
    out = None
    for code, names in NAMES.items():
        hit = base.isin(names.split())
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out


def fit(labels: DataFrame, bodies: DataFrame) -> Model:
    """The model from a bounded sample of labelled pages.

    Of every language the SAMPLE_PAGES pages whose hashed file names come first are taken. Labels can be wrong, so the
    seed texts judge the sample first: only sentences that clearly need fewest phrases in the label's language are
    learned, of pages most of whose sentences do, and the seed text itself only where these are few.
    """
    known = labels.select("file", label_code(F.col("language")).alias("code")).where(F.col("code").isin(*LANGUAGES)).distinct()
    first = Window.partitionBy("code").orderBy(F.xxhash64("file"), "file")
    files = known.withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_PAGES).select("file", "code", "n")
    # At most SAMPLE_PAGES rows a language, whatever the size of the tables.
    sample = bodies.select("file", F.substring("text", 1, PAGE_CHARS).alias("text")).join(F.broadcast(files), "file").where("text IS NOT NULL").distinct().collect()
    seed = Model(SEEDS)
    pages: dict[str, list[list[str]]] = {c: [] for c in LANGUAGES}
    for r in sorted(sample, key=lambda r: (r["n"], r["file"], r["text"])):
        own = list(dict.fromkeys(p[3] for p in sentences(r["text"]) if p[4] >= 5))
        if own:
            h, k = seed.entropies(own), seed.languages.index(r["code"])
            if 2 * int((h.argmin(axis=1) == k).sum()) < len(own):
                continue  # most of the page isn't in the label's language
            clear = h[:, k] < CLEAR * np.delete(h, k, axis=1).min(axis=1)
            pages[r["code"]].append([s.strip() for s, x in zip(own, clear, strict=True) if x])
    return Model({c: _learned(pages[c], c) for c in LANGUAGES})


def _learned(pages: list[list[str]], code: str) -> str:
    """The text learned of a language: different sentences of its pages, and its seeds where they are few."""
    own: dict[str, None] = {}
    size = 0
    for page in pages:
        part = 0
        for s in page:
            if s not in own and part < TRAIN_CHARS // 8 and size < TRAIN_CHARS:
                own[s] = None
                part += len(s) + 1
                size += len(s) + 1
    return (" ".join(own) + ("" if size >= ENOUGH_CHARS else " " + SEEDS[code])).strip()


def page_languages(bodies: DataFrame, model: Model) -> DataFrame:
    """(file, language, confidence, words) of every page of ``bodies`` (file, source_url, text) with text; repeated rows give one row."""
    shared = bodies.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, texts, gone = (batch.column(k).to_pylist() for k in range(3))
            for part in codes.blocks(texts):
                out = _pages(texts[part], gone[part], shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(files[part], pa.string()), *(pa.array(x) for x in zip(*out, strict=True))], names=["file", "language", "confidence", "words"])

    return with_furniture(bodies.where("file IS NOT NULL"), ["file"], then=(run, "file string, language string, confidence double, words long")).distinct()


def _pages(texts: list[str], gone: list[list[int]], m: Model) -> list[tuple[str, float, int]]:
    language, confidence, words = _judged(texts, gone, m)[:3]
    return [(x, round(c, 4), n) for x, c, n in zip(language, confidence.tolist(), words, strict=True)]


def wrong_labels(labels: DataFrame, bodies: DataFrame) -> DataFrame:
    """(file, language): pages whose label is absent or doesn't name the language found.

    Pages of fewer than MIN_WORDS words or without words of any language are left out, as are files without text.
    """
    found = page_languages(bodies, fit(labels, bodies)).where((F.col("words") >= MIN_WORDS) & (F.col("language") != "und"))
    said = labels.select("file", label_code(F.col("language")).alias("said")).distinct()
    return found.join(said, "file").where(~F.coalesce(F.col("said") == F.col("language"), F.lit(False))).select("file", "language").distinct()


def text_segments(chunks: DataFrame, model: Model) -> DataFrame:
    """(id, segment, start, end, language, confidence) of every stretch of every chunk; repeated rows count once."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in codes.blocks(texts):
                found = zip(ids[part], _segmented(texts[part], shared.value), strict=True)
                rows = [(i, k, *s) for i, stretches in found for k, s in enumerate(stretches)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "segment", "start", "end", "language", "confidence"])

    schema = "id string, segment int, start int, end int, language string, confidence double"
    return spread(chunks.select("id", "text").where("text IS NOT NULL")).mapInArrow(run, schema).distinct()
