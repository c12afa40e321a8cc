"""Evaluation items leaking into a corpus, by latent semantic retrieval.

Both sides are cut into overlapping passages. Their terms are pairs of neighbouring words of the benchmark,
weighted by TF-IDF with document frequencies counted over the whole corpus. A randomised SVD, its products summed
over the partitions of the benchmark, gives the latent space; every corpus passage is projected into it and
compared with all benchmark passages by cosine. Candidates are then checked: exact shared runs of words, the
longest common subsequence, and answers.

A run of 13 words has 12 neighbouring terms that all belong to the benchmark, so where only runs are asked for, a
passage without such a stretch is no candidate; that bound keeps most passages out of the matrix product and loses
nothing. Words in order with gaps break at most two terms for each word left out, so paraphrases have a bound of
their own (_least_terms). Retrieval finds runs as it finds paraphrases: near pairs are compared word by word. As no
cosine is sure to be reached by a run among foreign words, runs and answers that stand whole are looked up besides;
``look_up`` switches that off to measure what retrieval finds alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import WORD

#: Words of the shortest leaked run, of a passage, and from one passage to the next: every run lies in one passage.
RUN, WIDTH, STEP = 13, 26, 13
RANK, OVERSAMPLE, POWER = 96, 16, 2
#: Words by which a benchmark passage may be moved so that it begins as the corpus passage does.
SHIFT = STEP // 2
#: Least cosine of a candidate; runs and answers that stand whole are looked up besides. tests/llm/test_leakage.py has its recall.
MIN_COSINE = 0.3
#: Words of the shortest answer.
ANSWER = 4
#: Pairs of passages counted or compared word by word at once.
COUNTED, PAIRS = 4_000_000, 8192
#: Benchmark text handled at once; a larger benchmark is processed in so many blocks of items.
BLOCK_CHARS = 8_000_000
#: Corpus passages multiplied at once.
ROWS = 512


@dataclass
class Model:
    """What every task needs of one block of items; its size is bounded by BLOCK_CHARS."""

    words: dict[str, int]
    terms: np.ndarray  # sorted codes of word pairs
    idf: np.ndarray
    basis: np.ndarray  # terms x rank
    passages: np.ndarray  # benchmark passages x rank, normalised
    passage_item: np.ndarray
    passage_words: np.ndarray  # word ids with SHIFT more on both sides, -1 beyond the ends
    term_at: np.ndarray  # where the passages of each term begin in term_passage
    term_passage: np.ndarray
    run_hash: np.ndarray  # sorted hashes of the items' runs
    run_item: np.ndarray
    run_at: np.ndarray  # where the run begins in item_words
    item_words: np.ndarray
    answers: dict[int, list[np.ndarray]]
    answer_at: dict[tuple[int, ...], list[tuple[int, int]]]  # first ANSWER words: item and number of the answer


def _codes(ids: np.ndarray, n_words: int) -> np.ndarray:
    """Codes of neighbouring word pairs; -1 where one is unknown."""
    a, b = ids[:-1], ids[1:]
    return np.where((a < 0) | (b < 0), -1, a * np.int64(n_words) + b)


def _lookup(codes: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Index of every code among the sorted terms, or -1."""
    if not len(terms):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(terms, codes), len(terms) - 1)
    return np.where(terms[at] == codes, at, -1)


def _hashes(ids: np.ndarray, run: int = RUN) -> np.ndarray:
    """64-bit hash of every run of words."""
    n = len(ids) - run + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(29)
    out = np.zeros(n, np.uint64)
    for k in range(run):
        out = out * np.uint64(0x100000001B3) + x[k : k + n]
    return out


def _starts(n: int) -> range:
    return range(0, max(1, n - RUN + 1), STEP)


def _weights(found: np.ndarray, starts: list[int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse TF-IDF rows of passages: row, term and weight; rows are normalised."""
    row, term = [], []
    for r, s in enumerate(starts):
        t = found[s : s + WIDTH - 1]
        t = t[t >= 0]
        row.append(np.full(len(t), r))
        term.append(t)
    return _weighted(np.concatenate(row or [np.empty(0, int)]), np.concatenate(term or [np.empty(0, int)]), len(starts), idf)


def _weighted(row: np.ndarray, term: np.ndarray, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from the row and term of every occurrence."""
    key, count = np.unique(row.astype(np.int64) * (len(idf) or 1) + term, return_counts=True)
    row, term = key // (len(idf) or 1), key % (len(idf) or 1)
    w = (1 + np.log(count)) * idf[term]
    norm = np.sqrt(np.bincount(row, w * w, minlength=n))
    return row, term, w / np.maximum(norm[row], 1e-12)


def _sum_rows(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by sorted ``row``."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[first]] = np.add.reduceat(values, first, axis=0)
    return out


def document_frequencies(docs: DataFrame, words: dict[str, int], terms: np.ndarray) -> np.ndarray:
    """In how many documents each benchmark term stands, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast((words, terms))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, terms = shared.value
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for text in batch["text"]:
                if text:
                    found = _lookup(_codes(_ids(text, words), len(words)), terms)
                    np.add.at(total, np.unique(found[found >= 0]), 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "n": total[at]})

    counts = docs.select("text").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(terms), np.int64)
    df[counts["term"].to_numpy(dtype=int)] = counts["n"].to_numpy(dtype=int)
    return df


def _ids(text: str, words: dict[str, int]) -> np.ndarray:
    get = words.get
    return np.array([get(w, -1) for w in WORD.findall(text.lower())], np.int64)


def latent_basis(items: DataFrame, words: dict[str, int], terms: np.ndarray, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular directions of the benchmark's passage-term matrix, by randomised SVD.

    Every partition multiplies its own passages; the driver gets one terms x (rank + oversample) sum a partition. The
    last product gives the small matrix whose eigenvectors turn the subspace into singular directions, largest first.
    """
    size = min(rank + OVERSAMPLE, max(1, len(terms)))
    q = np.random.default_rng(20).standard_normal((len(terms), size)).astype(np.float32)
    sc = items.sparkSession.sparkContext
    for step in range(POWER + 1):
        shared = sc.broadcast((words, terms, idf, q))

        def product(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            words, terms, idf, q = shared.value
            out = np.zeros_like(q)
            for batch in batches:
                for text in batch["text"]:
                    ids = _ids(text or "", words)
                    starts = list(_starts(len(ids)))
                    row, term, w = _weights(_lookup(_codes(ids, len(words)), terms), starts, idf)
                    y = _sum_rows(row, q[term] * w[:, None].astype(np.float32), len(starts))
                    np.add.at(out, term, y[row] * w[:, None].astype(np.float32))
            yield pd.DataFrame({"part": [out.astype(np.float32).tobytes()]})

        parts = [np.frombuffer(r[0], np.float32).reshape(q.shape) for r in items.select("text").coalesce(4).mapInPandas(product, "part binary").collect()]
        total = np.sum(parts, axis=0, dtype=np.float64) if parts else np.zeros_like(q, np.float64)
        if step < POWER:
            q = np.linalg.qr(total)[0].astype(np.float32)
        else:
            small = q.T.astype(np.float64) @ total
            q = (q @ np.linalg.eigh((small + small.T) / 2)[1][:, ::-1]).astype(np.float32)
        shared.unpersist()
    return q[:, : min(rank, size)]


def fit(docs: DataFrame, items: DataFrame, rank: int = RANK) -> Model:
    """The model of one bounded block of items."""
    rows = [(r["item_id"], WORD.findall((r["text"] or "").lower()), r["text"] or "") for r in items.select("item_id", "text").distinct().collect() if r["item_id"] is not None]
    rows.sort(key=lambda r: (r[0], r[2]))
    words = {w: k for k, w in enumerate(sorted({w for _, ws, _ in rows for w in ws}))}
    ids = [np.array([words[w] for w in ws], np.int64) for _, ws, _ in rows]
    terms = np.unique(np.concatenate([_codes(x, len(words)) for x in ids if len(x) > 1] or [np.empty(0, np.int64)]))
    df = document_frequencies(docs, words, terms)
    n = max(int(df.max(initial=0)), docs.count())
    idf = np.log((n + 1) / (df + 1)) + 1
    basis = latent_basis(items, words, terms, idf, rank)
    latent, of, runs = [], [], []
    width = []
    for (item, _, _), x in zip(rows, ids, strict=True):
        starts = list(_starts(len(x)))
        row, term, w = _weights(_lookup(_codes(x, len(words)), terms), starts, idf)
        latent.append(_sum_rows(row, basis[term] * w[:, None].astype(np.float32), len(starts)))
        of += [item] * len(starts)
        x = np.pad(x, (SHIFT, WIDTH + SHIFT), constant_values=-1)
        width += [x[s : s + WIDTH + 2 * SHIFT] for s in starts]
    z = np.concatenate(latent) if latent else np.zeros((0, basis.shape[1]), np.float32)
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    offset = 0
    for (item, _, _), x in zip(rows, ids, strict=True):
        h = _hashes(x)
        runs.append((h, np.full(len(h), item), offset + np.arange(len(h))))
        offset += len(x)
    hashes, run_item, run_at = (np.concatenate(v) for v in zip(*runs, strict=True)) if runs else (np.empty(0, np.uint64), np.empty(0, int), np.empty(0, int))
    order = np.argsort(hashes, kind="stable")
    answers, answer_at = {}, {}
    for item, _, text in rows:
        checks = [_ids(line, words) for line in text.splitlines() if line.lstrip().startswith("assert ") and "==" in line]
        for x in checks:
            if len(x) >= ANSWER:
                answer_at.setdefault(tuple(x[:ANSWER].tolist()), []).append((item, len(answers.setdefault(item, []))))
                answers[item].append(x)
    passage_words = np.array(width, np.int64).reshape(-1, WIDTH + 2 * SHIFT)
    near = [np.unique(t[t >= 0]) for t in (_lookup(_codes(x, len(words)), terms) for x in passage_words)]
    term, passage = (np.concatenate(near), np.repeat(np.arange(len(near)), [len(t) for t in near])) if near else (np.empty(0, int), np.empty(0, int))
    by_term = np.argsort(term, kind="stable")
    term_at = np.searchsorted(term[by_term], np.arange(len(terms) + 1))
    return Model(words, terms, idf, basis, z.astype(np.float32), np.array(of, np.int64), passage_words, term_at, passage[by_term], hashes[order], run_item[order], run_at[order], np.concatenate(ids) if ids else np.empty(0, np.int64), answers, answer_at)


def _stretches(found: np.ndarray, starts: list[int]) -> np.ndarray:
    """Whether each passage has RUN - 1 neighbouring terms of the benchmark."""
    gap = np.concatenate([[0], np.cumsum(found < 0)])
    whole = np.zeros(len(found) + 1, bool)
    n = len(found) - (RUN - 1) + 1
    if n > 0:
        whole[:n] = gap[RUN - 1 :] == gap[:n]
    first = np.concatenate([[0], np.cumsum(whole)])
    s = np.array(starts)
    return first[np.minimum(s + WIDTH - RUN + 1, len(whole))] > first[np.minimum(s, len(whole))]


def _least_terms(least_common: int | None) -> int:
    """Terms that a passage shares with the benchmark at least if ``least_common`` of its words, or a run, stand there in order.

    So many words have one link less between them, and every word left out, on either side, breaks one at most.
    """
    return 1 if least_common is None else max(0, min(RUN - 1, least_common - 1 - 2 * (WIDTH - least_common)))


def _near(row: np.ndarray, term: np.ndarray, n: int, m: Model, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the ``n`` corpus passages and the benchmark passages that share ``least`` terms; ``row`` is sorted."""
    p, k = [], []
    width = len(m.passages)
    size = max(1, COUNTED // max(1, width))
    for first in range(0, n, size):
        part = slice(*np.searchsorted(row, [first, first + size]))
        at, count = m.term_at[term[part]], m.term_at[term[part] + 1] - m.term_at[term[part]]
        place = np.repeat(at - np.cumsum(count) + count, count) + np.arange(count.sum())
        shared = np.bincount(np.repeat((row[part] - first) * width, count) + m.term_passage[place], minlength=min(size, n - first) * width)
        found = np.flatnonzero(shared >= least)
        p.append(found // width + first)
        k.append(found % width)
    return np.concatenate(p), np.concatenate(k)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row pair, rows of ``a`` as bits; -1 never matches."""
    match = np.zeros(b.shape, np.uint64)
    for i in range(a.shape[1]):
        match |= ((a[:, i : i + 1] == b) & (b >= 0)).astype(np.uint64) << np.uint64(i)
    return _in_order(match, a.shape[1])


def _in_order(match: np.ndarray, width: int) -> np.ndarray:
    """The same from the places of each word of ``b`` in ``a``: a bit is lost for each word of the subsequence."""
    v = np.full(len(match), (1 << width) - 1, np.uint64)
    for j in range(match.shape[1]):
        u = v & match[:, j]
        v = (v + u) | (v - u)
    return width - np.bitwise_count(v & np.uint64((1 << width) - 1)).astype(np.int64)


def _common_near(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Longest common subsequence of each passage with WIDTH neighbouring words of ``b``, or 0 for less than ``least``."""
    out = np.zeros(len(a), np.int64)
    match = np.zeros(b.shape, np.uint64)
    for i in range(a.shape[1]):
        match |= ((a[:, i : i + 1] == b) & (b >= 0)).astype(np.uint64) << np.uint64(i)
    near = np.flatnonzero(np.bitwise_count(np.bitwise_or.reduce(match, axis=1)) >= least)
    near = near[_in_order(match[near], a.shape[1]) >= least]
    for s in range(b.shape[1] - WIDTH + 1):
        out[near] = np.maximum(out[near], _in_order(match[near, s : s + WIDTH], a.shape[1]))
    return np.where(out >= least, out, 0)


def _words(q: int, at: list[int], xs: list[np.ndarray]) -> np.ndarray:
    """Words of a corpus passage, -2 beyond the end."""
    x = xs[q][at[q] : at[q] + WIDTH]
    return np.pad(x, (0, WIDTH - len(x)), constant_values=-2)


def _share_run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the passages of each row pair have a run of neighbouring words in common; negative words never match."""
    out = np.zeros(len(a), bool)
    # A run takes in one of the two middle words.
    half = WIDTH // 2
    near = np.flatnonzero(((a[:, half - 1 : half] == b) & (b >= 0)).any(axis=1) | ((a[:, half : half + 1] == b) & (b >= 0)).any(axis=1))
    a, b = a[near].astype(np.int32), b[near].astype(np.int32)
    match = np.zeros((len(near), WIDTH + RUN), np.uint32)  # bit i at j: word i of a is word j of b
    for i in range(WIDTH):
        match[:, :WIDTH] |= ((a[:, i : i + 1] == b) & (b >= 0)).astype(np.uint32) << np.uint32(i)
    after = lambda x, n: np.pad(x[:, n:], ((0, 0), (0, n))) >> np.uint32(n)
    two = match & after(match, 1)
    four = two & after(two, 2)
    out[near] = (four & after(four, 4) & after(four, 8) & after(match, RUN - 1)).any(axis=1)
    return out


def _shared_runs(p: np.ndarray, k: np.ndarray, at: list[int], xs: list[np.ndarray], m: Model) -> set[tuple[int, int]]:
    """(passage, item) of the near pairs that share a run, compared word by word."""
    out = set()
    if not len(p):
        return out
    used, row = np.unique(p, return_inverse=True)
    words = np.array([_words(q, at, xs) for q in used.tolist()])
    for c in range(0, len(p), PAIRS):
        a, b = p[c : c + PAIRS], k[c : c + PAIRS]
        found = _share_run(words[row[c : c + PAIRS]], m.passage_words[b, SHIFT : SHIFT + WIDTH])
        out |= set(zip(a[found].tolist(), m.passage_item[b[found]].tolist(), strict=True))
    return out


def _runs(ids: np.ndarray, m: Model) -> list[tuple[int, int]]:
    """(where, item) of every run of a document that stands in an item."""
    h = _hashes(ids)
    lo, hi = np.searchsorted(m.run_hash, h, "left"), np.searchsorted(m.run_hash, h, "right")
    out = []
    for i in np.flatnonzero(hi > lo):
        out += {(int(i), int(m.run_item[r])) for r in range(lo[i], hi[i]) if np.array_equal(m.item_words[m.run_at[r] : m.run_at[r] + RUN], ids[i : i + RUN])}
    return out


def _answers(ids: np.ndarray, m: Model) -> list[tuple[int, int, int]]:
    """(where, item, number) of every answer that stands whole in a document."""
    out = []
    for i in np.flatnonzero(ids == m.words.get("assert", -2)).tolist():
        for item, k in m.answer_at.get(tuple(ids[i : i + ANSWER].tolist()), ()):
            if np.array_equal(m.answers[item][k], ids[i : i + len(m.answers[item][k])]):
                out.append((i, item, k))
    return out


def _search(batches: Iterator[pd.DataFrame], m: Model, min_cosine: float, least_common: int | None, runs_only: bool, look_up: bool = True) -> Iterator[pd.DataFrame]:
    """(doc_id, item_id, cosine, run, common, answers) of candidates, the best of each document and item."""
    least = _least_terms(least_common)
    for batch in batches:
        docs, at, xs, seen, n = [], [], [], [], 0
        stretches = []  # whether a passage can hold a run
        whole = []  # passage, item, words of the run and number of answers, of what stands whole
        out = []

        def flush() -> None:
            nonlocal n
            if n:
                row, term = (np.concatenate(x) for x in zip(*seen, strict=True))
                p, k = (np.empty(0, int), np.empty(0, int)) if runs_only else _near(row, term, n, m, least)
                # Only passages that can be part of a result go into the matrix product.
                runs = np.flatnonzero(np.concatenate(stretches))
                kept = np.unique(np.concatenate([p, runs, np.array([x[0] for x in whole], int)]))
                if len(kept):
                    place = np.full(n, -1)
                    place[kept] = np.arange(len(kept))
                    used = place[row] >= 0
                    row, term, w = _weighted(place[row[used]], term[used], len(kept), m.idf)
                    z = _sum_rows(row, m.basis[term] * w[:, None].astype(np.float32), len(kept))
                    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
                    cos = z @ m.passages.T
                    close = cos[place[p], k] >= min_cosine
                    p, k = p[close], k[close]
                    if len(p):
                        out.append(_compared(p, k, cos[place[p], k], docs, at, xs, m, least_common))
                    close = np.nonzero(cos[place[runs]] >= min_cosine)
                    known = {x[:2] for x in whole if x[2]}
                    whole.extend((q, i, RUN, 0) for q, i in _shared_runs(runs[close[0]], close[1], at, xs, m) - known)
                    if whole:
                        p, item, run, answers = (np.array(x) for x in zip(*whole, strict=True))
                        best = [cos[place[q], m.passage_item == i].max() for q, i in zip(p, item, strict=True)]
                        out.append(pd.DataFrame({"doc_id": [docs[q] for q in p], "item_id": item, "cosine": np.array(best, float), "run": run, "common": run, "answers": answers}))
            n = 0
            for x in (docs, at, xs, seen, stretches, whole):
                x.clear()

        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            if not text or pd.isna(doc):
                continue
            ids = _ids(text, m.words)
            found = _lookup(_codes(ids, len(m.words)), m.terms)
            starts = np.array(_starts(len(ids)))
            ok = stretch = _stretches(found, starts)
            answers = []
            if not runs_only:
                answers = _answers(ids, m) if look_up else []
                first = np.concatenate([[0], np.cumsum(found >= 0)])
                ok = first[np.minimum(starts + WIDTH - 1, len(found))] - first[np.minimum(starts, len(found))] >= least
                ok[[min(i // STEP, len(starts) - 1) for i, _, _ in answers]] = True
            good = starts[ok]
            if not len(good):
                continue
            hits = {(i // STEP * STEP, item): (RUN, 0) for i, item in (_runs(ids, m) if look_up and stretch.any() else ())}
            numbers = {}
            for i, item, k in answers:
                numbers.setdefault(item, (min(i // STEP, len(starts) - 1) * STEP, set()))[1].add(k)
            for item, (s, ks) in numbers.items():
                hits[s, item] = hits.get((s, item), (0, 0))[0], len(ks)
            padded = np.concatenate([found, np.full(WIDTH, -1)])
            for k in range(0, len(good), ROWS):
                part = good[k : k + ROWS]
                t = padded[part[:, None] + np.arange(WIDTH - 1)]
                row, place = np.nonzero(t >= 0)
                seen.append((row + n, t[row, place]))
                stretches.append(stretch[ok][k : k + ROWS])
                docs += [doc] * len(part)
                at += part.tolist()
                xs += [ids] * len(part)
                if hits:
                    where = {s: n + j for j, s in enumerate(part.tolist())}
                    whole += [(where[s], item, run, count) for (s, item), (run, count) in hits.items() if s in where]
                n += len(part)
                if n >= ROWS:
                    flush()
        flush()
        if out:
            best = pd.concat(out).groupby(["doc_id", "item_id"], as_index=False).max()
            yield best.astype({"doc_id": "int64", "item_id": "int64"})


def _compared(p, k, cos, docs, at, xs, m: Model, least_common: int | None) -> pd.DataFrame:
    """Candidates, with ``least_common`` only those whose longest common subsequence has so many words."""
    common = np.zeros(len(p), np.int64)
    if least_common is not None:
        passage = {q: _words(q, at, xs) for q in np.unique(p)}
        for c in range(0, len(p), PAIRS):
            part = slice(c, c + PAIRS)
            common[part] = _common_near(np.array([passage[q] for q in p[part]]), m.passage_words[k[part]], max(1, least_common))
        p, k, cos, common = (x[common > 0] for x in (p, k, cos, common))
    frame = pd.DataFrame({"p": p, "item_id": m.passage_item[k], "cosine": cos.astype(float), "common": common}).groupby(["p", "item_id"], as_index=False).max()
    return pd.DataFrame({"doc_id": [docs[q] for q in frame["p"]], "item_id": frame["item_id"], "cosine": frame["cosine"], "run": 0, "common": frame["common"], "answers": 0})


def _blocks(items: DataFrame, block_chars: int) -> list[DataFrame]:
    """The items in blocks whose texts have about ``block_chars`` characters at most."""
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(chars // block_chars) + 1
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def leaks(docs: DataFrame, items: DataFrame, min_cosine: float = MIN_COSINE, rank: int = RANK, least_common: int | None = None, runs_only: bool = False, block_chars: int = BLOCK_CHARS, look_up: bool = True) -> DataFrame:
    """(doc_id, item_id, cosine, run, common, answers): candidates of latent retrieval with their checks.

    ``run`` is 13 if a run of 13 words is shared, else 0; ``common`` is the longest common subsequence of two passages,
    if ``least_common`` is set, and then of so many words at least, or 0 beside a run or an answer; ``answers`` is the number of the item's answers that stand
    whole in the document. With ``runs_only`` only shared runs are sought. Without ``look_up`` retrieval alone decides. Null ids and null or empty texts never match; repeated rows count once.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    out = None
    for block in _blocks(items, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(fit(docs, block, rank))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            return _search(batches, shared.value, min_cosine, least_common, runs_only, look_up)

        part = docs.mapInPandas(search, "doc_id long, item_id long, cosine double, run long, common long, answers long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("cosine", "run", "common", "answers")])


def leaked(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id): documents that share a run of 13 words with an item."""
    return leaks(docs, items, runs_only=True, **options).where(F.col("run") >= RUN).select("doc_id", "item_id")


def leak_report(docs: DataFrame, items: DataFrame, min_common: int = 21, **options) -> DataFrame:
    """Leaked items by document: ``kind`` is exact for a shared run, else paraphrase for enough common words in order, else answer."""
    rows = leaks(docs, items, least_common=min_common, **options).where((F.col("run") >= RUN) | (F.col("common") >= min_common) | (F.col("answers") > 0))
    kind = F.when(F.col("run") >= RUN, "exact").when(F.col("common") >= min_common, "paraphrase").otherwise("answer")
    return rows.select("doc_id", "item_id", kind.alias("kind"), F.round("cosine", 3).alias("cosine"), "common", "answers")
