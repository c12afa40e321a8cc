"""Recall of the leakage search on reworded passages, answers and runs."""

import numpy as np
import pytest

from florilege.llm import leakage
from florilege.llm.common import WORD


@pytest.fixture(scope="module")
def benchmark(spark, small):
    items = spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").limit(60).cache()
    return items, [(r["item_id"], WORD.findall(r["text"].lower())) for r in items.collect()]


@pytest.mark.parametrize("every", [13, 10, 8])
def test_reworded_passages_are_found_wherever_they_begin(spark, benchmark, every):
    items, words = benchmark
    rows, want = [], {}
    for n, (item, w) in enumerate(words):
        x = [f"fremd{k}" if k % every == n % every else a for k, a in enumerate(w[n : n + 60])]
        rows.append((n, " ".join(["davor"] * (n % 29) + x + ["danach"] * 30)))
        want[n] = item
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["kind"] for r in leakage.leak_report(docs, items).collect()}
    assert all(found.get(x) == "paraphrase" for x in want.items())


def test_answers_are_found_alone(spark):
    check = "assert fold_ring_total([3, 5], 8) == 13"
    items = spark.createDataFrame([(7, "Write a function that folds the rings of a ledger. " * 4 + "\n" + check), (8, "Return the other total. " * 5)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "fremd " * 40 + check + " fremd" * 40), (2, "assert fold_ring_total([3, 5], 9) == 14")], "doc_id long, text string")
    assert [tuple(r)[:3] + (r["answers"],) for r in leakage.leak_report(docs, items).collect()] == [(1, 7, "answer", 1)]


def test_common_words_against_a_plain_table():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, (50, leakage.WIDTH)), rng.integers(-1, 9, (50, leakage.WIDTH + 2 * leakage.SHIFT))

    def plain(x, y):
        best = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, j in np.ndindex(len(x), len(y)):
            best[i + 1, j + 1] = best[i, j] + 1 if x[i] == y[j] else max(best[i, j + 1], best[i + 1, j])
        return best[-1, -1]

    want = np.array([max(plain(x, y[s : s + leakage.WIDTH]) for s in range(2 * leakage.SHIFT + 1)) for x, y in zip(a, b, strict=True)])
    assert leakage._common(a, b).tolist() == [plain(x, y) for x, y in zip(a, b, strict=True)]
    for least in (1, 12, 14):
        assert leakage._common_near(a, b, least).tolist() == np.where(want >= least, want, 0).tolist()


def test_enough_words_in_order_share_enough_terms():
    rng = np.random.default_rng(5)
    base = np.arange(leakage.WIDTH)
    for least in range(14, leakage.WIDTH + 1):
        for _ in range(40):
            a, b = (np.insert(base[np.sort(rng.permutation(leakage.WIDTH)[:least])], np.sort(rng.integers(0, least + 1, leakage.WIDTH - least)), -k) for k in (1, 2))
            both = {tuple(x) for x in zip(a, a[1:], strict=False)} & {tuple(x) for x in zip(b, b[1:], strict=False)}
            n = leakage._common(a[None], b[None])[0]
            if n >= least - 5:
                assert len(both) >= leakage._least_terms(int(n))


def test_runs_are_found_whatever_their_cosine(spark, benchmark):
    items, words = benchmark
    # Words of another item around the run turn the passage away from its own item.
    rows = [(n, " ".join(words[n - 1][1][:7] + w[40 + n : 53 + n] + words[n - 1][1][60:90])) for n, (_, w) in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {tuple(r) for r in leakage.leaked(docs, items, min_cosine=0.99).collect()}
    assert {(n, item) for n, (item, _) in enumerate(words)} <= found


def test_retrieval_alone_finds_the_runs(spark, small, benchmark):
    items, words = benchmark
    docs = spark.createDataFrame([(n, " ".join(["davor"] * (n % 29) + w[n : n + 26] + ["danach"] * 9)) for n, (_, w) in enumerate(words)], "doc_id long, text string")
    alone = {tuple(r) for r in leakage.leaked(docs, items, look_up=False).collect()}
    assert {(n, item) for n, (item, _) in enumerate(words)} <= alone
    assert alone == {tuple(r) for r in leakage.leaked(docs, items).collect()}


def test_shared_runs_against_a_plain_search():
    rng = np.random.default_rng(7)
    a = rng.integers(-2, 40, (400, leakage.WIDTH))
    b = rng.integers(-1, 40, (400, leakage.WIDTH))
    for n, (x, y) in enumerate(zip(a, b, strict=True)):
        size, i, j = 11 + n % 4, n % 12, (n * 7) % 12
        y[j : j + size] = x[i : i + size]
    runs = lambda x: {tuple(w) for w in np.lib.stride_tricks.sliding_window_view(x, leakage.RUN).tolist() if min(w) >= 0}
    want = [bool(runs(x) & runs(y)) for x, y in zip(a, b, strict=True)]
    assert leakage._share_run(a, b).tolist() == want and 0 < sum(want) < 400


def test_the_basis_has_the_singular_directions(spark, benchmark):
    items, words = benchmark
    vocabulary = {w: k for k, w in enumerate(sorted({x for _, ws in words for x in ws}))}
    ids = [np.array([vocabulary[x] for x in ws]) for _, ws in words]
    terms = np.unique(np.concatenate([leakage._codes(x, len(vocabulary)) for x in ids]))
    idf = np.ones(len(terms))
    basis = leakage.latent_basis(items, vocabulary, terms, idf, 6)
    dense = []
    for x in ids:
        starts = list(leakage._starts(len(x)))
        row, term, w = leakage._weights(leakage._lookup(leakage._codes(x, len(vocabulary)), terms), starts, idf)
        part = np.zeros((len(starts), len(terms)))
        part[row, term] = w
        dense.append(part)
    got, want = np.linalg.norm(np.concatenate(dense) @ basis, axis=0), np.linalg.svd(np.concatenate(dense), compute_uv=False)[:6]
    assert (np.diff(got) <= 1e-3).all() and got == pytest.approx(want, rel=0.05)
