import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from florilege.functions import questions
from florilege.operators import blocks, chunks, glossary, retrieval
from florilege.plans import guided

DOCS = [(1, "Ferry ticket office opens"), (2, "ticket ticket ticket"), (3, None), (4, ""), (5, "opens the ferry at noon with a ticket")]


def test_bm25_against_a_plain_computation(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    queries = spark.createDataFrame([(7, "ferry ticket ticket"), (8, "nothing"), (9, None)], "q long, text string")
    got = {(r["q"], r["id"]): r["score"] for r in retrieval.bm25(retrieval.postings(docs, "id", "text"), queries, "id", "q", "text", 5).collect()}
    words = {i: re.findall(r"[^\W_]{2,}", t.lower()) for i, t in DOCS if t}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    want = {}
    for i, w in words.items():
        tf, s = Counter(w), 0.0
        for t in {"ferry", "ticket"} & set(w):
            df = sum(t in x for x in words.values())
            s += math.log1p((n - df + 0.5) / (df + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean))
        if s:
            want[7, i] = round(s, 6)
    assert got == pytest.approx(want)


def test_dense_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    x = np.random.default_rng(3).normal(size=(40, 5))
    x[11] = x[10]
    rows = [(i, [float(v) for v in x[i]]) for i in range(40)] + [(90, None), (91, [0.0] * 5), (92, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    out = retrieval.dense_topk(df, df.where("id % 20 = 0").withColumnRenamed("id", "q"), "id", "q", "v", 6).collect()
    z = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 20):
        s = np.round(z @ z[q], 6)
        want = sorted(range(40), key=lambda i: (-s[i], str(i)))[:6]
        assert [r["id"] for r in sorted((r for r in out if r["q"] == q), key=lambda r: r["rank"])] == want
    assert {r["q"] for r in out} == {0, 20}


def test_fusion_is_the_same_whatever_the_order_of_the_arms(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q long, id string, rank long")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "q long, id string, rank long")
    one, two = ({tuple(r) for r in retrieval.fuse(arms, "q", "id", 5).collect()} for arms in ([a, b], [b, a]))
    assert one == two
    assert sorted((r[1], r[4]) for r in one) == [("x", 2), ("y", 1), ("z", 3)]


def test_caps_and_merging(spark):
    hits = spark.createDataFrame([(1, str(i), "u" if i < 4 else None, i) for i in range(1, 8)], "q long, id string, url string, rank long")
    out = retrieval.capped(hits, "q", "url", 2, 3).orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in out] == [("1", 1), ("2", 2), ("4", 3)]
    base = spark.createDataFrame([(1, "a", "u", 2.0, 1)], "q long, id string, url string, score double, rank long")
    extra = spark.createDataFrame([(1, "a", "u", 9.0), (1, "b", "u", 8.0), (1, "c", "w", 7.0)], "q long, id string, url string, score double")
    merged = retrieval.merged(base, extra, "q", "id", ["url"], 5).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in merged] == [("c", 7.0), ("a", 2.0)]


PAGE = [(f"c{i}", "u", i, "A" if i < 3 else "B", f"t{i}") for i in range(6)] + [("d0", "w", 0, None, "d")]


def test_neighbours(spark):
    rows = spark.createDataFrame(PAGE, "id string, source_url string, chunk_index int, section_heading string, text string")
    hits = spark.createDataFrame([(1, "c0"), (1, "d0"), (2, "c3")], "query_id long, id string")
    near = {(r["query_id"], r["id"], r["near_id"], r["distance"]) for r in retrieval.neighbours(hits, rows).collect()}
    assert near == {(1, "c0", "c1", 1), (2, "c3", "c2", -1), (2, "c3", "c4", 1)}
    wide = {(r["id"], r["near_id"]) for r in retrieval.neighbours(hits, rows, 2, True).collect()}
    assert wide == {("c0", "c1"), ("c0", "c2"), ("c3", "c1"), ("c3", "c2"), ("c3", "c4"), ("c3", "c5")}
    texts = retrieval.augmented(hits.withColumn("rank", F.lit(1)).join(rows.select("id", "text"), "id"), rows).collect()
    assert {r["id"]: r["text"] for r in texts} == {"c0": "t0\n\nt1", "d0": "d", "c3": "t2\n\nt3\n\nt4"}
    plans = spark.createDataFrame([(1, "full_section"), (2, "")], "query_id long, requested_action string")
    ranked = hits.where("id <> 'd0'").withColumn("rank", F.lit(1).cast("long"))
    more = {(r["query_id"], r["id"], r["rank"]) for r in guided.follow_up(ranked, rows, plans).collect()}
    assert more == {(1, "c0", 1), (1, "c1", 2), (1, "c2", 3), (2, "c3", 1)}


def test_chunking(spark):
    text = "Vorwort\n# A\nEins.\n## B\n" + "Wort " * 500 + "\n```\n# kein Kopf\n```\n# C\n" + "x" * 2500
    df = spark.createDataFrame([("f", "https://a.example/f1/x", text), ("g", "u", None), ("h", "u", "  ")], "file string, source_url string, body string")
    out = chunks.chunk(df, "body", ["file", "source_url"]).orderBy("chunk_index").collect()
    assert all(len(r["text"]) <= 1000 and r["text"].strip() for r in out)
    assert [r["chunk_index"] for r in out] == list(range(len(out))) and {r["total_chunks"] for r in out} == {len(out)}
    assert {r["section_heading"] for r in out} == {"", "A", "A > B", "C"} and {r["faculty"] for r in out} == {"Fakultät I"}
    assert sum(r["text"].count("x") for r in out if r["section_heading"] == "C") >= 2500
    pieces = chunks.split("Wort " * 500)
    assert all(pieces[k].endswith("Wort") and len(pieces[k]) <= 1000 for k in range(len(pieces)))


def test_latest(spark):
    rows = [("a", "2025-01-01", 1), ("a", "2025-03-01", 2), ("a", None, 3), ("a", "kaputt", 4), ("b", None, 5)]
    out = chunks.latest(spark.createDataFrame(rows, "id string, crawl_date string, n long")).collect()
    assert {(r["id"], r["n"]) for r in out} == {("a", 2), ("b", 5)}


def test_questions(spark):
    asked = [
        (1, "Was bedeutet BPO?"), (2, "Prüfungsanmeldung Fak1"), (3, "Wer ist Frau Dr. Muster?"), (4, "Hat Robotik ein Vorpraktikum und wie lange dauert der Studiengang?"), (5, "Online-Antrag hochladen"), (6, None),
        (7, "Modul INF-204 und F2"), (8, "Kontakt Fakultät ii"),
    ]
    rows = {r["id"]: r for r in questions.variants(questions.assess(spark.createDataFrame(asked, "id long, query string"))).collect()}
    assert rows[1]["intents"] == ["definition"] and rows[1]["retrieval_terms"] == ["BPO"]
    assert rows[2]["detected_faculties"] == ["Fakultät I"] and rows[2]["codes"] == [] and "exam_registration" in rows[2]["intents"]
    assert rows[3]["intents"] == ["person_lookup"] and "Muster" in rows[3]["variants"][1]
    assert "study_program_facts" in rows[4]["intents"]
    assert rows[5]["broad"] and "workflow" in rows[5]["intents"]
    assert rows[6]["intents"] == [] and rows[6]["variants"] == []
    assert rows[7]["codes"] == ["INF-204"] and rows[7]["detected_faculties"] == ["Fakultät II"]
    assert rows[8]["detected_faculties"] == ["Fakultät II"] and "contact" in rows[8]["intents"]
    assert all(len(r["variants"]) <= 10 for r in rows.values())


def _osa(a: str, b: str) -> int:
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_similar_terms_against_all_pairs(spark):
    words = ["ICMS", "ICSM", "iCM", "BPO", "BPOs", "PBO", "abcd", "abdc", "badc", "x", "über", "ueber"]
    known = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "term string, mentions long")
    got = {(r["asked"], r["term"]) for r in glossary.similar_terms(spark.createDataFrame([(w,) for w in words], "asked string"), known, 99).collect()}
    fold = lambda w: w.lower().replace("ü", "ue")
    assert got == {(a, b) for a in words for b in words if fold(a) != fold(b) and _osa(fold(a), fold(b)) <= 1}


def test_glossary(spark):
    text = "# Legende\n**BPO** (Besonderer Teil)\nText zu K90 (Klausur 90 Minuten) hier\n\nEin ECTS Punkt hat einen Workload von 30 Stunden.\nBPO (besonders)"
    rows = spark.createDataFrame([("a", text, "u", "T", ""), ("b", text, "u", "T", ""), ("c", None, "w", None, None)], "id string, text string, source_url string, title string, faculty string")
    entries = glossary.entries(rows)
    found = {(r["term"], r["meaning"]): r for r in entries.collect()}
    assert {k[0] for k in found} == {"BPO", "K90", "ECTS"} and found["BPO", "Besonderer Teil"]["heading"] == "Legende"
    asked = questions.assess(spark.createDataFrame([(1, "Was bedeutet BPO?"), (2, "Kontakt")], "query_id long, query string")).withColumn("phrases", F.col("retrieval_terms"))
    hits = glossary.lookup(entries, asked).collect()
    assert {r["term"] for r in hits} == {"BPO"} and min(r["score"] for r in hits) >= 6.0 + 2.8
    context = glossary.context_terms(spark.createDataFrame([(1, 1, "iCMS", "", "iCMS hilft")], "query_id long, rank long, title string, section_heading string, text string"))
    fixed = glossary.corrections(spark.createDataFrame([(1, "iCSM")], "query_id long, asked string"), context).collect()
    assert [(r["asked"], r["matched"]) for r in fixed] == [("iCSM", "iCMS")]


def test_guided_search(spark):
    rows = [("a", "u", "BPO", "BPO bedeutet Pruefungsordnung"), ("b", "u", "", "die BPO steht in der Legende"), ("c", "w", "", "Mensa und Bibliothek"), ("d", "u", "", "BPO BPO")]
    df = spark.createDataFrame(rows, "id string, source_url string, title string, text string").withColumn("faculties", F.array().cast("array<string>"))
    df = df.withColumn("search_text", F.lower(F.concat_ws(" ", "title", "text")))
    asked = questions.variants(questions.assess(spark.createDataFrame([(1, "Was bedeutet BPO?"), (2, "Mensa")], "query_id long, query string")))
    out = guided.search(df, asked).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in out if r["query_id"] == 2] == ["c"]
    assert [r["id"] for r in out if r["query_id"] == 1][0] == "a" and sum(r["query_id"] == 1 for r in out) == 2
    plan = guided.planned_action(spark.createDataFrame([("Was ist K90?", [], []), ("heute offen?", [], []), ("Unterschied", ["Fakultät I"], []), ("x", [], [])], "query string, detected_faculties array<string>, present_faculties array<string>"))
    assert [r["requested_action"] for r in plan.collect()] == ["full_section", "", "new_search", ""]


def test_bm25_without_an_index_shuffles_no_postings(spark, monkeypatch):
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(f"Wort{i}" for i in rng.integers(0, 60, n))
    docs = spark.createDataFrame([(i, text(int(rng.integers(1, 40)))) for i in range(90)] + [(90, None), (91, ""), (92, "x !")], "id long, text string").repartition(3)
    queries = spark.createDataFrame([(i, text(8)) for i in range(12)] + [(12, None), (13, "fremd")], "q long, text string")
    want = sorted(retrieval.bm25(retrieval.postings(docs, "id", "text"), queries, "id", "q", "text", 4).collect())
    monkeypatch.setattr(blocks, "BLOCK_CHARS", 500)  # two blocks of queries
    monkeypatch.setattr(blocks, "WAITING", 5)
    got = retrieval.bm25_topk(docs, queries, "id", "q", "text", 4)
    assert sorted(got.collect()) == want
    assert "Join" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and plan.count("MapInArrow") == 2


def test_both_arms_in_blocks_keep_the_best_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    monkeypatch.setattr(blocks, "SPARSE_BLOCK", 9)
    monkeypatch.setattr(blocks, "WAITING", 5)
    monkeypatch.setattr(blocks, "PAIRS", 4)
    rng = np.random.default_rng(8)
    rows = [(f"k{i:02}", [float(v) for v in rng.integers(-1, 2, 3)], [int(v) for v in rng.integers(0, 6, 4)], [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(40)]
    rows += [("x0", None, None, None), ("x1", [1.0, None, 1.0], [1, None], [None, 1.0]), (None, [1.0] * 3, [1], [1.0]), ("x2", [1.0] * 4, [1, 2], [2.0])]
    df = spark.createDataFrame(rows, "id string, vector array<double>, i array<int>, v array<double>").repartition(4)
    asked = df.where("id < 'k09' OR id LIKE 'x%'").withColumnRenamed("id", "q")
    dot = {}
    for a, _, i, v in rows:
        for b, _, j, w in rows:
            if a and b and (a < "k09" or a > "x") and i and j:
                s = sum(x * y for m, x in zip(i, v, strict=False) for n, y in zip(j, w, strict=False) if None not in (m, n, x, y) and m == n)
                if s > 0:
                    dot.setdefault(a, []).append((-s, b))
    sparse = retrieval.sparse_dot(df, asked, "id", "q", "i", "v", 5)
    assert sorted((r["q"], -r["score"], r["id"]) for r in sparse.collect()) == sorted((a, *x) for a, xs in dot.items() for x in sorted(xs)[:5])
    # Each task gives only the best of a query over every block of rows that it met.
    dense = blocks.dense_scores(df, asked, "id", "q", "vector", 5, 7, parts=1).groupBy("q").count().collect()
    assert dense and max(r["count"] for r in dense) == 5
