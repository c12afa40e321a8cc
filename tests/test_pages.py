from collections import Counter

from pyspark.sql import functions as F

from florilege.functions import text as T
from florilege.operators import crawl, pages, store

TEXTS = ["", "eins zwei  drei vier", "a-b c_d --- ä", "| a | b |\n|---|:-:|\n| 1 | 2 |", "x y\r\nz", "🙂 und der die das für"]


def test_counts(spark):
    c = F.col("t")
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", T.word_count(c).alias("w"), T.table_lines(c).alias("n"), F.size(T.lines(c)).alias("l")).collect()
    for r in rows:
        assert r["w"] == len(r["t"].split())
        assert r["l"] == max(1, len(r["t"].splitlines()))
    assert rows[3]["n"] == 1


def test_occurrences_and_language(spark):
    german, english = T.marker_counts(F.col("t"), F.lit(""))
    texts = ["der und die und das", "the course and the deadline", "the und", "nichts", "und und und"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", german.alias("g"), english.alias("e"), T.marker_language(german, english).alias("l")).collect()
    for r in rows:
        sample = f" {r['t']}  "
        assert r["g"] == sum(sample.count(m) for m in T.GERMAN)
        assert r["e"] == sum(sample.count(m) for m in T.ENGLISH)
    assert [r["l"] for r in rows] == ["de", "en", "mixed", "unknown", "de"] or rows[4]["g"] == 1


def test_repeated_short_lines(spark):
    text = "Menü\n- menü\n3. Menü\nmenü\nKontakt\nKontakt\nx\n" + "lang " * 20
    want = Counter(x for x in (line.strip("#*-0123456789. ").lower() for line in text.split("\n")) if 3 <= len(x) <= 60)
    row = spark.createDataFrame([(text,), (None,)], "t string").select(pages.repeated_short_lines(F.coalesce("t", F.lit("")))).collect()
    assert row[0][0] == sum(n for n in want.values() if n >= 3) == 4
    assert row[1][0] == 0


def test_quality(spark):
    body = "Die Ordnung und der Antrag für das Studium " * 10
    rows = [
        ("https://www.hs-nordfurt.example/a", "Titel", body, "html", "", False), ("https://www.hs-nordfurt.example/b", "404 Not Found", body, "html", "", False), ("", "", "", "html", "", True),
        ("https://www.hs-nordfurt.example/c", "", "the course and the deadline of the course " * 9, "html", "", False), (None, None, None, None, None, None),
        ("https://www.hs-nordfurt.example/swagger/x", "", body, "html", "", False),
    ]
    df = spark.createDataFrame(rows, "source_url string, title string, body string, content_type string, faculty string, duplicate boolean")
    out = pages.assess(df, "source_url", "title", "body", "content_type", "faculty", "duplicate").collect()
    assert (out[0]["score"], out[0]["keep"], out[0]["kept"], out[0]["document_kind"]) == (100, True, True, "regulation")
    assert out[1]["reasons"] == "fehlerseitenmuster:404_not_found" and not out[1]["keep"]
    assert out[2]["score"] == 0 and "duplikat_aeltere_version" in out[2]["reasons"]
    assert (out[3]["language"], out[3]["keep"], out[3]["kept"]) == ("en", True, False)
    assert out[4]["score"] == 0 and out[4]["language"] == "unknown"
    assert out[5]["source_family"] == "technical_api_docs" and not out[5]["keep"]
    assert pages.assess(df, "source_url", "title", "body", "content_type", "faculty", "duplicate").where("kept AND score > 50").count() == 1


def test_cleaning(spark):
    body = (
        "# T\nscrollen für mehr infos!\n[a](/x?utm_source=1) und [b](https://other.example/y) ![i](https://other.example/z.png)\n<https://www.hs-nordfurt.example/q/>\n"
        "siehe https://www.hs-nordfurt.example/w/). Ende\n\n\n\nEnde  x\n![bild](/fileadmin/_processed_/a.png)"
    )
    df = spark.createDataFrame([("f", "https://www.hs-nordfurt.example/p", body), ("g", None, None), ("h", "", "ohne Verweise"), (None, "", "x")], "file string, url string, text string")
    out = {r["file"]: r for r in pages.clean_bodies(df, "file", "url", "text").collect()}
    assert set(out) == {"f", "g", "h"}
    f = out["f"]
    assert "[a](https://www.hs-nordfurt.example/x) und b" in f["text"] and "other.example" not in f["text"]
    assert "<https://www.hs-nordfurt.example/q>" in f["text"] and "https://www.hs-nordfurt.example/w). Ende" in f["text"]
    assert "scrollen" not in f["text"] and "_processed_" not in f["text"] and "\n\n\n" not in f["text"]
    assert (f["blocked_links_removed"], f["removed_noise_lines"]) == (3, 2)
    assert out["g"]["text"] is None and out["h"]["text"] == "ohne Verweise"


def test_versions(spark):
    files = ["2025-01-01_a.md", "2025-02-01_a.md", "2025-01-01_b.md", "solo.md", None]
    rows = pages.older_versions(spark.createDataFrame([(f,) for f in files], "file string")).collect()
    assert {r["file"] for r in rows if r["duplicate"]} == {"2025-01-01_a.md"} and len(rows) == 5


def test_upsert_is_the_same_in_one_or_more_batches(spark):
    from datetime import datetime as D

    schema = "normalized_url string, decision string, reason string, first_seen timestamp, last_seen timestamp, first_source string, last_source string, seen_count long"
    a = [("u", "block", "r", D(2025, 1, 1), D(2025, 1, 2), "s1", None, 1), ("v", "allow", "r", D(2025, 1, 1), None, "s1", "s1", 2)]
    b = [("u", "allow", "q", D(2024, 1, 1), D(2025, 3, 1), "s0", "s2", 4), ("u", "allow", "q", D(2024, 1, 1), D(2025, 3, 1), "s0", "s2", 1)]
    one, two = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    at_once = {tuple(r) for r in store.upsert(one, two).collect()}
    assert at_once == {tuple(r) for r in store.upsert(store.upsert(one), two).collect()}
    u = next(r for r in at_once if r[0] == "u")
    assert u[1] == "allow" and u[3] == D(2024, 1, 1) and u[4] == D(2025, 3, 1) and u[7] == 6
    assert store.lookup(store.upsert(one), spark.createDataFrame([("v",), ("w",)], "normalized_url string")).count() == 2


def test_frontier_against_a_plain_search(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("d", "d"), ("d", None)]
    out = crawl.frontier(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("a",), ("a",), (None,)], "url string")).collect()
    assert {(r["url"], r["depth"], r["parent"]) for r in out} == {("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "c")}
    ordered = crawl.crawl_order(spark.createDataFrame([("b", 1, 0), ("a", 1, 9)], "url string, depth int, priority_score int")).orderBy("position").collect()
    assert [r["url"] for r in ordered] == ["a", "b"]


def test_diff(spark):
    files = spark.createDataFrame([("u", "2025-01-10_u.md"), ("v", "2024-01-01_v.md"), ("w", "keins.md"), (None, "x.md")], "source_url string, file string")
    links = spark.createDataFrame([("u",), ("z",), (None,)], "link string")
    assert {tuple(r) for r in crawl.corpus_diff(files, links, "2025-01-12").collect()} == {("u", "fresh"), ("v", "stale"), ("w", "stale"), ("z", "discovered")}


def test_statistics_and_report(spark):
    rows = [("block", "r", f"u{k}") for k in range(9)] + [("allow", "s", "v")]
    df = spark.createDataFrame(rows, "decision string, reason string, normalized_url string")
    out = {r["decision"]: r for r in pages.decision_statistics(df).collect()}
    assert out["block"]["n"] == 9 and out["block"]["examples"] == "u0 u1 u2 u3 u4" and out["allow"]["examples"] == ""
    assert pages.decision_statistics(df.limit(0)).count() == 0
